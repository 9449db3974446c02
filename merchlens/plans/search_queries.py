"""Retrieval, fusion and reranking queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from merchlens.functions.vectors import cosine_distance
from merchlens.operators import constraints as cs
from merchlens.operators import dense as dn
from merchlens.operators import fusion as fu
from merchlens.operators import lexical as lx
from merchlens.operators import segments as sg
from merchlens.operators import vector_index as vi
from merchlens.plans.derived import load
from merchlens.plans.registry import query
from merchlens.session import shared_folder
from merchlens.sources import sinks

# --------------------------------------------------------------- twins: lexical
_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"


def _counts(table: str, key: str, name: str) -> str:
    return f"""SELECT {name}, term, count(*) AS tf FROM (SELECT {name}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]))) AS term
       FROM (SELECT {key} AS {name}, {_TOK} AS w FROM {table})) GROUP BY {name}, term"""


_N = "(SELECT count(*) FROM documents)"
_VOCAB = f"SELECT term, count(*) AS df, ln((1+{_N})/(1.0+count(*)))+1 AS idf FROM ({_counts('documents', 'doc_id', 'doc_id')}) GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.8*{_N}"
_WEIGHTS = f"SELECT doc_id, term, (1+ln(tf))*idf AS w FROM ({_counts('documents', 'doc_id', 'doc_id')}) JOIN vocab USING (term)"
LEX_CTE = f"""WITH vocab AS MATERIALIZED ({_VOCAB}), wts AS MATERIALIZED ({_WEIGHTS}),
 norms AS (SELECT doc_id, sqrt(sum(w*w)) AS n FROM wts GROUP BY doc_id),
 qw AS (SELECT query_id, term, (1+ln(tf))*idf AS w FROM ({_counts('benchmark', 'item_id', 'query_id')}) JOIN vocab USING (term)),
 qn AS (SELECT query_id, sqrt(sum(w*w)) AS n FROM qw GROUP BY query_id),
 lex AS MATERIALIZED (SELECT q.query_id, wts.doc_id, sum(q.w/qn.n * wts.w/norms.n) AS score FROM qw q JOIN qn USING (query_id) JOIN wts USING (term) JOIN norms ON norms.doc_id = wts.doc_id GROUP BY q.query_id, wts.doc_id HAVING sum(q.w/qn.n * wts.w/norms.n) > 0),
 lexr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score,8) DESC, doc_id) AS rank FROM lex)"""
# ---------------------------------------------------------------- twins: dense
_COS = "list_dot_product(cast({0} AS DOUBLE[]), cast({1} AS DOUBLE[])) / (sqrt(list_dot_product(cast({0} AS DOUBLE[]), cast({0} AS DOUBLE[]))) * sqrt(list_dot_product(cast({1} AS DOUBLE[]), cast({1} AS DOUBLE[]))))"
_OK = """(f_category IS NULL OR lower(category) = lower(f_category)) AND (f_brand IS NULL OR lower(brand) = lower(f_brand)) AND (f_min_rating IS NULL OR coalesce(rating >= f_min_rating, false))
 AND (f_min_price IS NULL OR coalesce(CASE WHEN f_min_inclusive THEN price >= f_min_price WHEN NOT f_min_inclusive THEN price > f_min_price END, false))
 AND (f_max_price IS NULL OR coalesce(CASE WHEN f_max_inclusive THEN price <= f_max_price WHEN NOT f_max_inclusive THEN price < f_max_price END, false))"""
# Every vector is searched; only products of the catalog are candidates of hybrid search and runs.
DENSE_CTE = f"""qs AS (SELECT * FROM {{search_queries}}), prods AS MATERIALIZED (SELECT * FROM {{doc_products}}),
 vecs AS (SELECT e.vec_id AS doc_id, e.embedding AS vec, p.category, p.brand, p.price, p.rating, p.doc_id IS NOT NULL AS known FROM embeddings e LEFT JOIN prods p ON p.doc_id = e.vec_id),
 den AS MATERIALIZED (SELECT query_id, p.doc_id, known, {_COS.format('qs.embedding', 'p.vec')} AS score, coalesce({_OK}, false) AS ok FROM qs JOIN vecs p ON true WHERE qs.embedding IS NOT NULL AND p.vec IS NOT NULL),
 denr AS MATERIALIZED (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score,8) DESC, doc_id) AS rank FROM den),
 denf AS MATERIALIZED (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score,8) DESC, doc_id) AS rank FROM den WHERE ok),
 denk AS MATERIALIZED (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score,8) DESC, doc_id) AS rank FROM den WHERE ok AND known)"""
HYBRID_CTE = f"""{LEX_CTE}, {DENSE_CTE},
 lexf AS MATERIALIZED (SELECT l.query_id, l.doc_id, l.score, row_number() OVER (PARTITION BY l.query_id ORDER BY round(l.score,8) DESC, l.doc_id) AS rank FROM lex l JOIN qs USING (query_id) JOIN prods p ON p.doc_id = l.doc_id WHERE {_OK}),
 fused AS (SELECT query_id, doc_id, sum(1.0/(60+rank)) AS score, max(CASE WHEN b='d' THEN rank END) AS dense_rank, max(CASE WHEN b='l' THEN rank END) AS lexical_rank
   FROM (SELECT query_id, doc_id, rank, 'd' AS b FROM denk WHERE rank <= 30 UNION ALL SELECT query_id, doc_id, rank, 'l' AS b FROM lexf) GROUP BY query_id, doc_id),
 hyb AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score,12) DESC, doc_id) AS rank FROM fused) WHERE rank <= 10)"""
LIMIT = 10


def _docs(spark, d):
    return load(spark, d, "documents")


def lexical_index(spark, d) -> lx.LexicalIndex:
    return lx.fit(_docs(spark, d), "doc_id", "text")


def stored_index(spark, d) -> lx.LexicalIndex:
    """The index as a stored artifact of the documents, made where it is missing."""

    def make_lists(path):
        docs = _docs(spark, d)
        size = docs.agg(F.count(F.lit(1)).alias("n_docs"))
        sinks.save_tables({"lists": lx.posting_lists(docs, size, "doc_id", "text"), "size": size}, path)

    made = sinks.stored(spark, d, "lexical-lists", ["documents"], make_lists)

    def make(path):
        sinks.save_tables({"vocab": lx.vocabulary_of(made["lists"]), "norms": lx.norms_of(made["lists"])}, path)

    t = sinks.stored(spark, d, "lexical-index", ["documents"], make)
    return lx.index_of(made["lists"], t["vocab"], t["norms"], made["size"])


def _filters(spark, d):
    return load(spark, d, "search_queries").drop("text", "embedding", "audited", "expected_status")


def _query_vectors(spark, d, index):
    return lx.query_vectors(load(spark, d, "benchmark"), "item_id", "text", index.vocab)


def lexical_scores(spark, d, k=None):
    """R03; ``k`` leaves out most pairs that are not among a query's best."""
    index = stored_index(spark, d)
    return lx.scores(index, _query_vectors(spark, d, index), k=k)


def catalog(spark, d):
    """Every vector, with the attributes of its product where there is one."""
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return vectors.join(load(spark, d, "doc_products").drop("text"), "doc_id", "left")


def products_with_vectors(spark, d):
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return load(spark, d, "doc_products").drop("text").join(vectors, "doc_id")


def hybrid_candidates(spark, d, limit=LIMIT):
    """R08 over the whole batch: constraints first, then ranks, then fusion."""
    queries = load(spark, d, "search_queries")
    pool = dn.exact_top_k(products_with_vectors(spark, d), queries, fu.DENSE_POOL * limit, filtered=True)
    return fu.hybrid(pool, constrained_scores(spark, d), limit)


@query("lexical_fit_vocab", f"SELECT term, df, round(idf,6) AS idf FROM ({_VOCAB})")
def lexical_fit_vocab(spark, d):
    """R01 vocabulary."""
    return lexical_index(spark, d).vocab.withColumn("idf", F.round("idf", 6))


@query(
    "lexical_postings",
    f"{LEX_CTE} SELECT doc_id, count(*) AS terms, round(sum(w/n),5) AS weight_sum, round(max(w/n),6) AS top_weight FROM wts JOIN norms USING (doc_id) GROUP BY doc_id",
)
def lexical_postings(spark, d):
    """R01 normalized weights, summarised per document."""
    return stored_index(spark, d).postings.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("terms"),
        F.round(F.sum("weight"), 5).alias("weight_sum"),
        F.round(F.max("weight"), 6).alias("top_weight"),
    )


@query("query_vectors", f"{LEX_CTE} SELECT query_id, term, round(w/n,6) AS q_weight FROM qw JOIN qn USING (query_id)")
def query_vectors(spark, d):
    """R02."""
    vocab = stored_index(spark, d).vocab
    out = lx.query_vectors(load(spark, d, "benchmark"), "item_id", "text", vocab)
    return out.withColumn("q_weight", F.round("q_weight", 6))


@query("lexical_topk", f"{LEX_CTE} SELECT query_id, doc_id, cast(rank AS INT) AS rank, round(score,6) AS score FROM lexr WHERE rank <= 5")
def lexical_topk(spark, d):
    """The flagship."""
    top = lx.top_k(lexical_scores(spark, d, k=5), 5)
    return top.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


_NOW = "(SELECT doc_id, CASE WHEN doc_id % 100 = 9 THEN text || ' ' || lang ELSE text END AS text FROM documents WHERE doc_id % 50 <> 3)"


def _changed_index(spark, d):
    """Segments of all documents but one in a hundred, then these added, some removed, some replaced."""
    docs = _docs(spark, d).select("doc_id", "text", "lang")
    base = f"{shared_folder(spark)}/sources/segments-{uuid.uuid4().hex}"
    sg.add(base, docs.filter("doc_id % 100 <> 7"), "doc_id", "text")
    sg.add(base, docs.filter("doc_id % 100 = 7"), "doc_id", "text")
    sg.remove(spark, base, docs.filter("doc_id % 50 = 3"), "doc_id")
    new = docs.filter("doc_id % 100 = 9").withColumn("text", F.concat("text", F.lit(" "), "lang"))
    sg.replace(base, new, "doc_id", "text")
    return sg.load(spark, base)


@query(
    "lexical_topk_after_changes",
    f"{LEX_CTE.replace('FROM documents', 'FROM ' + _NOW)} SELECT query_id, doc_id, cast(rank AS INT) AS rank, round(score,6) AS score FROM lexr WHERE rank <= 5",
)
def lexical_topk_after_changes(spark, d):
    """An index in segments after additions, removals and new texts."""
    top = sg.search(_changed_index(spark, d), load(spark, d, "benchmark"), "item_id", "text", 5)
    return top.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(
    "index_round_trip",
    f"{LEX_CTE}, p AS (SELECT doc_id, term FROM wts) SELECT 'postings' AS part, (SELECT count(*) FROM p) AS row_count, (SELECT count(DISTINCT term) FROM p) AS terms UNION ALL SELECT 'vocab', (SELECT count(*) FROM vocab), (SELECT count(DISTINCT term) FROM vocab) UNION ALL SELECT 'size', 1, NULL",
)
def index_round_trip(spark, d):
    """The stored index, each table with its rows, every row checked against the manifest."""
    made = stored_index(spark, d)
    path = f"{shared_folder(spark)}/sources/index-{uuid.uuid4().hex}"
    sinks.save_index(made.postings, made.vocab, made.corpus_size, path)
    out = None
    for name, df in sinks.load_tables(spark, path, verify=True).items():
        terms = F.count_distinct("term") if "term" in df.columns else F.lit(None).cast("bigint")
        one = df.agg(F.count(F.lit(1)).alias("row_count"), terms.alias("terms")).select(F.lit(name).alias("part"), "row_count", "terms")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "lexical_stats",
    f"SELECT n_docs, v AS vocabulary, nz AS non_zeros, round(1 - nz*1.0/(n_docs*v),6) AS sparsity FROM (SELECT {_N} AS n_docs, count(*) AS v, cast(sum(df) AS BIGINT) AS nz FROM ({_VOCAB}))",
)
def lexical_stats(spark, d):
    """A25."""
    return lx.statistics(stored_index(spark, d))


@query(
    "lexical_scenarios",
    f"{LEX_CTE} SELECT item_id AS query_id, coalesce(hits,0) AS hits, round(best,6) AS best_score, best_doc FROM benchmark LEFT JOIN (SELECT query_id, count(*) AS hits, max(score) AS best, max(CASE WHEN rank=1 THEN doc_id END) AS best_doc FROM lexr WHERE rank <= 5 GROUP BY 1) ON item_id = query_id",
)
def lexical_scenarios(spark, d):
    """R04."""
    out = lx.scenario_report(stored_index(spark, d), load(spark, d, "benchmark"), "item_id", "text")
    return out.withColumn("best_score", F.round("best_score", 6))


@query("dense_topk_exact", f"WITH {DENSE_CTE} SELECT query_id, doc_id, cast(rank AS INT) AS rank, round(score,6) AS score FROM denr WHERE rank <= 10")
def dense_topk_exact(spark, d):
    """R05, R16, K02, J08."""
    top = dn.exact_top_k(catalog(spark, d), load(spark, d, "search_queries"), 10)
    return top.withColumn("score", F.round("score", 6))


@query("dense_topk_filtered", f"WITH {DENSE_CTE} SELECT query_id, doc_id, cast(rank AS INT) AS rank, round(score,6) AS score FROM denf WHERE rank <= 10")
def dense_topk_filtered(spark, d):
    """R07."""
    top = dn.exact_top_k(catalog(spark, d), load(spark, d, "search_queries"), 10, filtered=True)
    return top.withColumn("score", F.round("score", 6))


@query(
    "nearest_one",
    f"SELECT doc_id, round(score,6) AS score FROM (SELECT vec_id AS doc_id, {_COS.format('embedding', '(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)')} AS score FROM embeddings) ORDER BY round(score,8) DESC, doc_id LIMIT 10",
)
def nearest_one(spark, d):
    """One vector, a top-10 report."""
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    probe = vectors.orderBy("doc_id").first()["embedding"]
    return dn.nearest(vectors, probe, 10).withColumn("score", F.round("score", 6))


# The index in SQL: pivots by md5, every vector in the cell of its nearest pivot, as many cells as the sample needs.
_DOT = "round(list_dot_product({0}, {1}), 8)"
_ANN_CTE = f"""WITH {DENSE_CTE}, us AS MATERIALIZED (SELECT vec_id, list_transform(cast(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(cast(embedding AS DOUBLE[]), cast(embedding AS DOUBLE[])))) AS u FROM embeddings WHERE embedding IS NOT NULL),
 pv AS MATERIALIZED (SELECT u AS p, row_number() OVER (ORDER BY md5('pivot:' || vec_id), vec_id) - 1 AS cell FROM us QUALIFY cell < least({vi.MAX_CELLS}, ceil({vi.CELLS_PER_ROOT} * sqrt((SELECT count(*) FROM us))))),
 asg AS MATERIALIZED (SELECT vec_id AS doc_id, cell FROM (SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY {_DOT.format('u', 'p')} DESC, cell) AS n FROM us, pv) WHERE n = 1),
 smp AS MATERIALIZED (SELECT vec_id, u FROM us ORDER BY md5('probe:' || vec_id), vec_id LIMIT {vi.SAMPLE}),
 tru AS (SELECT query_id, doc_id FROM (SELECT s.vec_id AS query_id, us.vec_id AS doc_id, row_number() OVER (PARTITION BY s.vec_id ORDER BY {_DOT.format('s.u', 'us.u')} DESC, us.vec_id) AS n FROM smp s JOIN us ON us.vec_id <> s.vec_id) WHERE n <= {vi.NEIGHBOURS}),
 hit AS (SELECT o.n AS cell_rank FROM tru JOIN asg USING (doc_id) JOIN (SELECT vec_id AS query_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY {_DOT.format('u', 'p')} DESC, cell) AS n FROM smp, pv) o USING (query_id, cell)),
 need AS MATERIALIZED (SELECT list_sort(list(cell_rank))[cast(ceil({vi.RECALL} * count(*)) AS BIGINT)] AS probes FROM hit),
 near AS MATERIALIZED (SELECT query_id, cell FROM (SELECT query_id, cell, row_number() OVER (PARTITION BY query_id ORDER BY {_DOT.format('u', 'p')} DESC, cell) AS n FROM qs JOIN us ON us.vec_id = qs.query_id, pv) WHERE n <= (SELECT probes FROM need)),
 ann AS MATERIALIZED (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score,8) DESC, doc_id) AS rank FROM den JOIN asg USING (doc_id) JOIN near USING (query_id, cell))"""


def stored_vector_index(spark, d) -> vi.VectorIndex:
    """The inverted file of the vectors, made where it is missing."""

    def make(path):
        vectors = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
        sinks.save_tables(vi.fit(vectors).tables(), path)

    return vi.VectorIndex(**sinks.stored(spark, d, "vector-index", ["embeddings"], make))


@query("dense_topk_ann", f"{_ANN_CTE} SELECT query_id, doc_id, cast(rank AS INT) AS rank, round(score,6) AS score FROM ann WHERE rank <= 10")
def dense_topk_ann(spark, d):
    """R06."""
    top = vi.search(stored_vector_index(spark, d), load(spark, d, "search_queries"), 10)
    return top.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("dense_topk_proved", f"WITH {DENSE_CTE} SELECT query_id, doc_id, cast(rank AS INT) AS rank, round(score,6) AS score FROM denr WHERE rank <= 10")
def dense_topk_proved(spark, d):
    """R06 with a proof: the index with a second pass over the cells its bounds do not exclude."""
    top = vi.search(stored_vector_index(spark, d), load(spark, d, "search_queries"), 10, exact=True)
    return top.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(
    "index_share_read",
    f"""{_ANN_CTE}, sz AS (SELECT cell, count(*) AS n FROM asg GROUP BY cell)
        SELECT query_id, count(*) AS cells, cast(sum(n) AS BIGINT) AS vectors, round(sum(n) * 1.0 / (SELECT count(*) FROM asg), 6) AS share FROM near JOIN sz USING (cell) GROUP BY query_id""",
)
def index_share_read(spark, d):
    """Cells and vectors that the index reads for each query."""
    return vi.share_read(stored_vector_index(spark, d), load(spark, d, "search_queries"))


@query(
    "ann_recall",
    f"""{_ANN_CTE}, r AS (SELECT e.query_id, k, avg(CASE WHEN a.rank <= k THEN 1.0 ELSE 0 END) AS recall FROM denr e LEFT JOIN ann a USING (query_id, doc_id), (VALUES (5),(10),(20)) t(k) WHERE e.rank <= k GROUP BY 1,2)
        SELECT k, round(avg(recall),6) AS avg_recall, round(min(recall),6) AS min_recall, count(*) AS queries FROM r GROUP BY k""",
)
def ann_recall(spark, d):
    """R12 at K = 5, 10, 20."""
    products, queries = catalog(spark, d), load(spark, d, "search_queries")
    return dn.ann_recall(
        dn.exact_top_k(products, queries, 20), vi.search(stored_vector_index(spark, d), queries, 20), [5, 10, 20]
    )


@query(
    "filtered_underfill",
    f"""WITH {DENSE_CTE}, el AS (SELECT query_id, count(*) FILTER (ok) AS eligible FROM den GROUP BY query_id)
        SELECT query_id, eligible, coalesce(f,0) AS filter_first, coalesce(r,0) AS rank_first, least(10, eligible) AS possible, coalesce(r,0) < least(10, eligible) AS underfilled
        FROM el LEFT JOIN (SELECT query_id, count(*) AS f FROM denf WHERE rank <= 10 GROUP BY 1) USING (query_id)
        LEFT JOIN (SELECT r.query_id, count(*) AS r FROM denr r JOIN den USING (query_id, doc_id) WHERE r.rank <= 10 AND ok GROUP BY 1) USING (query_id)""",
)
def filtered_underfill(spark, d):
    """R13."""
    products, queries = catalog(spark, d), load(spark, d, "search_queries")
    filtered = dn.exact_top_k(products, queries, 10, filtered=True)
    plain = dn.exact_top_k(products, queries, 10)
    bare = _filters(spark, d)
    allowed = (
        plain.join(products.drop("embedding"), "doc_id").join(bare, "query_id").filter(cs.matches_columns())
        .select("query_id", "doc_id")
    )
    eligible = dn.eligible_vectors(products, queries)
    return dn.underfill(filtered, plain, allowed, eligible, 10)


def _damaged(spark, d):
    """The given vectors with one kind of fault per id."""
    turn, e = F.col("vec_id") % 20, F.col("embedding")
    first = lambda value: F.transform(e, lambda x, i: F.when(i == 0, F.lit(value)).otherwise(x))
    damaged = (
        F.when(turn == 1, F.lit(None)).when(turn == 2, F.slice(e, 1, 63)).when(turn == 3, first(float("nan")))
        .when(turn == 4, first(float("inf"))).when(turn == 5, F.transform(e, lambda x: x * 0))
        .when(turn == 6, F.transform(e, lambda x: x * 3)).otherwise(e)
    )
    return load(spark, d, "embeddings").select("vec_id", damaged.alias("embedding"))


@query(
    "vector_checks",
    """SELECT count(*) AS vectors, count(*) FILTER (t NOT BETWEEN 1 AND 6 AND abs(n-1) <= 0.001) AS usable, count(*) FILTER (t = 1) AS missing, count(*) FILTER (t = 2) AS dimension, count(*) FILTER (t IN (3, 4)) AS not_finite,
       count(*) FILTER (t = 5) AS zero, count(*) FILTER (t = 6 OR (t NOT BETWEEN 1 AND 6 AND abs(n-1) > 0.001)) AS not_unit, round(min(n) FILTER (t NOT BETWEEN 1 AND 6),6) AS min_norm, round(max(n) FILTER (t NOT BETWEEN 1 AND 6),6) AS max_norm
       FROM (SELECT vec_id % 20 AS t, sqrt(list_dot_product(cast(embedding AS DOUBLE[]), cast(embedding AS DOUBLE[]))) AS n FROM embeddings)""",
)
def vector_checks(spark, d):
    """Counts over damaged vectors, norms over the usable ones."""
    damaged = _damaged(spark, d)
    norms = dn.vector_report(damaged.filter((F.col("vec_id") % 20 == 0) | (F.col("vec_id") % 20 > 6)), 64)
    counts = dn.vector_report(damaged, 64).drop("min_norm", "mean_norm", "max_norm")
    return counts.join(F.broadcast(norms.select("min_norm", "max_norm")))  # one row each


# A run with faults by query: rows lost, ranks torn, distances out of order, itself not first.
def _faulty_run(spark, d):
    top = dn.exact_top_k(catalog(spark, d), load(spark, d, "search_queries"), 10)
    turn, r = F.col("query_id") % 6, F.col("rank")
    torn = F.when((turn == 2) & (r > 5), r + 1).otherwise(r)
    swapped = F.when((turn == 3) & (r == 4), F.col("score") + 2).when((turn == 5) & (r == 7), F.lit(float("nan"))).otherwise(F.col("score"))
    other = F.when((turn == 4) & (r == 1), F.col("doc_id") + 1_000_000).otherwise(F.col("doc_id"))
    return top.filter(~((turn == 1) & (r > 8))).select("query_id", other.alias("doc_id"), torn.alias("rank"), swapped.alias("score"))


@query(
    "vector_search_checks",
    f"""WITH {DENSE_CTE} SELECT query_id, count(*) FILTER (t <> 1 OR rank <= 8) AS returned, t <> 1 AS "full", t <> 2 AS contiguous, t NOT IN (3, 5) AS ordered, t NOT IN (3, 5) AS in_range, bool_or(rank = 1 AND doc_id = query_id AND t <> 4) AS self_first
        FROM (SELECT *, query_id % 6 AS t FROM denr WHERE rank <= 10) GROUP BY query_id, t""",
)
def vector_search_checks(spark, d):
    """K rows, contiguous ranks, distances in range that never fall, self match first; every fault occurs."""
    return dn.search_checks(_faulty_run(spark, d), 10)


@query(
    "filtered_search_checks",
    f"""WITH {DENSE_CTE} SELECT query_id, least(10, el) AS possible, coalesce(n, 0) AS returned, coalesce(bad, 0) AS violations, coalesce(n, 0) = least(10, el) AND coalesce(bad, 0) = 0 AS ok FROM (SELECT query_id, count(*) FILTER (ok) AS el FROM den GROUP BY 1)
        LEFT JOIN (SELECT query_id, count(*) AS n, count(*) FILTER (NOT ok) AS bad FROM (SELECT den.*, row_number() OVER (PARTITION BY query_id ORDER BY round(score,8) DESC, doc_id) AS r FROM den WHERE ok OR query_id % 4 = 1) WHERE r <= 10 GROUP BY 1) USING (query_id)""",
)
def filtered_search_checks(spark, d):
    """R17 under filters: K rows where so many are eligible, all of them satisfying; every fourth query ignores its filters."""
    products, queries = catalog(spark, d), load(spark, d, "search_queries")
    careless = F.col("query_id") % 4 == 1
    runs = dn.exact_top_k(products, queries.filter(~careless), 10, filtered=True).unionByName(
        dn.exact_top_k(products, queries.filter(careless), 10)
    )
    rows = runs.join(products.drop("embedding"), "doc_id").join(_filters(spark, d), "query_id")
    checked = rows.select("query_id", F.coalesce(cs.matches_columns(), F.lit(False)).alias("satisfied"))
    return dn.filtered_checks(checked, dn.eligible_vectors(products, queries), 10)


@query(
    "cosine_distances",
    f"""SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(CASE WHEN a.vec_id % 20 = 5 OR b.vec_id % 20 = 5 THEN 1.0 ELSE greatest(0, least(2, 1 - ({_COS.format('a.embedding', 'b.embedding')}))) END, 6) AS distance
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id // 2""",
)
def cosine_distances(spark, d):
    """Distance of each vector to that of half its id; 1 for a zero vector, never outside 0 to 2."""
    zeroed = load(spark, d, "embeddings").withColumn(
        "embedding", F.when(F.col("vec_id") % 20 == 5, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    )
    a = zeroed.select(F.col("vec_id").alias("left_id"), F.col("embedding").alias("a"), F.floor(F.col("vec_id") / 2).alias("right_id"))
    b = zeroed.select(F.col("vec_id").alias("right_id"), F.col("embedding").alias("b"))
    return a.join(b, "right_id").select("left_id", "right_id", F.round(cosine_distance(F.col("a"), F.col("b")), 6).alias("distance"))


@query(
    "nearest_in_category",
    f"WITH {DENSE_CTE} SELECT query_id, doc_id, round(score,6) AS score, regexp_matches(lower(text), '\\b(the|la|die)\\b') AS keyword_hit FROM denf JOIN documents USING (doc_id) WHERE rank = 1",
)
def nearest_in_category(spark, d):
    """Nearest product under the filters and a keyword check on its text."""
    top = dn.exact_top_k(catalog(spark, d), load(spark, d, "search_queries"), 1, filtered=True)
    hit = F.lower("text").rlike(r"\b(the|la|die)\b")
    return top.join(_docs(spark, d), "doc_id").select(
        "query_id", "doc_id", F.round("score", 6).alias("score"), hit.alias("keyword_hit")
    )


_CENT = "SELECT label AS query_id, list_transform(range(1, 65), lambda i: list_avg(list_transform(l, lambda v: v[i]))) AS c FROM (SELECT label, list(cast(embedding AS DOUBLE[])) AS l FROM embeddings GROUP BY label)"


@query(
    "centroid_margins",
    f"""SELECT query_id, round(t,6) AS target, round(o,6) AS distractor, round(t-o,6) AS margin, t > o AS passed FROM (
        SELECT query_id, max(CASE WHEN label = query_id THEN s END) AS t, max(CASE WHEN label <> query_id THEN s END) AS o FROM (
          SELECT query_id, label, {_COS.format('c', 'embedding')} AS s FROM ({_CENT}) JOIN embeddings ON true) GROUP BY query_id)""",
)
def centroid_margins(spark, d):
    """Each class centroid against its best member and its best outsider.

    Only the best member and the best outsider of each class matter, so the two
    filtered top-1 searches replace scoring every pair into the margin.
    """
    vectors = load(spark, d, "embeddings")
    members = vectors.select(
        F.col("vec_id").alias("doc_id"), "embedding", F.col("label").cast("string").alias("category"),
        F.lit("x").alias("brand"), F.lit(0.0).alias("price"), F.lit(1.0).alias("rating"),
    )
    dims = vectors.select("label", F.posexplode("embedding").alias("pos", "v")).groupBy("label", "pos").agg(
        F.avg(F.col("v").cast("double")).alias("v")
    )
    centroids = dims.groupBy("label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("embedding")
    )
    base = centroids.select(
        F.col("label").alias("query_id"), "embedding", F.col("label").cast("string").alias("f_category"),
        *[F.lit(None).cast("double").alias(f) for f in ("f_min_price", "f_max_price", "f_min_rating")],
        *[F.lit(None).cast("boolean").alias(f) for f in ("f_min_inclusive", "f_max_inclusive")],
        F.lit(None).cast("string").alias("f_brand"),
    )
    own = dn.exact_top_k(members, base, 1, filtered=True).select("query_id", "score", F.lit(True).alias("is_target"))
    away = base.withColumns({"f_not_category": F.col("f_category"), "f_category": F.lit(None).cast("string")})
    best = dn.exact_top_k(members, away, 1, filtered=True).select(
        "query_id", "score", F.lit(False).alias("is_target")
    )
    out = dn.margins(own.unionByName(best))
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("target", "distractor", "margin")], "passed")


_HYB = f"{HYBRID_CTE} SELECT query_id, doc_id, cast(rank AS INT) AS rank, round(score,6) AS score, dense_rank, lexical_rank FROM hyb"


@query("hybrid_rrf", _HYB)
def hybrid_rrf(spark, d):
    """R08, J04, U01."""
    out = hybrid_candidates(spark, d)
    return out.select(
        "query_id", "doc_id", "rank", F.round("score", 6).alias("score"),
        F.col("sources.dense.rank").alias("dense_rank"), F.col("sources.lexical.rank").alias("lexical_rank"),
    )


_RR = """SELECT query_id, doc_id, rank, score, coalesce((dm - dense_rank + 1)*1.0/dm, 0)/2 + coalesce((lm - lexical_rank + 1)*1.0/lm, 0)/2 AS ms
  FROM (SELECT *, max(dense_rank) OVER (PARTITION BY query_id) AS dm, max(lexical_rank) OVER (PARTITION BY query_id) AS lm FROM hyb)"""


@query(
    "rerank_multi_signal",
    f"{HYBRID_CTE} SELECT query_id, doc_id, cast(rank AS INT) AS rank, round(ms,6) AS rerank_score, cast(row_number() OVER (PARTITION BY query_id ORDER BY round(ms,8) DESC, rank, doc_id) AS INT) AS new_rank FROM ({_RR})",
)
def rerank_multi_signal(spark, d):
    """R09, W03."""
    out = fu.rerank(fu.multi_signal(frozen_candidates(spark, d)))
    return out.select("query_id", "doc_id", "rank", F.round("rerank_score", 6).alias("rerank_score"), "new_rank")


_PAIR = "(length(b.text) % 97) * 1.0 / 97 + (p.price % 31) / 31.0"


def external_scores(spark, d):
    """A table of pair scores such as a model would deliver: (query_id, doc_id, pair_score)."""
    docs = load(spark, d, "doc_products").select("doc_id", "price")
    queries = load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.length("text").alias("qlen"))
    pairs = frozen_candidates(spark, d).select("query_id", "doc_id").join(docs, "doc_id").join(queries, "query_id")
    score = (F.col("qlen") % 97) * 1.0 / 97 + (F.col("price") % 31) / 31.0
    return pairs.select("query_id", "doc_id", score.alias("pair_score"))


@query(
    "rerank_combined",
    f"""{HYBRID_CTE}, ps AS (SELECT r.*, (length(b.text) % 97) * 1.0 / 97 + (p.price % 31) / 31.0 AS s FROM ({_RR}) r JOIN benchmark b ON b.item_id = r.query_id JOIN prods p ON p.doc_id = r.doc_id),
        sc AS (SELECT *, CASE WHEN max(s) OVER (PARTITION BY query_id) - min(s) OVER (PARTITION BY query_id) <= 1e-12 THEN 0.5 ELSE (s - min(s) OVER (PARTITION BY query_id)) / (max(s) OVER (PARTITION BY query_id) - min(s) OVER (PARTITION BY query_id)) END AS mm FROM ps)
        SELECT query_id, doc_id, round(0.7*mm + 0.3*ms,4) AS rerank_score, cast(row_number() OVER (PARTITION BY query_id ORDER BY round(0.7*mm+0.3*ms,8) DESC, rank, doc_id) AS INT) AS new_rank FROM sc""",
)
def rerank_combined(spark, d):
    """A table of pair scores joined to the candidates."""
    cands, scores = frozen_candidates(spark, d), external_scores(spark, d)
    out = fu.rerank(fu.pair_scores(cands, scores, 0.7, 0.3))
    return out.select("query_id", "doc_id", F.round("rerank_score", 4).alias("rerank_score"), "new_rank")


@query(
    "rerank_shift",
    f"{HYBRID_CTE} SELECT query_id, cast(sum(abs(nr - rank)) AS BIGINT) AS total_shift, count(*) AS candidates FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(ms,8) DESC, rank, doc_id) AS nr FROM ({_RR})) GROUP BY query_id",
)
def rerank_shift(spark, d):
    """W05, R10 as the reference order."""
    return fu.rank_shift(fu.rerank(fu.multi_signal(frozen_candidates(spark, d))))


@query(
    "overlap_at_k",
    f"""{LEX_CTE}, {DENSE_CTE}, ids AS (SELECT query_id FROM lexr WHERE rank<=20 UNION SELECT query_id FROM denr WHERE rank<=20)
        SELECT query_id, k, coalesce(s,0) AS shared, round(coalesce(s,0)*1.0/k,6) AS overlap FROM (SELECT query_id, unnest([5,10,20]) AS k FROM ids)
        LEFT JOIN (SELECT a.query_id, k, count(*) AS s FROM lexr a JOIN denr b ON a.query_id=b.query_id AND a.doc_id=b.doc_id, (VALUES (5),(10),(20)) t(k) WHERE a.rank <= k AND b.rank <= k GROUP BY 1,2) USING (query_id, k)""",
)
def overlap_at_k(spark, d):
    """R14, U02."""
    lex = lx.top_k(lexical_scores(spark, d, k=20), 20)
    den = dn.exact_top_k(catalog(spark, d), load(spark, d, "search_queries"), 20)
    return fu.overlap(lex, den, [5, 10, 20])


@query(
    "head_to_head",
    f"""{LEX_CTE}, {DENSE_CTE}, ids AS (SELECT query_id FROM lexr WHERE rank<=10 UNION SELECT query_id FROM denr WHERE rank<=10)
        SELECT query_id, 10 AS k, coalesce(s,0) AS shared, round(coalesce(s,0)*1.0/10,6) AS overlap, l.doc_id AS first_best, e.doc_id AS second_best, coalesce(l.doc_id = e.doc_id, false) AS same_best
        FROM ids LEFT JOIN (SELECT a.query_id, count(*) AS s FROM lexr a JOIN denr b ON a.query_id=b.query_id AND a.doc_id=b.doc_id WHERE a.rank <= 10 AND b.rank <= 10 GROUP BY 1) USING (query_id)
        LEFT JOIN (SELECT query_id, doc_id FROM lexr WHERE rank=1) l USING (query_id) LEFT JOIN (SELECT query_id, doc_id FROM denr WHERE rank=1) e USING (query_id)""",
)
def head_to_head(spark, d):
    """R20."""
    lex = lx.top_k(lexical_scores(spark, d, k=10), 10)
    den = dn.exact_top_k(catalog(spark, d), load(spark, d, "search_queries"), 10)
    return fu.head_to_head(lex, den, 10)


def _not_captured(spark, d):
    names = ("f_min_price", "f_max_price", "f_min_inclusive", "f_max_inclusive")
    return fu.capture_status(
        load(spark, d, "search_queries"), cs.unresolved_bounds(**{n: F.col(n) for n in names})
    )


def capture_runs(spark, d, depth=20):
    """Constrained lexical, dense and hybrid runs of the queries that pass the gate."""
    queries = load(spark, d, "search_queries").join(_not_captured(spark, d), "query_id", "left_anti")
    dense = dn.exact_top_k(products_with_vectors(spark, d), queries, depth, filtered=True)
    methods = {
        "tfidf": lx.top_k(lx.first_of(constrained_scores(spark, d), depth), depth),
        "dense": dense,
        "hybrid": frozen_candidates(spark, d),
    }
    return fu.capture(methods, depth).join(queries.select("query_id"), "query_id", "left_semi")


_STOPS = """(SELECT query_id, CASE WHEN audited THEN 'SKIPPED' ELSE 'BLOCKED' END AS status, CASE WHEN NOT audited THEN 'QUERY_AUDIT_INCOMPLETE' ELSE 'PIPELINE_STOP:' || stop END AS reason
   FROM (SELECT *, CASE WHEN (f_min_price IS NOT NULL AND f_min_inclusive IS NULL) OR (f_max_price IS NOT NULL AND f_max_inclusive IS NULL) THEN 'CLARIFICATION_REQUIRED' ELSE expected_status END AS stop FROM qs)
   WHERE NOT audited OR stop NOT IN ('SUCCESS', 'NO_RESULTS'))"""
RUNS_CTE = f"""{HYBRID_CTE}, gone AS MATERIALIZED {_STOPS}, runs AS MATERIALIZED (SELECT * FROM (SELECT query_id, 'tfidf' AS method, doc_id, rank, score FROM lexf WHERE rank <= 20 UNION ALL SELECT query_id, 'dense', doc_id, rank, score FROM denk WHERE rank <= 20
   UNION ALL SELECT query_id, 'hybrid', doc_id, rank, score FROM hyb) WHERE query_id NOT IN (SELECT query_id FROM gone))"""


@query("captured_runs", f"{RUNS_CTE} SELECT query_id, method, doc_id, cast(rank AS INT) AS rank, round(score,6) AS score FROM runs")
def captured_runs(spark, d):
    """R19."""
    return frozen_runs(spark, d).withColumn("score", F.round("score", 6))


@query("capture_blockers", f"{RUNS_CTE} SELECT query_id, 'capture' AS stage, status, reason FROM gone")
def capture_blockers(spark, d):
    """Unaudited queries and those that stop before retrieval."""
    return _not_captured(spark, d)


@query(
    "candidate_verification",
    f"""{HYBRID_CTE} SELECT h.query_id, count(*) AS candidates, count(*) FILTER (NOT ok) AS violations, 0 AS not_finite, bool_and(ok) AS usable
        FROM (SELECT h.query_id, h.doc_id, {_OK} AS ok FROM hyb h JOIN qs USING (query_id) JOIN prods p ON p.doc_id = h.doc_id) h GROUP BY h.query_id""",
)
def candidate_verification(spark, d):
    """fused candidates still satisfy their query."""
    rows = (
        frozen_candidates(spark, d)
        .join(load(spark, d, "doc_products").drop("text"), "doc_id")
        .join(_filters(spark, d), "query_id")
    )
    return cs.verify_candidates(rows, ~cs.matches_columns(), ~F.isnan("score") & F.col("rank").isNotNull())


_SEARCHED = ["documents", "benchmark", "embeddings", "labels"]


def constrained_scores(spark, d):
    """The lexical scores of the pairs that satisfy their query's constraints, as lists, stored once for the runs and the fusion."""

    def make(path):
        index, products = stored_index(spark, d), load(spark, d, "doc_products").drop("text")
        lists = lx.score_lists(index, _query_vectors(spark, d, index), products, cs.matches_columns(), _filters(spark, d))
        sinks.save_tables({"scores": lists}, path)

    return sinks.stored(spark, d, "lexical-score-lists", _SEARCHED, make)["scores"]


def frozen_runs(spark, d):
    """The captured runs as a stored artifact.

    Evaluation reads stored runs, as the reference does, instead of searching again.
    """
    make = lambda path: sinks.save_tables({"runs": capture_runs(spark, d)}, path)
    return sinks.stored(spark, d, "runs", _SEARCHED, make)["runs"]


def frozen_candidates(spark, d):
    """The fused candidates every reranker is compared on, stored once."""
    make = lambda path: sinks.save_tables({"candidates": hybrid_candidates(spark, d)}, path)
    return sinks.stored(spark, d, "hybrid", _SEARCHED, make)["candidates"]
