"""Retrieval against hand values and brute force."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from merchlens.operators import constraints as cs
from merchlens.operators import dense as dn
from merchlens.operators import fusion as fu
from merchlens.operators import lexical as lx
from merchlens.operators import vector_index as vi
from merchlens.operators import segments as sg
from merchlens.operators import skew
from merchlens.sources.readers import ContractError


def test_weights_by_hand(spark):
    # Two kept terms, equal idf, counts chosen so that the unit weights are 2:1.
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "id bigint, text string")
    index = lx.fit(docs, "id", "text")
    w = {(r.doc_id, r.term): r.weight for r in index.postings.collect()}
    assert set(w) == {(1, "a"), (1, "b"), (1, "a b"), (2, "a"), (2, "b"), (2, "a b")}
    assert w[1, "a"] == pytest.approx(3**-0.5)
    assert lx.term_counts(docs, "id", "text").filter("doc_id = 1").count() == 3


def test_repeated_terms_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, "Red red RED mug"), (2, "!!"), (3, None), (4, "one")], "id bigint, text string")
    got = {(r.doc_id, r.term): r.tf for r in lx.term_counts(docs, "id", "text").collect()}
    assert got == {(1, "red"): 3, (1, "mug"): 1, (1, "red red"): 2, (1, "red mug"): 1, (4, "one"): 1}


def test_ranking_ties_by_id(spark):
    docs = spark.createDataFrame([(3, "x y"), (1, "x y"), (2, "x y"), (9, "z z")], "id bigint, text string")
    queries = spark.createDataFrame([(0, "x"), (1, "unknown"), (2, "  ")], "qid bigint, q string")
    got = lx.search(docs, queries, "id", "text", "qid", "q", 2).collect()
    assert [(r.query_id, r.doc_id, r.rank) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1, 1), (0, 2, 2)]


def test_ranks_of_matches_full_ranking(spark):
    rng = np.random.RandomState(3)
    rows = [(q, int(i), float(round(rng.rand(), 1)) + 0.1) for q in range(4) for i in rng.permutation(40)]
    scored = spark.createDataFrame(rows, "query_id bigint, doc_id bigint, score double")
    wanted = scored.filter("doc_id % 7 = 0").select("query_id", "doc_id").union(spark.createDataFrame([(0, 999)], "query_id bigint, doc_id bigint"))
    full = {(r.query_id, r.doc_id): r["rank"] for r in lx.rank(scored).collect()}
    got = {(r.query_id, r.doc_id): r["rank"] for r in lx.ranks_of(scored, wanted).collect()}
    assert got == {k: v for k, v in full.items() if k[1] % 7 == 0}


def test_salted_join_equals_plain_join(spark, monkeypatch):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(200)], "id bigint, k string")
    other = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3)], "k string, v bigint")
    hot = skew.hot_keys(big, "k", 10)
    assert hot.count() == 1
    a = sorted(map(tuple, skew.salted_join(big, other, "k", hot, "id").select("id", "k", "v").collect()))
    b = sorted(map(tuple, big.join(other, "k").select("id", "k", "v").collect()))
    assert a == b
    # A fit whose every term counts as hot gives the same index.
    docs = spark.createDataFrame([(i, f"red mug {i % 3}") for i in range(30)], "id bigint, text string")
    plain = sorted(map(tuple, lx.fit(docs, "id", "text", max_df=1.0).postings.collect()))
    monkeypatch.setattr(lx, "ROWS_PER_SPLIT", 2)
    assert sorted(map(tuple, lx.fit(docs, "id", "text", max_df=1.0).postings.collect())) == plain


def vectors(spark, n, q, dim=8, seed=1):
    rng = np.random.RandomState(seed)
    m, p = rng.standard_normal((n, dim)), rng.standard_normal((q, dim))
    cats = ["a", "B", None]
    docs = spark.createDataFrame(
        [(i, [float(x) for x in m[i]], cats[i % 3], f"b{i % 2}", float(i), None if i % 5 == 0 else float(i % 5)) for i in range(n)],
        "doc_id bigint, embedding array<float>, category string, brand string, price double, rating double",
    )
    queries = spark.createDataFrame(
        [(i, [float(x) for x in p[i]], "A" if i % 2 else None, None, 10.0 if i % 3 == 0 else None, 150.0, False, True, 2.0 if i % 4 == 0 else None) for i in range(q)],
        "query_id bigint, embedding array<float>, f_category string, f_brand string, f_min_price double, f_max_price double, f_min_inclusive boolean, f_max_inclusive boolean, f_min_rating double",
    )
    return docs, queries


@pytest.mark.parametrize("filtered", [False, True])
def test_exact_grid_matches_plain_scoring(spark, filtered):
    docs, queries = vectors(spark, 200, 7)
    got = dn.exact_top_k(docs, queries, 5, filtered, rows_per_block=30, queries_per_block=2)
    from merchlens.functions.vectors import cosine

    pairs = docs.alias("d").join(queries.withColumnRenamed("embedding", "q_vec").alias("q"), cs.matches_columns() if filtered else F.lit(True))
    want = lx.top_k(pairs.select("query_id", "doc_id", cosine(F.col("embedding"), F.col("q_vec")).alias("score")), 5)
    key = lambda df: sorted((r.query_id, r["rank"], r.doc_id) for r in df.collect())
    assert key(got) == key(want)


def test_approximate_finds_itself_and_most_neighbours(spark):
    docs, _ = vectors(spark, 300, 1, dim=16)
    queries = docs.filter("doc_id < 20").select(F.col("doc_id").alias("query_id"), "embedding")
    approx = vi.search(vi.fit(docs), queries, 10)
    assert approx.filter("rank = 1 AND query_id = doc_id").count() == 20
    assert approx.groupBy("query_id", "doc_id").count().filter("count > 1").isEmpty()
    recall = dn.ann_recall(dn.exact_top_k(docs, queries, 10), approx, [10]).first()
    assert recall.avg_recall >= 0.8


@pytest.mark.parametrize("n", [2_000, 30_000])
def test_approximate_recall_holds_as_the_catalog_grows(spark, n):
    m = np.random.default_rng(n).standard_normal((n, 64))
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(n), "embedding": list(m)}))
    queries = docs.filter("doc_id < 40").select(F.col("doc_id").alias("query_id"), "embedding")
    recall = dn.ann_recall(dn.exact_top_k(docs, queries, 10), vi.search(vi.fit(docs), queries, 10), [10]).first()
    assert recall.avg_recall >= 0.95


def test_vector_problems(spark):
    rows = [([1.0, 0.0],), ([1.0],), ([float("nan"), 0.0],), ([0.0, 0.0],), ([2.0, 0.0],), (None,)]
    df = spark.createDataFrame(rows, "embedding array<float>")
    r = dn.vector_report(df, 2).first()
    assert (r.usable, r.dimension, r.not_finite, r.zero, r.not_unit, r.missing) == (1, 1, 1, 1, 1, 1)


def test_fusion_and_hybrid_prune_is_exact(spark):
    rng = np.random.RandomState(4)
    lex = spark.createDataFrame([(0, int(i), float(rng.rand())) for i in range(100)], "query_id bigint, doc_id bigint, score double")
    pool = lx.top_k(spark.createDataFrame([(0, int(i), float(rng.rand())) for i in rng.permutation(130)[:40]], "query_id bigint, doc_id bigint, score double"), 30)
    pruned = fu.hybrid(pool, lex, 10)
    full = fu.reciprocal_rank_fusion({"dense": pool, "lexical": lx.rank(lex)}, 10)
    key = lambda df: [(r.doc_id, round(r.score, 9)) for r in df.orderBy("rank").collect()]
    assert key(pruned) == key(full)


def test_multi_signal_and_minmax(spark):
    rows = [(0, "a", 1, {"dense": (1, 0.9), "lexical": (2, 0.5)}), (0, "b", 2, {"dense": (2, 0.8)}), (0, "c", 3, {"lexical": (1, 0.7)})]
    df = spark.createDataFrame(rows, "query_id int, doc_id string, rank int, sources map<string,struct<rank:int,score:double>>")
    got = {r.doc_id: r.rerank_score for r in fu.multi_signal(df).collect()}
    assert got == {"a": 0.75, "b": 0.25, "c": 0.5}
    scores = spark.createDataFrame([(0, "a", 2.0), (0, "b", 2.0), (0, "c", 2.0)], "query_id int, doc_id string, pair_score double")
    assert {r.rerank_score for r in fu.pair_scores(df, scores).collect()} == {0.5}
    assert fu.pair_scores(df, scores.limit(2)).isEmpty()


@pytest.mark.parametrize(
    "kwargs, want",
    [
        (dict(max_price=100.0, max_inclusive=True), {"a", "b"}),
        (dict(max_price=100.0, max_inclusive=False), {"a"}),
        (dict(min_price=100.0, min_inclusive=True), {"b", "c"}),
        (dict(min_price=100.0, min_inclusive=False), {"c"}),
        (dict(category=" home ", min_rating=3.0), {"b"}),
        (dict(brand="ACME"), {"a"}),
    ],
)
def test_filter_boundaries(spark, kwargs, want):
    rows = [("a", "Home", "Acme", 50.0, None), ("b", "home", None, 100.0, 3.0), ("c", "Toys", "Zed", 150.0, 4.0)]
    df = spark.createDataFrame(rows, "id string, category string, brand string, discounted_price double, rating double")
    assert {r.id for r in df.filter(cs.literal_filter(**kwargs)).collect()} == want


def test_filter_needs_inclusivity(spark):
    with pytest.raises(cs.UnresolvedBound):
        cs.literal_filter(max_price=10.0)
    with pytest.raises(ValueError):
        cs.literal_filter(min_inclusive=True)
    with pytest.raises(ValueError):
        cs.literal_filter(min_rating=7)


def test_top_k_is_pruned_before_the_shuffle(spark):
    scored = spark.createDataFrame([(0, 1, 0.5)], "query_id bigint, doc_id bigint, score double")
    plan = lx.top_k(scored, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_literal_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    spark.createDataFrame([("x", 1.0, 2.0)], "category string, discounted_price double, rating double").write.parquet(path)
    df = spark.read.parquet(path).filter(cs.literal_filter(min_rating=2.0, max_price=5.0, max_inclusive=True)).select("category")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(rating,2.0)" in plan and "LessThanOrEqual(discounted_price,5.0)" in plan


def clustered(n, centres, dim=16, seed=0, spread=0.25):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((centres, dim))[rng.integers(0, centres, n)] + spread * rng.standard_normal((n, dim))


def table(spark, m):
    return spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(len(m)), "embedding": list(m)}))


def ranked(df):
    return sorted((r.query_id, r["rank"], r.doc_id) for r in df.collect())


@pytest.mark.parametrize("probes", [1, 3, None])
def test_proved_search_equals_exact_search(spark, probes):
    docs = table(spark, clustered(3000, 40))
    queries = docs.filter("doc_id % 100 = 7").select(F.col("doc_id").alias("query_id"), "embedding")
    index = vi.fit(docs, rows_per_block=150)
    assert ranked(vi.search(index, queries, 7, probes=probes, exact=True)) == ranked(dn.exact_top_k(docs, queries, 7))
    assert index.vectors.count() == 3000 and index.vectors.groupBy("shelf", "part").count().agg(F.max("count")).first()[0] < 300


def test_clustered_vectors_need_few_cells(spark):
    docs = table(spark, clustered(20_000, 200))
    queries = docs.filter("doc_id < 50").select(F.col("doc_id").alias("query_id"), "embedding")
    index = vi.fit(docs)
    recall = dn.ann_recall(dn.exact_top_k(docs, queries, 10), vi.search(index, queries, 10), [10]).first()
    read = vi.share_read(index, queries)
    assert recall.avg_recall >= 0.95 and read.agg(F.avg("share")).first()[0] < 0.1
    assert read.select("cells").distinct().count() == 1


def test_index_edges(spark):
    m = np.concatenate([np.ones((500, 4)), clustered(40, 4, dim=4), np.zeros((2, 4))])  # mostly one vector
    docs = table(spark, m).unionByName(spark.createDataFrame([(9999, None)], "doc_id bigint, embedding array<double>"))
    queries = docs.filter("doc_id in (3, 505, 9999)").select(F.col("doc_id").alias("query_id"), "embedding")
    index = vi.fit(docs, rows_per_block=50)
    assert index.size.first().vectors == 542
    got = vi.search(index, queries, 600, probes=10_000)
    assert got.filter("query_id = 3").count() == 542 and got.filter("query_id = 9999").isEmpty()
    assert ranked(got.filter("rank <= 5")) == ranked(dn.exact_top_k(docs, queries, 5))
    empty = vi.fit(docs.filter("false"))
    assert vi.search(empty, queries, 3).isEmpty() and vi.search(index, queries.filter("false"), 3).isEmpty()


def test_segments_follow_changes_and_rewrite_nothing(spark, tmp_path):
    rng = np.random.RandomState(7)
    text = lambda: " ".join(rng.choice(["red", "mug", "blue", "lamp", "desk", "oak", "tin"], rng.randint(0, 12)))
    docs = {i: text() for i in range(300)}
    frame = lambda d: spark.createDataFrame(list(d.items()), "id bigint, text string")
    queries = spark.createDataFrame([(0, "red mug"), (1, "oak desk lamp"), (2, "nothing"), (3, "tin tin blue")], "qid bigint, q string")
    base, files = str(tmp_path / "index"), lambda: {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}

    def same_as_fresh():
        got = sg.search(sg.load(spark, base), queries, "qid", "q", 5).collect()
        want = lx.search(frame(docs), queries, "id", "text", "qid", "q", 5).collect()
        row = lambda r: (r.query_id, r["rank"], r.doc_id, round(r.score, 9))
        assert sorted(map(row, got)) == sorted(map(row, want)) and got

    sg.add(base, frame(docs), "id", "text")
    same_as_fresh()
    before = files()
    more = {1000 + i: text() for i in range(3)}
    sg.add(base, frame(more), "id", "text")
    docs |= more
    same_as_fresh()
    after = files()
    assert {p: t for p, t in after.items() if p in before} == before
    rows = lambda paths: sum(spark.read.parquet(str(p)).count() for p in paths if "/counts/" in str(p))
    assert rows(set(after) - set(before)) <= 0.05 * rows(before)
    sg.remove(spark, base, frame({i: "" for i in (5, 6, 1001, 77_777)}), "id")
    for i in (5, 6, 1001):
        del docs[i]
    same_as_fresh()
    new = {8: "red red mug", 9: "", 5: "back again oak"}
    sg.replace(base, frame(new), "id", "text")
    docs |= new
    same_as_fresh()
    with pytest.raises(ContractError):
        sg.add(base, frame({8: "twice"}), "id", "text")


def test_pairs_are_summed_where_their_document_lies(spark):
    docs = spark.createDataFrame([(i, f"red apple number{i % 7} tree{i % 3}") for i in range(60)], "doc_id bigint, text string")
    queries = spark.createDataFrame([(1, "red number3"), (2, "tree1 apple")], "query_id bigint, text string")
    index = lx.fit(docs, "doc_id", "text")
    scored = lx.scores(index, lx.query_vectors(queries, "query_id", "text", index.vocab), docs.select("doc_id"), F.lit(True))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and "hashpartitioning(doc_id" in plan
    assert scored.count() == scored.select("query_id", "doc_id").distinct().count() > 0


def test_postings_are_shuffled_packed_and_only_the_best_of_a_block_leave_it(spark):
    rng = np.random.RandomState(5)
    texts = [(i % 90 if i % 17 else None, " ".join(f"w{x}" for x in rng.zipf(1.6, 12) if x < 40)) for i in range(120)]
    docs = spark.createDataFrame(texts, "id bigint, text string")
    queries = spark.createDataFrame([(q, f"w1 w{q} w2 w3 w{q + 1}") for q in range(1, 6)], "qid bigint, q string")
    index = lx.fit(docs, "id", "text")
    assert index.lists.filter("first").count() == index.vocab.count() < index.postings.count()
    # Ids that repeat or are null add up, as in a join of rows.
    weights = lx.query_vectors(queries, "qid", "q", index.vocab)
    plain = index.postings.join(weights, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("q_weight")).alias("score"))
    want = {(r.query_id, r.doc_id): r["rank"] for r in lx.top_k(plain, 4).collect()}
    best = lx.scores(index, weights, k=4)
    assert {(r.query_id, r.doc_id): r["rank"] for r in lx.top_k(best, 4).collect()} == want
    assert best.count() < lx.scores(index, weights).count() == plain.count()
    # A pair counts as often as it is eligible.
    goods = spark.createDataFrame([(3, 1.0), (3, 5.0), (4, 2.0), (None, 9.0)], "doc_id bigint, price double")
    limits = spark.createDataFrame([(1, 0.0), (2, 3.0), (2, 4.0)], "query_id bigint, least double")
    chosen = lx.scores(index, weights, goods, F.col("price") > F.col("least"), limits)
    joined = index.postings.join(goods, "doc_id").join(weights, "term").join(limits, "query_id").filter("price > least")
    expected = joined.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("q_weight")).alias("score"))
    one, two = ({(r.query_id, r.doc_id): pytest.approx(r.score) for r in df.collect()} for df in (chosen, expected))
    assert {k: v.expected for k, v in one.items()} == two and two


def test_eligible_pairs_are_shuffled_once(spark):
    docs = spark.createDataFrame([(i, f"red apple number{i % 7}") for i in range(40)], "doc_id bigint, text string")
    queries = spark.createDataFrame([(1, "red number3"), (2, "number1 number3")], "query_id bigint, text string")
    goods = spark.createDataFrame([(3, 1.0), (3, 1.0), (3, 5.0), (10, 2.0)], "doc_id bigint, price double")
    limits = spark.createDataFrame([(1, 0.0), (2, 3.0), (2, 4.0), (2, 4.0)], "query_id bigint, least double")
    index = lx.fit(docs, "doc_id", "text")
    weights = lx.query_vectors(queries, "query_id", "text", index.vocab)
    chosen = lx.scores(index, weights, goods, F.col("price") > F.col("least"), limits)
    joined = index.postings.join(goods, "doc_id").join(weights, "term").join(limits, "query_id").filter("price > least")
    expected = joined.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("q_weight")).alias("score"))
    one, two = ({(r.query_id, r.doc_id): round(r.score, 9) for r in df.collect()} for df in (chosen, expected))
    assert one == two and len(two) == 3
    # No pair is shuffled by its document and query before it goes to its block.
    plan = chosen._jdf.queryExecution().sparkPlan().toString()
    assert "keys=[doc_id" in plan and not [x for x in plan.splitlines() if "keys=[doc_id" in x and "query_id" in x]


def test_packs_of_a_bucket_are_merged_and_long_lists_cut(spark, monkeypatch):
    monkeypatch.setattr(lx, "ROWS_PER_BATCH", 3)
    packs = []
    for first in (0, 4):
        terms, term, row, tf = lx._runs(pa.array([["a", "b"], ["a"], ["a", "a"], ["c"] if first else None]))
        starts = np.append(np.flatnonzero(np.diff(term, prepend=-1)), len(term))
        packs.append(lx._packed(terms, term, pa.array(row + first), tf, starts, np.arange(len(terms))))
    got = pa.Table.from_batches(lx._merged(pa.array(packs, pa.binary()), 8, 2, 1.0)).to_pylist()
    assert [(r["term"], r["df"], r["first"], r["docs"], r["tfs"]) for r in got] == [
        ("a", 6, True, [0, 1, 2], [1, 1, 2]), ("a", 6, False, [4, 5, 6], [1, 1, 2]), ("b", 2, True, [0, 4], [1, 1]), ("a b", 2, True, [0, 4], [1, 1]),
        ("a a", 2, True, [2, 6], [1, 1]),
    ]


def test_postings_and_pairs_travel_as_arrays(spark):
    docs = spark.createDataFrame([(f"d{i}" if i else None, f"red apple number{i % 7} tree{i % 3}") for i in range(60)], "doc_id string, text string")
    queries = spark.createDataFrame([(1, "red number3"), (2, "tree1 apple")], "query_id bigint, text string")
    limits = spark.createDataFrame([(1, "d3"), (2, "d1"), (2, "d5")], "query_id bigint, least string")
    index = lx.fit(docs, "doc_id", "text")
    weights = lx.query_vectors(queries, "query_id", "text", index.vocab)
    chosen = lx.scores(index, weights, docs.select("doc_id"), F.col("doc_id") > F.col("least"), limits)
    joined = index.postings.join(weights, "term").join(limits, "query_id").filter("doc_id > least")
    expected = joined.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("q_weight")).alias("score"))
    one, two = ({(r.query_id, r.doc_id): round(r.score, 9) for r in df.collect()} for df in (chosen, expected))
    assert one == two and two
    # Postings, norms and pairs each become arrays before they are shuffled to their block.
    assert chosen._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 3


def test_ranks_of_lists_counts_ties_by_document(spark):
    rng = np.random.RandomState(11)
    rows = [(q, f"é{i}" if i % 3 else f"z{i}", [0.25, 0.123456785, 0.5, 0.123456784][rng.randint(4)] + rng.randint(2) * 1e-10) for q in range(3) for i in range(200)]
    scored = spark.createDataFrame([*rows, (1, None, 0.5)], "query_id bigint, doc_id string, score double").repartition(5)
    full = {(r.query_id, r.doc_id): (r["rank"], r.score) for r in lx.rank(scored).collect() if r.doc_id}
    lists = lx.listed_scores(scored)
    wanted = scored.filter("doc_id like '%7%'").select("query_id", "doc_id")
    wanted = wanted.union(wanted.limit(3)).union(spark.createDataFrame([(0, "none"), (7, "z3")], "query_id bigint, doc_id string"))
    plan = lx.ranks_of(scored, wanted)
    for got in (plan, lx.ranks_of(lists, wanted)):
        assert sorted((r.query_id, r.doc_id, r["rank"], r.score) for r in got.collect()) == sorted((q, d, *v) for (q, d), v in full.items() if "7" in d)
    # Scored pairs meet the wanted ones as lists, never one by one.
    assert "MapInArrow" in plan._jdf.queryExecution().executedPlan().toString()
    top = {(r.query_id, r.doc_id): r["rank"] for r in lx.top_k(lx.first_of(lists, 6), 6).collect()}
    assert top == {(r.query_id, r.doc_id): r["rank"] for r in lx.top_k(scored, 6).collect()}


def test_scores_are_rounded_as_spark_rounds_them(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.random(500), (rng.integers(0, 10**8, 500) + 0.5) / 1e8, rng.integers(0, 10**8, 100) / 1e8])
    got = spark.createDataFrame(pd.DataFrame({"x": values})).select("x", F.round("x", 8).alias("r")).toPandas()
    assert (lx._rounded(got["x"].to_numpy()) == got["r"].to_numpy()).all()


def test_a_term_has_one_hash_wherever_it_is_counted():
    texts = [["a", "b", "a", "b"], None, [], ["b", "a"], ["c", "a", "b"]]
    seen = {}
    for lists in (texts, texts[::-1], [["b"], ["a", "b", "c"]]):
        terms, term, row, tf, hashed = lx._hashed_runs(pa.array(lists, pa.list_(pa.string())))
        terms = terms.to_pylist()
        grams = [(" ".join(w[i : i + n]), r) for r, w in enumerate(lists) if w for n in (1, 2) for i in range(len(w) - n + 1)]
        assert {(terms[t], r): f for t, r, f in zip(term, row, tf.tolist())} == {g: grams.count(g) for g in grams}
        for t, h in zip(terms, hashed.tolist()):
            assert seen.setdefault(t, h) == h
    assert len(set(seen.values())) == len(seen)
