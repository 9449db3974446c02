"""Ranking evaluation, labels, splits and extraction scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from merchlens.functions import stats as st
from merchlens.operators import constraints as cs
from merchlens.operators import evaluation as ev
from merchlens.operators import fusion as fu
from merchlens.operators import labels as lb
from merchlens.operators import querylog as ql
from merchlens.operators import scoring as sc
from merchlens.operators import splits as sp
from merchlens.plans.derived import load
from merchlens.plans.registry import query
from merchlens.plans.querylog_queries import _LOGX, _SOFTX
from merchlens.session import cut_lineage
from merchlens.plans.search_queries import RUNS_CTE, external_scores, frozen_candidates, frozen_runs

KS = [3, 5, 10]
_GAIN = "(pow(2.0, {0}) - 1) / log2({1} + 1)"
# F03 on the stand-in columns.
_LOOSE = """(f_category IS NULL OR contains(lower(category), lower(f_category))) AND (f_brand IS NULL OR lower(brand) = lower(f_brand)) AND coalesce(price >= f_min_price, true)
  AND coalesce(price <= f_max_price, true) AND (f_min_rating IS NULL OR coalesce(rating >= f_min_rating, false))"""
EVAL_CTE = f"""{RUNS_CTE}, qr AS MATERIALIZED (SELECT DISTINCT query_id, doc_id, 2*quality + (1-toxic) AS grade FROM runs JOIN labels USING (doc_id)),
 sat AS MATERIALIZED (SELECT r.query_id, r.method, r.doc_id, r.rank, {_LOOSE} AS satisfied FROM runs r JOIN qs USING (query_id) JOIN prods p ON p.doc_id = r.doc_id),
 ks AS (SELECT unnest([3,5,10]) AS k),
 idl AS (SELECT query_id, k, sum({_GAIN.format('grade', 'pos')}) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS pos FROM qr), ks WHERE pos <= k GROUP BY 1,2),
 relp AS (SELECT query_id, count(*) FILTER (grade >= 2) AS pool_relevant FROM qr GROUP BY 1),
 per AS (SELECT s.method, s.query_id, k, count(*) AS returned, count(grade) AS judged, count(*) FILTER (grade >= 2) AS relevant, min(CASE WHEN grade >= 2 THEN rank END) AS first_relevant,
   coalesce(sum(CASE WHEN grade > 0 THEN {_GAIN.format('grade', 'rank')} END), 0) AS dcg, count(*) FILTER (NOT satisfied) AS violations
   FROM sat s LEFT JOIN qr USING (query_id, doc_id), ks WHERE rank <= k GROUP BY 1,2,3),
 cm AS MATERIALIZED (SELECT method, query_id, k, returned, judged, relevant, cast(first_relevant AS INT) AS first_relevant, round(judged*1.0/returned,6) AS coverage, round(relevant*1.0/nullif(judged,0),6) AS precision_judged,
   round(relevant*1.0/k,6) AS precision_conservative, round(coalesce(1.0/first_relevant,0),6) AS reciprocal_rank, round(dcg,6) AS dcg, round(coalesce(idcg,0),6) AS idcg,
   round(CASE WHEN coalesce(idcg,0) > 0 THEN dcg/idcg ELSE 0 END,6) AS ndcg, round(relevant*1.0/nullif(coalesce(pool_relevant,0),0),6) AS pool_recall, round(1 - violations*1.0/returned,6) AS satisfaction
   FROM per LEFT JOIN idl USING (query_id, k) LEFT JOIN relp USING (query_id))"""


def _grades(spark, d):
    runs = frozen_runs(spark, d).select("query_id", "doc_id").distinct()
    labels = load(spark, d, "labels").select("doc_id", (2 * F.col("quality") + (1 - F.col("toxic"))).alias("grade"))
    return runs.join(labels, "doc_id")


def _checked_runs(spark, d):
    """Runs with catalog attributes and query constraints."""
    products = load(spark, d, "doc_products").drop("text")
    queries = load(spark, d, "search_queries").drop("text", "embedding")
    rows = frozen_runs(spark, d).join(products, "doc_id", "left").join(queries, "query_id", "left")
    names = ("category", "brand", "price", "rating", "f_category", "f_brand", "f_min_price", "f_max_price", "f_min_rating")
    ok = cs.satisfies_loosely(**{n: F.col(n) for n in names})
    return rows.select("query_id", "method", "doc_id", "rank", ok.alias("satisfied"))


def _cutoffs(spark, d):
    return ev.cutoff_metrics(_checked_runs(spark, d), _grades(spark, d), KS)


@query("cutoff_metrics", f"{EVAL_CTE} SELECT * FROM cm")
def cutoff_metrics(spark, d):
    """E01-E03, F03, J02, J03, W06, W07."""
    return _cutoffs(spark, d)


@query(
    "metrics_by_method",
    f"""{EVAL_CTE} SELECT method, k, count(*) AS queries, cast(sum(returned) AS BIGINT) AS total_returned, cast(sum(judged) AS BIGINT) AS total_judged, round(sum(judged)*1.0/sum(returned),6) AS coverage,
        {', '.join(f"{st.exact_mean_sql(f'sum({st.units_sql(m)})', f'count({m})', 4)} AS mean_{m}" for m in ev.METRICS)} FROM cm GROUP BY 1,2""",
)
def metrics_by_method(spark, d):
    """A20."""
    return ev.aggregate_metrics(_cutoffs(spark, d), ["method", "k"], digits=4)


_QGROUP = "'g' || cast(item_id % 12 AS string)"


def _split_cte(rows: str, group: str, name: str = "spl") -> str:
    return f"""{name} AS (SELECT intent_group, size, CASE WHEN coalesce(before,0) < (SELECT greatest(1, round_even(count(*)*0.2,0)) FROM {rows}) THEN 'held_out' ELSE 'development' END AS "partition" FROM (
      SELECT *, sum(size) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
        SELECT intent_group, count(*) AS size, sha256('{{"intent_group":"' || intent_group || '","seed":13013}}') AS h FROM (SELECT {group} AS intent_group FROM {rows}) GROUP BY intent_group)))"""


def _query_split(spark, d):
    queries = load(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.concat(F.lit("g"), (F.col("item_id") % 12).cast("string")).alias("intent_group")
    )
    return queries.join(sp.grouped_split(queries), "intent_group").select("query_id", "intent_group", "partition")


_BYPART = f"""{EVAL_CTE}, {_split_cte('benchmark', _QGROUP)}, qp AS (SELECT item_id AS query_id, "partition" FROM benchmark JOIN spl ON spl.intent_group = {_QGROUP}),
 agg AS (SELECT method, "partition", k, count(*) AS queries, {st.exact_mean_sql('sum(' + st.units_sql('ndcg') + ')', 'count(ndcg)')} AS mean_ndcg, {st.exact_mean_sql('sum(' + st.units_sql('reciprocal_rank') + ')', 'count(reciprocal_rank)')} AS mean_reciprocal_rank FROM cm JOIN qp USING (query_id) GROUP BY 1,2,3)"""


@query("metrics_by_partition", f"{_BYPART} SELECT * FROM agg")
def metrics_by_partition(spark, d):
    """A20 with E21 partitions."""
    rows = _cutoffs(spark, d).join(_query_split(spark, d), "query_id")
    out = ev.aggregate_metrics(rows, ["method", "partition", "k"])
    return out.select("method", "partition", "k", "queries", "mean_ndcg", "mean_reciprocal_rank")


@query(
    "held_out_gap",
    f"""{_BYPART} SELECT method, k, max(CASE WHEN "partition"='development' THEN mean_ndcg END) AS development, max(CASE WHEN "partition"='held_out' THEN mean_ndcg END) AS held_out,
        round(max(CASE WHEN "partition"='development' THEN mean_ndcg END) - max(CASE WHEN "partition"='held_out' THEN mean_ndcg END),6) AS gap FROM agg GROUP BY 1,2""",
)
def held_out_gap(spark, d):
    """E08."""
    return ev.partition_gap(metrics_by_partition(spark, d), ["method", "k"], "partition", "mean_ndcg")


@query(
    "judged_only_metrics",
    f"""{EVAL_CTE}, j AS (SELECT method, query_id, rank, grade, row_number() OVER (PARTITION BY method, query_id ORDER BY rank) AS pos, row_number() OVER (PARTITION BY method, query_id ORDER BY grade DESC, rank) AS best
          FROM runs JOIN qr USING (query_id, doc_id) WHERE rank <= 5)
        SELECT method, query_id, returned, coalesce(judged,0) AS judged, "precision", mrr, ndcg, violation_rate FROM (SELECT method, query_id, count(*) AS returned FROM runs WHERE rank <= 5 GROUP BY 1,2)
        LEFT JOIN (SELECT method, query_id, count(*) AS judged, round(avg(CASE WHEN grade>=2 THEN 1.0 ELSE 0 END),6) AS "precision", round(coalesce(1.0/min(CASE WHEN grade>=2 THEN pos END),0),6) AS mrr,
          round(coalesce(sum({_GAIN.format('grade', 'pos')})/nullif(sum({_GAIN.format('grade', 'best')}),0),0),6) AS ndcg, round(avg(CASE WHEN grade<2 THEN 1.0 ELSE 0 END),6) AS violation_rate FROM j GROUP BY 1,2) USING (method, query_id)""",
)
def judged_only_metrics(spark, d):
    """E04."""
    return ev.judged_only(frozen_runs(spark, d), _grades(spark, d), 5)


@query(
    "unjudged_as_zero",
    f"""{EVAL_CTE} SELECT method, query_id, round(coalesce(sum({_GAIN.format('g', 'rank')})/nullif(sum({_GAIN.format('g', 'best')}),0),0),6) AS ndcg, round(coalesce(1.0/min(CASE WHEN g>=2 THEN rank END),0),6) AS mrr,
        round(count(*) FILTER (g>=2)/5.0,6) AS "precision" FROM (SELECT *, row_number() OVER (PARTITION BY method, query_id ORDER BY g DESC, rank) AS best FROM (SELECT method, query_id, rank, coalesce(grade,0) AS g FROM runs LEFT JOIN qr USING (query_id, doc_id) WHERE rank <= 5)) GROUP BY 1,2""",
)
def unjudged_as_zero(spark, d):
    """E05."""
    return ev.unjudged_as_zero(frozen_runs(spark, d), _grades(spark, d), 5)


def _boot_sql(values: str, by: str, seed: int, samples: int, lo: int, hi: int) -> str:
    step = " + ".join(f"CASE WHEN h >= {limit} THEN 1 ELSE 0 END" for limit in ev.POISSON_LIMITS)
    rows = f"SELECT {by}, key, {st.units_sql('v')} AS v FROM ({values}) WHERE v IS NOT NULL"
    drawn = f"""SELECT {by}, r, v, ('0x' || substr(sha256('{seed}:' || (r // {ev.DRAWS}) || ':' || key), 8 * (r % {ev.DRAWS}) + 1, 8))::BIGINT AS h
      FROM (SELECT *, unnest(range(0, {samples})) AS r FROM ({rows}))"""
    return f"""SELECT {by}, mean, n, CASE WHEN n = 1 THEN mean ELSE ms[least({lo}, len(ms)-1)+1] END AS ci_lower, CASE WHEN n = 1 THEN mean ELSE ms[least({hi}, len(ms)-1)+1] END AS ci_upper
      FROM (SELECT {by}, {st.exact_mean_sql('sum(v)', 'count(*)')} AS mean, count(*) AS n FROM ({rows}) GROUP BY {by})
      JOIN (SELECT {by}, list_sort(list(m)) AS ms FROM (SELECT {by}, r, {st.exact_mean_sql('sum(w * v)', 'sum(w)')} AS m FROM (
        SELECT {by}, r, v, {step} AS w FROM ({drawn})) GROUP BY {by}, r) WHERE m IS NOT NULL GROUP BY {by}) USING ({by})"""


@query(
    "bootstrap_ndcg",
    f"{EVAL_CTE}, bv AS (SELECT method, cast(query_id AS string) AS key, ndcg AS v FROM cm WHERE k = 5) {_boot_sql('SELECT * FROM bv', 'method', 14014, 1000, 25, 975)}",
)
def bootstrap_ndcg(spark, d):
    """E06."""
    return ev.bootstrap(_cutoffs(spark, d).filter("k = 5"), ["method"], "query_id", "ndcg")


@query(
    "paired_bootstrap",
    f"""{EVAL_CTE}, five AS (SELECT * FROM cm WHERE k = 5), pv AS (SELECT 'tfidf>dense' AS pair, cast(query_id AS string) AS key, coalesce(b.ndcg,0) - coalesce(a.ndcg,0) AS v FROM (SELECT DISTINCT query_id FROM runs)
          LEFT JOIN (SELECT * FROM five WHERE method='tfidf') a USING (query_id) LEFT JOIN (SELECT * FROM five WHERE method='dense') b USING (query_id)),
        pb AS ({_boot_sql('SELECT * FROM pv', 'pair', 82, 2000, 50, 1949)})
        SELECT pair, n, ci_lower, ci_upper, round((SELECT avg(v) FROM pv),6) AS effect, (SELECT count(*) FROM pv WHERE v>0) AS wins, (SELECT count(*) FROM pv WHERE v<0) AS losses, (SELECT count(*) FROM pv WHERE v=0) AS ties FROM pb""",
)
def paired_bootstrap(spark, d):
    """A system without a result for a captured query scores 0 there."""
    five = _cutoffs(spark, d).filter("k = 5")
    cases = frozen_runs(spark, d).select("query_id").distinct()

    def system(name):
        own = five.filter(F.col("method") == name).select("query_id", "ndcg")
        return cases.join(own, "query_id", "left").fillna(0.0, ["ndcg"])

    deltas = sc.paired_outcomes(system("tfidf"), system("dense"), "query_id", "ndcg")
    tagged = deltas.withColumn("pair", F.lit("tfidf>dense"))
    boot = ev.bootstrap(tagged, ["pair"], "query_id", "delta", samples=2000, seed=82, upper_shift=1)
    return boot.drop("mean").join(sc.win_loss(deltas))


@query(
    "unmatched_cases",
    f"""{RUNS_CTE}, t AS (SELECT DISTINCT query_id FROM runs WHERE method='tfidf'), e AS (SELECT DISTINCT query_id FROM runs WHERE method='dense')
        SELECT query_id, 'left' AS side FROM t WHERE query_id NOT IN (SELECT query_id FROM e) UNION ALL SELECT query_id, 'right' FROM e WHERE query_id NOT IN (SELECT query_id FROM t)""",
)
def unmatched_cases(spark, d):
    """Queries that only the lexical or only the dense runs answer."""
    runs = frozen_runs(spark, d)
    return sc.unmatched_cases(runs.filter("method = 'tfidf'"), runs.filter("method = 'dense'"), "query_id")


_RRX = """SELECT query_id, doc_id, rank, score, coalesce((dm - dense_rank + 1)*1.0/dm, 0)/2 + coalesce((lm - lexical_rank + 1)*1.0/lm, 0)/2 AS ms
  FROM (SELECT *, max(dense_rank) OVER (PARTITION BY query_id) AS dm, max(lexical_rank) OVER (PARTITION BY query_id) AS lm FROM hyb)"""


@query(
    "reranker_comparison",
    f"""{EVAL_CTE}, sg AS (SELECT r.*, (length(b.text) % 97) * 1.0 / 97 + (p.price % 31) / 31.0 AS s FROM ({_RRX}) r JOIN benchmark b ON b.item_id = r.query_id JOIN prods p ON p.doc_id = r.doc_id),
        mx AS (SELECT *, CASE WHEN max(s) OVER w - min(s) OVER w <= 1e-12 THEN 0.5 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END AS mm FROM sg WINDOW w AS (PARTITION BY query_id)),
        rr AS MATERIALIZED (SELECT method, query_id, doc_id, rank, row_number() OVER (PARTITION BY method, query_id ORDER BY round(v,8) DESC, rank, doc_id) AS nr FROM (
          SELECT *, unnest(['multi_signal','rrf','pair','combined']) AS method, unnest([ms, score, mm, 0.7*mm + 0.3*ms]) AS v FROM mx)),
        pr AS (SELECT method, query_id, coalesce(sum(CASE WHEN grade > 0 THEN {_GAIN.format('grade', 'nr')} END),0) AS dcg, min(CASE WHEN grade>=2 THEN nr END) AS fr FROM rr LEFT JOIN qr USING (query_id, doc_id) WHERE nr <= 5 GROUP BY 1,2)
        SELECT method, count(*) AS queries, {st.exact_mean_sql('sum(' + st.units_sql('CASE WHEN coalesce(idcg,0)>0 THEN dcg/idcg ELSE 0 END') + ')', 'count(*)')} AS mean_ndcg, {st.exact_mean_sql('sum(' + st.units_sql('coalesce(1.0/fr,0)') + ')', 'count(*)')} AS mean_reciprocal_rank, any_value(shift) AS mean_shift
        FROM pr LEFT JOIN (SELECT * FROM idl WHERE k=5) USING (query_id) JOIN (SELECT method, round(sum(abs(nr - rank))*1.0/count(*),6) AS shift FROM rr GROUP BY 1) USING (method) GROUP BY 1""",
)
def reranker_comparison(spark, d):
    """Four rankers over the same frozen candidates, with how far each moves them."""
    cands = frozen_candidates(spark, d)
    scores = external_scores(spark, d)
    ranked = {
        "multi_signal": fu.multi_signal(cands), "rrf": fu.rrf_passthrough(cands), "pair": fu.pair_scores(cands, scores),
        "combined": fu.pair_scores(cands, scores, 0.7, 0.3),
    }
    runs = None
    for name, scored in ranked.items():
        part = fu.rerank(scored).select("query_id", F.lit(name).alias("method"), "doc_id", F.col("rank").alias("before"), F.col("new_rank").alias("rank"))
        runs = part if runs is None else runs.unionByName(part)
    shift = runs.groupBy("method").agg(F.round(F.sum(F.abs(F.col("rank") - F.col("before"))) / F.count(F.lit(1)), 6).alias("mean_shift"))
    per = ev.cutoff_metrics(runs.drop("before"), _grades(spark, d), [5])
    out = ev.aggregate_metrics(per, ["method"]).select("method", "queries", "mean_ndcg", "mean_reciprocal_rank")
    return out.join(shift, "method")


def _kappa_sql(rows: str, by: str) -> str:
    return f"""SELECT {by}, count(*) AS pairs, round(avg(CASE WHEN a=b THEN 1.0 ELSE 0 END),6) AS exact_agreement,
      round(CASE WHEN count(*) >= 2 AND avg(a*a)+avg(b*b)-2*avg(a)*avg(b) > 1e-12 THEN 1 - avg((a-b)*(a-b)) / (avg(a*a)+avg(b*b)-2*avg(a)*avg(b)) END,6) AS kappa FROM ({rows}) GROUP BY {by}"""


_LD = "SELECT quality AS a, toxic AS b, lang, source FROM labels JOIN documents USING (doc_id)"


@query(
    "kappa_by_group",
    _kappa_sql(f"SELECT a, b, unnest(['overall','lang','source']) AS stratum, unnest(['all',lang,source]) AS value FROM ({_LD})", "stratum, value"),
)
def kappa_by_group(spark, d):
    """E09, A19."""
    rows = load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return ev.agreement_by(rows.withColumnsRenamed({"quality": "a", "toxic": "b"}), "a", "b", ["lang", "source"])


@query("label_comparison", "SELECT quality AS a, toxic AS b, count(*) AS pairs FROM labels GROUP BY 1,2")
def label_comparison(spark, d):
    """E10, J01."""
    labels = load(spark, d, "labels")
    return ev.compare_labels(
        labels.select("doc_id", F.col("quality").alias("grade")), labels.select("doc_id", F.col("toxic").alias("grade")), ["doc_id"]
    )


# ------------------------------------------------------------------- pools, labels
_POOL = f"""{EVAL_CTE}, pool AS MATERIALIZED (SELECT query_id, doc_id, min(rank) AS best_rank, count(*) AS methods, array_to_string(list_sort(list(method)),'|') AS membership FROM runs GROUP BY 1,2)"""


@query(
    "candidate_pool",
    f"{_POOL} SELECT query_id, doc_id, cast(best_rank AS INT) AS best_rank, membership, cast(row_number() OVER (PARTITION BY query_id ORDER BY best_rank, doc_id) AS INT) AS pool_position FROM pool",
)
def candidate_pool(spark, d):
    """E11, U01, W10."""
    pool = lb.candidate_pool(frozen_runs(spark, d), 20)
    return pool.select(
        "query_id", "doc_id", "best_rank", F.array_join(F.transform("membership", lambda m: m["method"]), "|").alias("membership"),
        "pool_position",
    )


@query(
    "pool_cap",
    f"""{_POOL.replace('WITH ', 'WITH RECURSIVE ', 1)}, lists AS MATERIALIZED (SELECT query_id, method, l, row_number() OVER (PARTITION BY query_id ORDER BY method) - 1 AS mi, count(*) OVER (PARTITION BY query_id) AS nm
          FROM (SELECT query_id, method, list(doc_id ORDER BY rank, doc_id) AS l FROM runs WHERE rank <= 20 GROUP BY 1, 2)),
        pick AS (SELECT DISTINCT query_id, cast(-1 AS BIGINT) AS s, cast([] AS BIGINT[]) AS taken, cast(NULL AS BIGINT) AS doc_id, '' AS method FROM lists
          UNION ALL SELECT query_id, s, CASE WHEN d IS NULL THEN taken ELSE list_append(taken, d) END, d, method FROM (
            SELECT p.query_id, p.s + 1 AS s, taken, list_filter(l, lambda x: NOT list_contains(p.taken, x))[1] AS d, l.method FROM pick p JOIN lists l ON l.query_id = p.query_id AND l.mi = (p.s + 1) % l.nm WHERE p.s + 1 < 20 * l.nm))
        SELECT query_id, doc_id, cast(s // nm AS INT) AS round, method FROM pick JOIN (SELECT DISTINCT query_id, nm FROM lists) USING (query_id) WHERE doc_id IS NOT NULL ORDER BY s // nm, cast(query_id AS string), method LIMIT 500""",
)
def pool_cap(spark, d):
    """At most 500 judged pairs over all queries."""
    return lb.cap_pool(lb.candidate_pool(frozen_runs(spark, d), 20), 500)


@query(
    "blind_tasks",
    f"""{_POOL}, h AS (SELECT query_id, doc_id, row_number() OVER (ORDER BY sha256(query_id || ':' || doc_id)) AS task_no FROM pool)
        SELECT query_id, doc_id, lang, source, n_chars, task_no, (task_no - 1) // 50 AS batch_no FROM h JOIN documents USING (doc_id)""",
)
def blind_tasks(spark, d):
    """E13, K05, W01 in global hash order."""
    docs = load(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    pool = lb.candidate_pool(frozen_runs(spark, d), 20).join(docs, "doc_id")
    return lb.blind_tasks(pool, ["query_id", "doc_id", "lang", "source", "n_chars"], 50)


_FLAGS_SQL = """coalesce(lower(p.category) <> lower(f_category), false) AS category_violation, coalesce(lower(p.brand) <> lower(f_brand), false) AS brand_violation,
 coalesce(CASE WHEN f_min_inclusive THEN p.price < f_min_price ELSE p.price <= f_min_price END, false) OR coalesce(CASE WHEN f_max_inclusive THEN p.price > f_max_price ELSE p.price >= f_max_price END, false) AS price_violation,
 coalesce(p.rating < f_min_rating, false) AS rating_violation, false AS other_violation, CASE WHEN f_min_rating IS NOT NULL AND p.rating IS NULL THEN 'rating' ELSE '' END AS missing_evidence"""
_FLAGGED = f"{_POOL}, fl AS MATERIALIZED (SELECT o.query_id, o.doc_id, {_FLAGS_SQL} FROM pool o JOIN qs USING (query_id) JOIN prods p ON p.doc_id = o.doc_id)"


def _flagged(spark, d):
    products = load(spark, d, "doc_products")
    queries = load(spark, d, "search_queries").drop("embedding").withColumnRenamed("text", "q_text")
    pool = lb.candidate_pool(frozen_runs(spark, d), 20).select("query_id", "doc_id", "fingerprint")
    rows = pool.join(products, "doc_id").join(queries, "query_id")
    names = ("category", "brand", "price", "rating", "f_category", "f_brand", "f_min_price", "f_max_price", "f_min_rating")
    flags = cs.violation_flags(
        **{n: F.col(n) for n in names},
        f_min_operator=F.when(F.col("f_min_inclusive"), ">=").otherwise(">"),
        f_max_operator=F.when(F.col("f_max_inclusive"), "<=").otherwise("<"),
        currency=F.lit("INR"),
    )
    return rows.withColumns(flags)


@query("violation_flags", f"{_FLAGGED} SELECT * FROM fl")
def violation_flags(spark, d):
    """E14."""
    return _flagged(spark, d).select(
        "query_id", "doc_id", *lb.FLAGS, F.array_join("missing_evidence", "|").alias("missing_evidence")
    )


_CORE = "list_filter(regexp_split_to_array(lower(b.text), '[^\\p{L}\\p{N}_]+'), lambda w: length(w) > 3 AND w NOT IN ('under','above','rating','with','from','black','white'))"


def _pw(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({expr}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 2 AND w NOT IN ('for','and','the','with'))"


_P1, _P2 = "string_split(b.text,' ')[1] || ' ' || string_split(b.text,' ')[2]", "string_split(b.text,' ')[3]"
_JUDGES = f"""{_FLAGGED}, jb AS MATERIALIZED (SELECT fl.*, {_CORE} AS core, {_pw(_P1)} AS w1, {_pw(_P2)} AS w2, lower(d.source || ' ' || d.lang || ' ' || d.text) AS body FROM fl JOIN benchmark b ON b.item_id = query_id JOIN documents d USING (doc_id)),
 jr AS (SELECT *, len(list_filter(core, lambda w: contains(body, w))) * 1.0 / greatest(1, len(core)) AS ratio,
   len(list_filter(w1, lambda w: contains(body, w))) AS h1, len(list_filter(w2, lambda w: contains(body, w))) AS h2 FROM jb),
 jd AS MATERIALIZED (SELECT query_id, doc_id, category_violation, brand_violation, price_violation, rating_violation,
   CASE WHEN category_violation THEN 0 WHEN price_violation OR brand_violation OR rating_violation THEN 1 WHEN ratio < 0.3 THEN 1 WHEN h1 = len(w1) AND h2 = len(w2) AND ratio >= 0.7 THEN 3 ELSE 2 END AS grade_a,
   CASE WHEN category_violation THEN 0 WHEN price_violation OR brand_violation OR rating_violation THEN 1 WHEN ratio < 0.35 THEN 1 WHEN (len(w1) = 0 OR h1 > 0) AND (len(w2) = 0 OR h2 > 0) AND ratio >= 0.65 THEN 3 ELSE 2 END AS grade_b FROM jr)"""


def _judged(spark, d):
    rows = _flagged(spark, d)
    words = F.split("q_text", " ")
    prefs = F.array(F.concat_ws(" ", F.get(words, 0), F.get(words, 1)), F.get(words, 2))
    flags = {f: F.col(f) for f in lb.FLAGS}
    out = rows
    for slot, rule, every in (("a", lb.JUDGE_A, True), ("b", lb.JUDGE_B, False)):
        out = out.withColumn(
            f"judge_{slot}",
            lb.judge(
                query=F.col("q_text"), semantic=F.col("q_text"), preferences=prefs, name=F.col("brand"),
                specs=F.col("category"), text=F.col("text"), flags=flags, need_every_keyword=every, **rule,
            ),
        )
    keep = ["query_id", "doc_id", "fingerprint", *lb.FLAGS]
    return out.select(
        *keep, F.col("judge_a.grade").alias("grade_a"), F.col("judge_b.grade").alias("grade_b"),
        F.col("judge_a.other_violation").alias("other_a"), F.col("judge_b.other_violation").alias("other_b"),
    )


# What reviews and decisions assert beyond the rules, by id.
_ASSERTED = {
    "a": {"price_violation": "doc_id % 7 = 1"},
    "b": {"brand_violation": "doc_id % 11 = 2"},
    "decision": {"rating_violation": "doc_id % 5 = 3"},
}


def _side(rows, slot):
    said = [F.expr(c).alias(f) for f, c in _ASSERTED[slot].items()]
    grade, other = F.col(f"grade_{slot}").alias("grade"), F.col(f"other_{slot}").alias("other_violation")
    return rows.select("query_id", "doc_id", grade, other, *said)


@query("rule_judges", f"{_JUDGES} SELECT query_id, doc_id, grade_a, grade_b FROM jd")
def rule_judges(spark, d):
    """E16."""
    return _judged(spark, d).select("query_id", "doc_id", "grade_a", "grade_b")


@query("disagreement_tasks", f"{_JUDGES} SELECT query_id, doc_id, grade_a, grade_b FROM jd WHERE grade_a <> grade_b")
def disagreement_tasks(spark, d):
    """E18, J16."""
    rows = _judged(spark, d)
    return lb.disagreement_tasks(_side(rows, "a"), _side(rows, "b"))


_ADJ = f"""{_JUDGES}, ad AS MATERIALIZED (SELECT query_id, doc_id, grade_a, grade_b, category_violation, bv AS brand_violation, pv AS price_violation, rv AS rating_violation,
   CASE WHEN raw >= 2 AND violated THEN 1 ELSE raw END AS final_grade, coalesce(raw >= 2 AND violated, false) AS constraint_override,
   CASE WHEN raw IS NULL THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS resolution, CASE WHEN grade_a = grade_b THEN 'AGREEMENT' WHEN raw IS NOT NULL THEN 'ADJUDICATION' END AS label_source
   FROM (SELECT *, category_violation OR bv OR pv OR rv AS violated FROM (
     SELECT *, CASE WHEN grade_a = grade_b THEN grade_a WHEN doc_id % 3 > 0 THEN least(grade_a, grade_b) END AS raw, brand_violation OR doc_id % 11 = 2 AS bv, price_violation OR doc_id % 7 = 1 AS pv,
       rating_violation OR (grade_a <> grade_b AND doc_id % 3 > 0 AND doc_id % 5 = 3) AS rv FROM jd)))"""


def _adjudicated(spark, d):
    rows = _judged(spark, d)
    decisions = rows.select(
        "query_id", "doc_id",
        F.when(F.col("doc_id") % 3 > 0, F.least("grade_a", "grade_b")).alias("decision"),
        *[F.expr(c).alias(f) for f, c in _ASSERTED["decision"].items()],
    )
    return lb.adjudicate(_side(rows, "a"), _side(rows, "b"), rows, decisions)


@query("adjudicate", f"{_ADJ} SELECT * FROM ad")
def adjudicate(spark, d):
    """Two of three disagreements have a decision (the lower grade); reviews and decisions assert flags."""
    return _adjudicated(spark, d).select(
        "query_id", "doc_id", "grade_a", "grade_b", "final_grade", "constraint_override", "resolution", "label_source",
        "category_violation", "brand_violation", "price_violation", "rating_violation",
    )


@query("qrels", f"{_ADJ} SELECT query_id, doc_id, final_grade AS grade, label_source FROM ad WHERE resolution = 'RESOLVED'")
def qrels(spark, d):
    """E19."""
    return lb.qrels(_adjudicated(spark, d)).select("query_id", "doc_id", "grade", "label_source")


@query("judge_agreement", f"{_JUDGES} {_kappa_sql('SELECT *, grade_a AS a, grade_b AS b FROM jd JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)', 'lang')}")
def judge_agreement(spark, d):
    """E09 on the rule judges, per language."""
    rows = _judged(spark, d).join(load(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return ev.weighted_kappa(rows, "grade_a", "grade_b", ["lang"])


_REVIEWS = """SELECT l_orderkey AS query_id, l_partkey AS doc_id, cast(l_discount*50 AS INT) AS grade, l_returnflag = 'R' AS flag, l_tax * 20 AS confidence, l_linestatus AS ls FROM lineitem"""


@query(
    "review_validation",
    f"""SELECT query_id, doc_id, array_to_string(list_filter([CASE WHEN copies > 1 THEN 'DUPLICATE' END, CASE WHEN p.doc_id IS NULL THEN 'UNKNOWN_TASK' END,
          CASE WHEN copies = 1 AND grade NOT IN (0,1,2,3) THEN 'GRADE' END, CASE WHEN copies = 1 AND grade >= 2 AND flag THEN 'GRADE_CONFLICTS_WITH_VIOLATION' END, CASE WHEN copies = 1 AND confidence > 1 THEN 'CONFIDENCE' END,
          CASE WHEN copies = 1 AND ls = 'F' THEN 'STALE_FINGERPRINT' END], lambda x: x IS NOT NULL), '|') AS errors
        FROM (SELECT query_id, doc_id, count(*) AS copies, max(grade) AS grade, bool_or(flag) AS flag, max(confidence) AS confidence, max(ls) AS ls FROM ({_REVIEWS}) GROUP BY 1,2 HAVING count(*) = 1) r
        LEFT JOIN (SELECT p_partkey AS doc_id FROM part WHERE p_size < 45) p USING (doc_id) WHERE p.doc_id IS NOT NULL""",
)
def review_validation(spark, d):
    """One JSON review per line item against its task."""
    items = load(spark, d, "lineitem")
    fp = F.concat_ws(":", "l_orderkey", "l_partkey")
    payload = F.to_json(
        F.struct(
            F.round(F.col("l_discount") * 50).cast("int").alias("relevance_grade"),
            (F.col("l_returnflag") == "R").alias("category_violation"),
            *[F.lit(False).alias(f) for f in lb.FLAGS[1:]],
            (F.col("l_tax") * 20).alias("confidence"),
            F.when(F.col("l_linestatus") == "F", F.lit("old")).otherwise(fp).alias("task_fingerprint"),
        )
    )
    raw = items.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), payload.alias("payload"))
    known = load(spark, d, "part").filter("p_size < 45").select("p_partkey")
    tasks = (
        items.join(known, items["l_partkey"] == known["p_partkey"], "left_semi")
        .select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), fp.alias("fingerprint"))
        .distinct()
    )
    out = lb.import_reviews(tasks, raw)
    # Pairs reviewed once and known as tasks; the rest is counted in review_rejects.
    clean = out.filter(~F.array_contains("errors", "DUPLICATE") & ~F.array_contains("errors", "UNKNOWN_TASK"))
    return clean.select("query_id", "doc_id", F.array_join("errors", "|").alias("errors"))


@query(
    "review_rejects",
    """SELECT count(*) AS pairs, count(*) FILTER (copies > 1) AS duplicates, count(*) FILTER (p.p_partkey IS NULL) AS unknown_tasks FROM (SELECT l_orderkey, l_partkey, count(*) AS copies FROM lineitem GROUP BY 1,2) LEFT JOIN (SELECT p_partkey FROM part WHERE p_size < 45) p ON l_partkey = p_partkey""",
)
def review_rejects(spark, d):
    """E15 duplicates and unknown tasks, J05."""
    items = load(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("copies"))
    known = load(spark, d, "part").filter("p_size < 45").select("p_partkey")
    rows = items.join(known, items["l_partkey"] == known["p_partkey"], "left")
    return rows.agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("copies") > 1).alias("duplicates"),
        F.count_if(F.col("p_partkey").isNull()).alias("unknown_tasks"),
    )


@query(
    "reviewer_pairs",
    """SELECT l_orderkey, count(*) AS submissions, count(DISTINCT l_suppkey) AS reviewers, count(*) = 2 AND count(DISTINCT l_suppkey) = 2 AS paired,
       CASE WHEN count(*) = 2 AND count(DISTINCT l_suppkey) = 2 THEN first(l_returnflag ORDER BY cast(l_suppkey AS string)) END AS first, CASE WHEN count(*) = 2 AND count(DISTINCT l_suppkey) = 2 THEN last(l_returnflag ORDER BY cast(l_suppkey AS string)) END AS second FROM lineitem GROUP BY 1""",
)
def reviewer_pairs(spark, d):
    """Suppliers as reviewers of an order."""
    rows = load(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("string").alias("who"), "l_returnflag")
    return lb.reviewer_pairs(rows, ["l_orderkey"], "who", "l_returnflag")


@query(
    "ground_truth",
    """SELECT o_orderkey AS l_orderkey, CASE WHEN problem IS NULL THEN o_orderpriority END AS value, problem FROM (SELECT *, CASE WHEN NOT coalesce(n = 2 AND s = 2, false) THEN 'NEEDS_TWO_REVIEWERS' WHEN o_orderstatus = 'P' THEN 'NEEDS_DECISION' WHEN o_orderpriority = '5-LOW' THEN 'BAD_DECISION' END AS problem
       FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)""",
)
def ground_truth(spark, d):
    """Every order needs two reviewers and one signed decision."""
    orders = load(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    signed = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey").cast("string"))
    decisions = orders.filter("o_orderstatus <> 'P'").select("l_orderkey", F.col("o_orderpriority").alias("value"), signed.alias("adjudicator"))
    out = lb.assemble(orders, reviewer_pairs(spark, d), decisions, ["l_orderkey"])
    return out.select("l_orderkey", "value", "problem")


@query(
    "audited_snapshot",
    f"""SELECT query_id, CASE WHEN agree OR expected_status = 'SUCCESS' THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS resolution, agree AS exact_agreement,
        CASE WHEN agree THEN a_max WHEN expected_status = 'SUCCESS' THEN d_max END AS max_price, CASE WHEN agree THEN a_op WHEN expected_status = 'SUCCESS' THEN d_op END AS max_operator FROM (
        SELECT query_id, l.expected_status, x.max_price AS a_max, x.max_operator AS a_op, l.max_price AS d_max, l.max_operator AS d_op, x.max_price IS NOT DISTINCT FROM l.max_price AND x.max_operator IS NOT DISTINCT FROM l.max_operator AS agree FROM {{shopper_log}} l JOIN ({_LOGX}) x USING (query_id))""",
)
def audited_snapshot(spark, d):
    """Rule reading against the stored one, the stored one deciding where it is a SUCCESS."""
    log = load(spark, d, "shopper_log")
    first = ql.interpret(log).select("query_id", "max_price", "max_operator")
    second = log.select("query_id", "max_price", "max_operator")
    decisions = log.filter("expected_status = 'SUCCESS'").select("query_id", "max_price", "max_operator")
    return lb.audit_snapshot(log, first, second, decisions, ["max_price", "max_operator"])


# ------------------------------------------------------------------ splits, samples
_DGROUP = "lang || ':' || source || ':' || cast(n_chars // 500 AS string)"


def _docs_grouped(spark, d):
    return load(spark, d, "documents").withColumn(
        "intent_group", F.concat_ws(":", "lang", "source", F.floor(F.col("n_chars") / 500).cast("string"))
    )


@query("grouped_split", f"WITH {_split_cte('documents', _DGROUP)} SELECT * FROM spl")
def grouped_split(spark, d):
    """E21, W08."""
    return sp.grouped_split(_docs_grouped(spark, d))


@query(
    "split_problems",
    """SELECT query_id AS id, unnest(list_filter([CASE WHEN bool_or(coalesce(trim(g), '') = '') THEN 'NO_GROUP' END, CASE WHEN count(*) > 1 THEN 'REPEATED_ID' END], lambda x: x IS NOT NULL)) AS problem
       FROM (SELECT conv_id AS query_id, CASE role WHEN 'system' THEN ' ' ELSE role END AS g FROM conversations WHERE turn < 2) GROUP BY 1""",
)
def split_problems(spark, d):
    """Conversations as queries, first two turns as rows: some repeat an id, some have no group."""
    group = F.when(F.col("role") == "system", F.lit(" ")).otherwise(F.col("role"))
    rows = load(spark, d, "conversations").filter("turn < 2").select(F.col("conv_id").alias("query_id"), group.alias("g"))
    return sp.split_problems(rows, "query_id", "g")


@query(
    "split_leakage",
    f"""WITH {_split_cte('documents', _DGROUP)} SELECT sha256(lower(nfc_normalize(text))) AS text_key, count(*) AS copies, count(DISTINCT "partition") AS partitions FROM documents JOIN spl ON intent_group = {_DGROUP} GROUP BY 1 HAVING count(DISTINCT "partition") > 1""",
)
def split_leakage(spark, d):
    """E21 leakage checks."""
    docs = _docs_grouped(spark, d)
    return sp.split_leakage(docs, sp.grouped_split(docs), "text")


_SETS = "sets AS MATERIALIZED (SELECT min(doc_id) AS id, t FROM (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(nfc_normalize(text)), '[\\p{L}\\p{N}_]+'))) AS t FROM documents) GROUP BY t)"
_NEAR = f"{_SETS}, near AS MATERIALIZED (SELECT \"left\", \"right\", jaccard FROM (SELECT a.id AS \"left\", b.id AS \"right\", len(list_intersect(a.t,b.t))*1.0/(len(a.t)+len(b.t)-len(list_intersect(a.t,b.t))) AS jaccard FROM sets a JOIN sets b ON a.id < b.id AND len(a.t) >= 0.8*len(b.t) AND len(b.t) >= 0.8*len(a.t)) WHERE jaccard >= 0.8)"


@query("near_duplicates", f"WITH {_NEAR} SELECT \"left\", \"right\", round(jaccard,6) AS jaccard FROM near")
def near_duplicates(spark, d):
    """J10 over whole texts; copies are one set."""
    sets, _ = sp.token_sets(load(spark, d, "documents"), "doc_id", "text")
    return sp.near_duplicates(sets).withColumn("jaccard", F.round("jaccard", 6))


@query(
    "near_duplicate_groups",
    f"""WITH RECURSIVE {_NEAR}, link AS (SELECT "left" AS a, "right" AS b FROM near UNION ALL SELECT "right", "left" FROM near),
        reach AS (SELECT id, id AS r FROM sets UNION SELECT b, r FROM reach JOIN link ON a = id),
        member AS (SELECT id, min(r) AS group_id FROM reach GROUP BY id)
        SELECT id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size FROM member""",
)
def near_duplicate_groups(spark, d):
    """J10 in one row a set: the class of near duplicates it belongs to."""
    sets, _ = sp.token_sets(load(spark, d, "documents"), "doc_id", "text")
    return sp.near_duplicate_groups(sets)


@query(
    "duplicate_copies",
    f"WITH {_SETS} SELECT doc_id AS id, s.id AS rep FROM documents JOIN sets s ON s.t = list_sort(list_distinct(regexp_extract_all(lower(nfc_normalize(text)), '[\\p{{L}}\\p{{N}}_]+')))",
)
def duplicate_copies(spark, d):
    """J10 copies: each text with the smallest id of its token set."""
    _, copies = sp.token_sets(load(spark, d, "documents"), "doc_id", "text")
    return copies


def _components(spark, d):
    docs = _docs_grouped(spark, d)
    sets, copies = sp.token_sets(docs, "doc_id", "text")
    near = cut_lineage(sp.near_duplicate_links(sets))
    edge = F.concat_ws("-", F.lit("n"), "left", "right")
    members = (
        docs.select(F.col("doc_id").alias("node"), F.concat(F.lit("g"), "intent_group").alias("edge"))
        .unionByName(copies.select(F.col("id").alias("node"), F.concat(F.lit("c"), F.col("rep").cast("string")).alias("edge")))
        .unionByName(near.select(F.col("left").alias("node"), edge.alias("edge")))
        .unionByName(near.select(F.col("right").alias("node"), edge.alias("edge")))
    )
    return sp.components(docs.select(F.col("doc_id").alias("node")), members)


_COMP = f"""WITH RECURSIVE {_NEAR}, mem AS MATERIALIZED (SELECT doc_id AS node, 'g' || {_DGROUP} AS edge FROM documents UNION ALL SELECT doc_id, 'c' || s.id FROM documents JOIN sets s ON s.t = list_sort(list_distinct(regexp_extract_all(lower(nfc_normalize(text)), '[\\p{{L}}\\p{{N}}_]+')))
   UNION ALL SELECT "left", 'n' || "left" || '-' || "right" FROM near UNION ALL SELECT "right", 'n' || "left" || '-' || "right" FROM near),
 reach AS (SELECT node, node AS r FROM mem UNION SELECT b.node, reach.r FROM reach JOIN mem a ON a.node = reach.node JOIN mem b ON b.edge = a.edge WHERE b.node > reach.r OR true),
 comp AS (SELECT node, min(r) AS component FROM reach GROUP BY node)"""


@query("components", f"{_COMP} SELECT node, component FROM comp")
def components(spark, d):
    """E22 over intent groups, copies and near duplicates."""
    return _components(spark, d)


@query(
    "split_freeze_gate",
    f"""{_COMP}, {_split_cte('documents', _DGROUP)}, a AS (SELECT doc_id, "partition" FROM documents JOIN spl ON intent_group = {_DGROUP}),
        c AS (SELECT count(*) AS crossing FROM (SELECT component FROM comp JOIN a ON a.doc_id = node GROUP BY 1 HAVING count(DISTINCT "partition") > 1))
        SELECT (SELECT count(*) FROM documents) AS queries, 0 AS unassigned, 0 AS in_both, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unlabelled, crossing AS crossing_components,
          crossing = 0 AND (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) = 0 AS can_freeze FROM c""",
)
def split_freeze_gate(spark, d):
    """E37."""
    docs = _docs_grouped(spark, d).select(F.col("doc_id").alias("query_id"), "intent_group")
    assigned = docs.join(sp.grouped_split(docs), "intent_group").select("query_id", "partition")
    labels = load(spark, d, "labels").select(F.col("doc_id").alias("query_id"))
    return sp.freeze_gate(docs, assigned, _components(spark, d), labels)


@query(
    "stratum_balance",
    f"""WITH {_split_cte('documents', _DGROUP)} SELECT attribute, value, count(*) FILTER (p='development') AS development, count(*) FILTER (p='held_out') AS held_out, round(count(*) FILTER (p='held_out')*1.0/count(*),6) AS held_out_share
        FROM (SELECT "partition" AS p, unnest(['lang','source']) AS attribute, unnest([lang, source]) AS value FROM documents JOIN spl ON intent_group = {_DGROUP}) GROUP BY 1,2""",
)
def stratum_balance(spark, d):
    """E23."""
    docs = _docs_grouped(spark, d)
    return sp.stratum_balance(docs.join(sp.grouped_split(docs), "intent_group"), "partition", ["lang", "source"])


@query(
    "stratified_sample",
    "SELECT doc_id, lang, source, cast(pick AS INT) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('13013:' || doc_id), doc_id) AS pick FROM documents) WHERE pick <= 3",
)
def stratified_sample(spark, d):
    """W09, E24."""
    docs = load(spark, d, "documents").select("doc_id", "lang", "source")
    return sp.per_stratum_sample(docs, ["lang", "source"], "doc_id", 3)


@query(
    "coverage_sample",
    """SELECT doc_id, array_to_string(list_sort(list(bucket)),'|') AS buckets FROM (
        SELECT doc_id, 'longest' AS bucket FROM (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5) UNION ALL SELECT doc_id, 'shortest' FROM (SELECT doc_id FROM documents ORDER BY n_chars, doc_id LIMIT 5)
        UNION ALL SELECT doc_id, 'toxic' FROM (SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 ORDER BY n_chars, doc_id LIMIT 5) UNION ALL SELECT doc_id, 'french' FROM (SELECT doc_id FROM documents WHERE lang='fr' ORDER BY n_chars, doc_id LIMIT 5)) GROUP BY 1""",
)
def coverage_sample(spark, d):
    """A representative sample with five rows per bucket."""
    rows = load(spark, d, "documents").drop("text").join(load(spark, d, "labels"), "doc_id", "left")
    n = F.col("n_chars")
    return sp.coverage_sample(
        rows, "doc_id",
        {
            "longest": (F.lit(True), F.desc("n_chars")), "shortest": (F.lit(True), n.asc()),
            "toxic": (F.col("toxic") == 1, n.asc()), "french": (F.col("lang") == "fr", n.asc()),
        },
        5,
    )


# ------------------------------------------------------------------------ extraction
def _case_scores(spark, d):
    log = load(spark, d, "shopper_log")
    actual = ql.interpret(log)
    hard = [F.col(f).cast("string").alias(f) for f in sc.HARD_FIELDS]
    a = actual.select("query_id", F.struct(*hard, "soft_preferences").alias("actual"))
    e = log.withColumn("soft_preferences", F.split("prefs", r"\|")).select(
        F.col("query_id").alias("case_id"), "query_type", "language",
        (F.col("expected_status") == "SUCCESS").alias("valid"),
        F.struct(*hard, "soft_preferences").alias("expected"),
    )
    return sc.score_cases(e.join(a, e["case_id"] == a["query_id"]).drop("query_id"))


def _atom(f, col):
    return f"CASE WHEN {col} IS NOT NULL THEN '{f}=' || trim(regexp_replace(lower({col}),'\\s+',' ','g')) END"


def _atoms(cols):
    return "list_filter([" + ", ".join(_atom(f, c) for f, c in cols.items()) + "], lambda x: x IS NOT NULL)"


# Spark prints doubles as 100.0; so does the checking engine.
_EXP = {"category": "l.category", "brand": "l.brand", "min_price": "cast(l.min_price AS string)", "max_price": "cast(l.max_price AS string)", "min_rating": "cast(l.min_rating AS string)", "currency": "coalesce(l.currency,'INR')"}
_ACT = {"category": "NULL", "brand": "CASE WHEN l.query_type = '2-HIGH' THEN 'Nike' END", "min_price": "cast(x.min_price AS string)", "max_price": "cast(x.max_price AS string)", "min_rating": "cast(x.min_rating AS string)", "currency": "x.currency"}
_NORMP = "list_distinct(list_filter(list_transform(string_split(l.prefs,'|'), lambda p: trim(regexp_replace(lower(p),'\\s+',' ','g'))), lambda p: p <> ''))"
_SCORED = f"""sc AS MATERIALIZED (SELECT *, len(list_intersect(ah,eh)) AS hard_tp, len(ah)-len(list_intersect(ah,eh)) AS hard_fp, len(eh)-len(list_intersect(ah,eh)) AS hard_fn,
    len(list_intersect(sa,se)) AS soft_tp, len(sa)-len(list_intersect(sa,se)) AS soft_fp, len(se)-len(list_intersect(sa,se)) AS soft_fn FROM (
    SELECT l.query_id AS case_id, l.query_type, expected_status = 'SUCCESS' AS ok, CASE WHEN expected_status = 'SUCCESS' THEN {_atoms(_ACT)} ELSE [] END AS ah, {_atoms(_EXP)} AS eh,
      CASE WHEN expected_status = 'SUCCESS' THEN s.soft ELSE [] END AS sa, {_NORMP} AS se FROM {{shopper_log}} l JOIN ({_LOGX}) x USING (query_id) JOIN ({_SOFTX}) s USING (query_id)))"""


def _f1(p, empty="1.0"):
    return f"CASE WHEN {p}_tp+{p}_fp+{p}_fn > 0 THEN 2.0*{p}_tp/(2*{p}_tp+{p}_fp+{p}_fn) ELSE {empty} END"


@query(
    "extraction_scores",
    f"WITH {_SCORED} SELECT case_id, cast(hard_tp AS INT) AS hard_tp, cast(hard_fp AS INT) AS hard_fp, cast(hard_fn AS INT) AS hard_fn, cast(soft_tp AS INT) AS soft_tp, cast(soft_fp AS INT) AS soft_fp, cast(soft_fn AS INT) AS soft_fn, round({_f1('hard')},6) AS hard_f1, round(CASE WHEN ok THEN {_f1('soft')} ELSE 0 END,6) AS soft_f1, ok AND hard_fp=0 AND hard_fn=0 AS hard_exact, ok AND soft_fp=0 AND soft_fn=0 AS soft_exact FROM sc",
)
def extraction_scores(spark, d):
    """E28."""
    return _case_scores(spark, d).select(
        "case_id", *[f"{g}_{x}" for g in ("hard", "soft") for x in ("tp", "fp", "fn")],
        F.round("hard_f1", 6).alias("hard_f1"), F.round("soft_f1", 6).alias("soft_f1"), "hard_exact", "soft_exact",
    )


def _policy_cases(spark, d):
    rows = load(spark, d, "extraction_cases")
    words = lambda c: F.filter(F.split(c, r"\|"), lambda x: x != "")

    def side(p):
        entries = F.transform(
            words(f"{p}_excl"),
            lambda x: F.struct(F.get(F.split(x, ":"), 0).alias("target_type"), F.get(F.split(x, ":"), 1).alias("value")),
        )
        return F.struct(
            *[F.col(f"{p}_{f}").alias(f) for f in sc.HARD_FIELDS], F.col(f"{p}_clarify").alias("needs_clarification"),
            words(f"{p}_soft").alias("soft_preferences"), F.col(f"{p}_type").alias("product_type"),
            F.col(f"{p}_incl").alias("min_inclusive"), F.lit(None).cast("boolean").alias("max_inclusive"), entries.alias("exclusions"),
        )

    return rows.select("case_id", "valid", side("a").alias("actual"), side("e").alias("expected"))


def _policy_sql(brand: str, currency: str) -> str:
    same = lambda f: f"coalesce(lower(a_{f}) = lower(e_{f}), false)"
    count = lambda parts: " + ".join(f"CASE WHEN {p} THEN 1 ELSE 0 END" for p in parts)
    return f"""a_category IS NOT DISTINCT FROM e_category AS category_match, {brand} AS brand_match, a_min_price IS NOT DISTINCT FROM e_min_price AND a_max_price IS NOT DISTINCT FROM e_max_price AS price_match,
        a_min_rating IS NOT DISTINCT FROM e_min_rating AS rating_match, {currency} IS NOT DISTINCT FROM coalesce(e_currency, 'INR') AS currency_match, coalesce(a_clarify, false) = coalesce(e_clarify, false) AS clarification_match,
        {count(same(f) for f in sc.HARD_FIELDS)} AS true_positives,
        {count((f"a_{f} IS NOT NULL AND NOT {same(f)}" + (" AND NOT (e_currency IS NULL AND a_currency = 'INR')" if f == "currency" else "") for f in sc.HARD_FIELDS))} AS false_positives,
        {count(f"e_{f} IS NOT NULL AND NOT {same(f)}" for f in sc.HARD_FIELDS)} AS false_negatives"""


def _words_sql(c: str, trim: bool) -> str:
    one = "trim(lower(x))" if trim else "lower(x)"
    return f"list_distinct(list_transform(list_filter(string_split({c}, '|'), lambda x: x <> ''), lambda x: {one}))"


def _setf1_sql(a: str, e: str) -> str:
    return f"round(CASE WHEN len({a}) = 0 AND len({e}) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect({a}, {e})) / (len({a}) + len({e})) END, 4)"


_FIELD_FLAGS = ("category_match", "brand_match", "price_match", "rating_match", "currency_match", "clarification_match")


@query(
    "field_scores",
    f"""SELECT * EXCLUDE (valid, sa, se), {_setf1_sql('sa', 'se')} AS soft_f1, valid AND {' AND '.join(_FIELD_FLAGS)} AS exact_match FROM (SELECT case_id, valid, {_policy_sql("lower(a_brand) IS NOT DISTINCT FROM lower(e_brand)", "a_currency")},
        {_words_sql('a_soft', False)} AS sa, {_words_sql('e_soft', False)} AS se FROM {{extraction_cases}})""",
)
def field_scores(spark, d):
    """E28, first policy."""
    return sc.score_fields(_policy_cases(spark, d)).drop("valid", "actual", "expected")


@query(
    "complete_scores",
    f"""SELECT * EXCLUDE (sa, se, xa, xe), round(CASE WHEN len(sa) = 0 THEN 1.0 ELSE len(list_intersect(sa, se)) * 1.0 / len(sa) END, 4) AS soft_precision, round(CASE WHEN len(se) = 0 THEN 1.0 ELSE len(list_intersect(sa, se)) * 1.0 / len(se) END, 4) AS soft_recall,
        {_setf1_sql('sa', 'se')} AS soft_f1, list_sort(sa) = list_sort(se) AS soft_exact, {_setf1_sql('xa', 'xe')} AS exclusions_f1, list_sort(xa) = list_sort(xe) AS exclusions_match, {' AND '.join(_FIELD_FLAGS)} AS legacy_exact,
        {' AND '.join(_FIELD_FLAGS)} AND list_sort(sa) = list_sort(se) AND list_sort(xa) = list_sort(xe) AND product_type_match AND boundary_match AS strict_exact
        FROM (SELECT case_id, {_policy_sql("trim(lower(a_brand)) IS NOT DISTINCT FROM trim(lower(e_brand))", "coalesce(a_currency, 'INR')")}, a_incl IS NULL OR e_incl IS NULL OR a_incl = e_incl AS boundary_match,
          e_type IS NULL OR coalesce(trim(lower(a_type)) = trim(lower(e_type)), false) AS product_type_match, {_words_sql('a_soft', True)} AS sa, {_words_sql('e_soft', True)} AS se, {_words_sql('a_excl', False)} AS xa, {_words_sql('e_excl', False)} AS xe FROM {{extraction_cases}})""",
)
def complete_scores(spark, d):
    """E28, second policy: product type, inclusivity, clarification and typed exclusions too."""
    return sc.score_complete(_policy_cases(spark, d)).drop("valid", "actual", "expected")


_Z = 1.959963984540054


def _wil(s, n, sign):
    return f"round((({s}*1.0/{n}) + {_Z}*{_Z}/(2*{n}) {sign} {_Z}*sqrt(({s}*1.0/{n})*(1-({s}*1.0/{n}))/{n} + {_Z}*{_Z}/(4.0*{n}*{n})))/(1+{_Z}*{_Z}/{n}),6)"


_SUMMARY = f"""SELECT query_type, count(*) AS cases, count(*) FILTER (ok) AS ok_count, count(*) FILTER (ok AND hard_fp=0 AND hard_fn=0) AS hard_exact_count, cast(sum(hard_tp) AS BIGINT) AS hard_tp, cast(sum(hard_fp) AS BIGINT) AS hard_fp, cast(sum(hard_fn) AS BIGINT) AS hard_fn,
   round(avg(CASE WHEN ok THEN {_f1('soft')} ELSE 0 END),6) AS soft_macro_f1, round(CASE WHEN sum(hard_tp+hard_fp+hard_fn)>0 THEN 2.0*sum(hard_tp)/(2*sum(hard_tp)+sum(hard_fp)+sum(hard_fn)) END,6) AS hard_micro_f1, round(avg(CASE WHEN hard_fp>0 THEN 1.0 ELSE 0 END),6) AS hallucinated_rate,
   {_wil("count(*) FILTER (ok AND hard_fp=0 AND hard_fn=0 AND soft_fp=0 AND soft_fn=0)", "count(*)", "-")} AS common_exact_low, {_wil("count(*) FILTER (ok AND hard_fp=0 AND hard_fn=0 AND soft_fp=0 AND soft_fn=0)", "count(*)", "+")} AS common_exact_high FROM sc GROUP BY query_type"""


@query("extraction_summary", f"WITH {_SCORED} {_SUMMARY}")
def extraction_summary(spark, d):
    """A21, E29."""
    return sc.summarize(_case_scores(spark, d), ["query_type"]).select(
        "query_type", "cases", "ok_count", "hard_exact_count", "hard_tp", "hard_fp", "hard_fn", "soft_macro_f1",
        "hard_micro_f1", "hallucinated_rate", "common_exact_low", "common_exact_high",
    )


@query(
    "wilson_rates",
    f"SELECT l_returnflag, l_linestatus, s, n, {_wil('s', 'n', '-')} AS low, {_wil('s', 'n', '+')} AS high FROM (SELECT l_returnflag, l_linestatus, count(*) FILTER (l_discount >= 0.05) AS s, count(*) AS n FROM lineitem GROUP BY 1,2)",
)
def wilson_rates(spark, d):
    """E29."""
    rates = load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count_if(F.col("l_discount") >= 0.05).alias("s"), F.count(F.lit(1)).alias("n")
    )
    low, high = sc.wilson(F.col("s"), F.col("n"))
    return rates.withColumns({"low": F.round(low, 6), "high": F.round(high, 6)})


@query(
    "consistency",
    """SELECT l_partkey, cast(sum(n) AS BIGINT) AS samples, cast(sum(CASE WHEN v THEN n*(n-1)/2 ELSE 0 END) AS BIGINT) AS agreements, cast(sum(n)*(sum(n)-1)/2 AS BIGINT) AS pairs, round(sum(CASE WHEN v THEN n*(n-1)/2 ELSE 0 END)*1.0/nullif(sum(n)*(sum(n)-1)/2,0),6) AS rate
       FROM (SELECT l_partkey, CASE WHEN l_tax < 0.08 THEN l_returnflag || l_linestatus END AS a, l_tax < 0.08 AS v, count(*) AS n FROM lineitem GROUP BY 1,2,3) GROUP BY 1""",
)
def consistency(spark, d):
    """E30."""
    rows = load(spark, d, "lineitem")
    return sc.consistency(rows, "l_partkey", F.col("l_tax") < 0.08, F.concat("l_returnflag", "l_linestatus"))


@query(
    "preference_errors",
    f"""WITH {_SCORED}, fx AS (SELECT case_id, list_filter(sa, lambda v: NOT list_contains(se, v)) AS fp, list_filter(se, lambda v: NOT list_contains(sa, v)) AS fn FROM sc)
        SELECT kind, severity, count(*) AS errors FROM (SELECT unnest(list_concat(
          list_transform(list_filter(fn, lambda v: regexp_matches(v, 'lens|tablet|cooktop|filter|mount|pen|shoes')), lambda v: 'Product-type confusion/HIGH'),
          list_transform(list_filter(list_concat(fp, fn), lambda v: regexp_matches(v, 'not |no |without |except ')), lambda v: 'Incorrect negation/HIGH'),
          list_transform(list_filter(fn, lambda v: NOT regexp_matches(v, 'lens|tablet|cooktop|filter|mount|pen|shoes|not |no |without |except ')), lambda v: 'Missing preference/MEDIUM'),
          list_transform(fp, lambda v: 'Extra preference/MEDIUM'))) AS k FROM fx), (SELECT 1) t(one), LATERAL (SELECT string_split(k,'/')[1] AS kind, string_split(k,'/')[2] AS severity) GROUP BY 1,2""",
)
def preference_errors(spark, d):
    """E32 counts."""
    errors = sc.preference_errors(_case_scores(spark, d), F.lit(False))
    return errors.groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("errors"))


_SYSTEMS = f"""SELECT query_type AS system, count(*) FILTER (ok)*1.0/count(*) AS validity, avg({_f1('hard')}) AS hard_f1, avg(CASE WHEN ok THEN {_f1('soft')} ELSE 0 END) AS soft_f1, count(*) FILTER (ok AND hard_fp=0 AND hard_fn=0)*1.0/count(*) AS strict_exact,
   avg(CASE WHEN len(list_filter(list_concat(list_filter(ah, lambda v: NOT list_contains(eh,v)), list_filter(eh, lambda v: NOT list_contains(ah,v))), lambda v: v LIKE 'brand=%')) = 0 AND ok THEN 1.0 ELSE 0 END) AS brand_accuracy FROM sc GROUP BY 1"""


@query(
    "system_ranking",
    f"WITH {_SCORED} SELECT system, validity >= 0.8 AND hard_f1 >= 0.85 AND brand_accuracy >= 0.8 AS eligible, round(0.4*soft_f1 + 0.3*strict_exact + 0.2*hard_f1 + 0.1*brand_accuracy,4) AS composite FROM ({_SYSTEMS})",
)
def system_ranking(spark, d):
    """Query types as candidate systems."""
    rows = _case_scores(spark, d).groupBy(F.col("query_type").alias("system")).agg(
        F.avg(F.col("ok").cast("double")).alias("validity"), F.avg("hard_f1").alias("hard_f1"), F.avg("soft_f1").alias("soft_f1"),
        F.avg(F.col("hard_exact").cast("double")).alias("strict_exact"), F.avg(F.col("match_brand").cast("double")).alias("brand_accuracy"),
    )
    return sc.rank_systems(rows, "system").select("system", "eligible", "composite")


@query(
    "metric_recheck",
    f"""WITH {_SCORED}, s AS ({_SUMMARY}) SELECT query_type, metric, round(recomputed,6) AS recomputed, round(reported,6) AS reported, round(recomputed-reported,6) AS delta, abs(recomputed-reported) <= 1e-6 AS matches FROM (
        SELECT query_type, unnest(['hard_micro_f1','soft_macro_f1']) AS metric, unnest([hard_micro_f1, soft_macro_f1]) AS recomputed, unnest([hard_micro_f1, soft_macro_f1 + CASE WHEN query_type LIKE '1%' THEN 0.25 ELSE 0 END]) AS reported FROM s)""",
)
def metric_recheck(spark, d):
    """Recomputed metrics against a report that is off in one place."""
    found = sc.summarize(_case_scores(spark, d), ["query_type"])
    off = F.when(F.col("query_type").startswith("1"), 0.25).otherwise(0.0)
    reported = found.withColumn("soft_macro_f1", F.col("soft_macro_f1") + off)
    out = sc.metric_deltas(found, reported, ["query_type"], ["hard_micro_f1", "soft_macro_f1"])
    return out.withColumns({"recomputed": F.round("recomputed", 6), "reported": F.round("reported", 6)})


@query(
    "latency_stats",
    "SELECT event_type, count(value) AS n, round(avg(value),4) AS mean, round(quantile_cont(value,0.5),4) AS p50, round(quantile_cont(value,0.95),4) AS p95, quantile_disc(value,0.95) AS p95_nearest, min(value) AS min, max(value) AS max FROM events GROUP BY 1",
)
def latency_stats(spark, d):
    """A22."""
    return sc.latency_stats(load(spark, d, "events"), "event_type", "value")


@query(
    "usage_rollup",
    "SELECT user_id, count(*) AS calls, count(DISTINCT event_type) AS stages, cast(sum(cast(json_extract_string(props,'$.k') AS BIGINT)) AS BIGINT) AS total_tokens, round(sum(cast(json_extract_string(props,'$.k') AS BIGINT))*0.12/1e6,8) AS cost FROM events GROUP BY 1",
)
def usage_rollup(spark, d):
    """Tokens from the JSON properties."""
    rows = load(spark, d, "events").withColumn("tokens", F.get_json_object("props", "$.k").cast("bigint"))
    return sc.usage_rollup(rows, "user_id", "event_type", "tokens", 0.12)
