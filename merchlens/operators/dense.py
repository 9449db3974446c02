"""Dense retrieval: exact and filtered, recall and checks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlens.functions.vectors import cosine, norm, vector_problem
from merchlens.operators.lexical import top_k

ROWS_PER_BLOCK = 20_000
QUERIES_PER_BLOCK = 512
ATTRIBUTES = ("category", "brand", "price", "rating")
FILTERS = (
    "f_category", "f_brand", "f_min_price", "f_max_price", "f_min_inclusive", "f_max_inclusive", "f_min_rating",
)


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype("float64")
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _allowed(cat: pd.DataFrame, q) -> np.ndarray:
    """F01 over one block for one query; an absent bound passes, NULL fails."""
    ok = np.ones(len(cat), dtype=bool)
    for field in ("category", "brand"):
        want = getattr(q, f"f_{field}")
        if isinstance(want, str):
            ok &= (cat[field].str.lower() == want.lower()).fillna(False).to_numpy(dtype=bool)
    avoid = getattr(q, "f_not_category", None)
    if isinstance(avoid, str):
        ok &= ~(cat["category"].str.lower() == avoid.lower()).fillna(False).to_numpy(dtype=bool)
    price, rating = cat["price"].to_numpy("float64"), cat["rating"].to_numpy("float64")
    if pd.notna(q.f_min_rating):
        ok &= rating >= q.f_min_rating
    for bound, inclusive, at, beyond in (
        (q.f_min_price, q.f_min_inclusive, np.greater_equal, np.greater),
        (q.f_max_price, q.f_max_inclusive, np.less_equal, np.less),
    ):
        if pd.notna(bound):
            # A bound that does not say whether it is inclusive matches nothing.
            ok &= (at if inclusive else beyond)(price, bound) if pd.notna(inclusive) else False
    return ok


def _grid(
    catalog: DataFrame, queries: DataFrame, filtered: bool, rows_per_block: int, queries_per_block: int, cell, out: str
) -> DataFrame:
    """Run ``cell(catalog block, query block)`` over a grid of bounded blocks.

    A vector goes to one row of the grid, a query to one column; neither side is
    broadcast or collected, and no pair leaves its cell.
    """
    n, q = catalog.count(), queries.count()
    cores = catalog.sparkSession.sparkContext.defaultParallelism
    rows = max(1, math.ceil(n / rows_per_block), min(cores, math.ceil(n / 500)))
    cols = max(1, math.ceil(q / queries_per_block))
    attrs = list(ATTRIBUTES) if filtered else []
    filters = [f for f in (*FILTERS, "f_not_category") if f in queries.columns] if filtered else []
    numeric = ("price", "rating", "f_min_price", "f_max_price", "f_min_rating")

    def plain(names: list[str]) -> list:
        return [F.col(c).cast("double").alias(c) if c in numeric else F.col(c) for c in names]

    left = catalog.filter(F.col("embedding").isNotNull()).select(
        "doc_id", "embedding", *plain(attrs),
        F.pmod(F.xxhash64("doc_id"), F.lit(rows)).alias("_r"),
        F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("_c"),
    )
    right = queries.filter(F.col("embedding").isNotNull()).select(
        "query_id", F.col("embedding").alias("q_vec"), *plain(filters),
        F.pmod(F.xxhash64("query_id"), F.lit(cols)).cast("int").alias("_c"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(rows - 1).cast("bigint"))).alias("_r"),
    )
    types = {
        "query_id": queries.schema["query_id"].dataType.simpleString(),
        "doc_id": catalog.schema["doc_id"].dataType.simpleString(),
    }
    schema = out.format(**types)
    names = [c.split()[0] for c in schema.split(",")]

    def guarded(cat: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if cat.empty or qs.empty:
            return pd.DataFrame({c: [] for c in names})
        return cell(cat, qs)

    return left.groupBy("_r", "_c").cogroup(right.groupBy("_r", "_c")).applyInPandas(guarded, schema)


def exact_scores(
    catalog: DataFrame,
    queries: DataFrame,
    k: int,
    filtered: bool = False,
    rows_per_block: int = ROWS_PER_BLOCK,
    queries_per_block: int = QUERIES_PER_BLOCK,
) -> DataFrame:
    """R05/R07. Each block's k best (query_id, doc_id, score) by cosine.

    ``catalog``: doc_id, embedding (and attributes); ``queries``: query_id,
    embedding (and filters).  A grid cell is one matrix product that emits k rows
    per query.
    """

    def cell(cat: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        scores = _unit(qs["q_vec"]) @ _unit(cat["embedding"]).T
        ids = cat["doc_id"].to_numpy()
        parts = []
        for i, row in enumerate(qs.itertuples(index=False)):
            pick = np.flatnonzero(_allowed(cat, row)) if filtered else np.arange(len(ids))
            s = scores[i, pick]
            best = np.lexsort((ids[pick], -np.round(s, 8)))[:k]
            parts.append(pd.DataFrame({"query_id": row.query_id, "doc_id": ids[pick][best], "score": s[best]}))
        return pd.concat(parts, ignore_index=True)

    return _grid(
        catalog, queries, filtered, rows_per_block, queries_per_block, cell,
        "query_id {query_id}, doc_id {doc_id}, score double",
    )


def eligible_vectors(
    catalog: DataFrame, queries: DataFrame, rows_per_block: int = ROWS_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK
) -> DataFrame:
    """R13. How many vectors satisfy each query's filters, counted per grid cell."""

    def cell(cat: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        counts = [int(_allowed(cat, row).sum()) for row in qs.itertuples(index=False)]
        return pd.DataFrame({"query_id": qs["query_id"], "n": counts})

    per_cell = _grid(
        catalog, queries, True, rows_per_block, queries_per_block, cell, "query_id {query_id}, n bigint"
    )
    return per_cell.groupBy("query_id").agg(F.sum("n").alias("eligible"))


def exact_top_k(catalog: DataFrame, queries: DataFrame, k: int, filtered: bool = False, **blocks) -> DataFrame:
    """R05 / R07 with 1-based ranks by (round(score, 8) desc, id)."""
    return top_k(exact_scores(catalog, queries, k, filtered, **blocks), k)


def nearest(catalog: DataFrame, vector: list[float], k: int) -> DataFrame:
    """K01. ``ORDER BY distance, id LIMIT k`` for one vector (TakeOrderedAndProject)."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    scored = catalog.select("doc_id", cosine(F.col("embedding"), q).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 8)), "doc_id").limit(k)


def ann_recall(exact: DataFrame, approx: DataFrame, ks: list[int]) -> DataFrame:
    """R12. Per K: average and smallest share of the exact top K that was found."""
    hit = exact.select("query_id", "doc_id", F.col("rank").alias("e_rank")).join(
        approx.select("query_id", "doc_id", F.col("rank").alias("a_rank")), ["query_id", "doc_id"], "left"
    )
    per_k = hit.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(F.col("e_rank") <= F.col("k"))
    per_query = per_k.groupBy("query_id", "k").agg(
        (F.count_if(F.col("a_rank") <= F.col("k")) / F.count(F.lit(1))).alias("recall")
    )
    return per_query.groupBy("k").agg(
        F.round(F.avg("recall"), 6).alias("avg_recall"),
        F.round(F.min("recall"), 6).alias("min_recall"),
        F.count(F.lit(1)).alias("queries"),
    )


def underfill(filtered: DataFrame, unfiltered: DataFrame, allowed: DataFrame, eligible: DataFrame, k: int) -> DataFrame:
    """R13. Rows left by rank-then-filter against filter-then-rank and the possible.

    ``eligible``: (query_id, eligible); ``allowed``: (query_id, doc_id) of the
    unfiltered top K that satisfy the constraints.
    """
    pre = filtered.groupBy("query_id").agg(F.count(F.lit(1)).alias("filter_first"))
    post = unfiltered.join(allowed, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("rank_first")
    )
    out = eligible.join(pre, "query_id", "left").join(post, "query_id", "left").fillna(0)
    return out.withColumn("possible", F.least(F.lit(k), F.col("eligible"))).withColumn(
        "underfilled", F.col("rank_first") < F.col("possible")
    )


def vector_report(df: DataFrame, dim: int) -> DataFrame:
    """R15. Counts per failing check and the norm range."""
    problem = vector_problem(F.col("embedding"), dim)
    n = norm(F.col("embedding"))
    checks = ("missing", "dimension", "not finite", "zero", "not unit")
    return df.agg(
        F.count(F.lit(1)).alias("vectors"),
        F.count_if(problem.isNull()).alias("usable"),
        *[F.count_if(problem == c).alias(c.replace(" ", "_")) for c in checks],
        F.round(F.min(n), 6).alias("min_norm"),
        F.round(F.avg(n), 6).alias("mean_norm"),
        F.round(F.max(n), 6).alias("max_norm"),
    )


def search_checks(ranked: DataFrame, k: int) -> DataFrame:
    """R17. Per query: K rows, contiguous ranks, cosine distances in 0 to 2 that never fall, self match first.

    ``self_first`` holds where the query's own vector is in the catalog under the same id.
    """
    rows = ranked.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("returned"),
        F.max("rank").alias("last_rank"),
        F.sort_array(F.collect_list(F.struct("rank", (1 - F.round("score", 8)).alias("d")))).alias("l"),
        F.bool_or((F.col("rank") == 1) & (F.col("doc_id") == F.col("query_id"))).alias("self_first"),
    )
    fine = F.forall("l", lambda x: ~F.isnan(x["d"]) & x["d"].between(-1e-8, 2 + 1e-8))
    rising = F.forall(
        F.transform("l", lambda x, i: F.coalesce(F.get("l", i + 1)["d"] >= x["d"], F.lit(True)) & ~F.isnan(x["d"])),
        lambda ok: ok,
    )
    return rows.select(
        "query_id", "returned", (F.col("returned") == k).alias("full"),
        (F.col("last_rank") == F.col("returned")).alias("contiguous"), rising.alias("ordered"), fine.alias("in_range"),
        "self_first",
    )


def filtered_checks(rows: DataFrame, eligible: DataFrame, k: int) -> DataFrame:
    """R17 under filters. ``rows``: query_id, satisfied; ``eligible``: query_id, eligible."""
    per = rows.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("returned"), F.count_if(~F.col("satisfied")).alias("violations")
    )
    out = eligible.join(per, "query_id", "left").fillna(0).withColumn("possible", F.least(F.lit(k), F.col("eligible")))
    ok = (F.col("returned") == F.col("possible")) & (F.col("violations") == 0)
    return out.select("query_id", "possible", "returned", "violations", ok.alias("ok"))


def margins(scored: DataFrame) -> DataFrame:
    """R21. Best target similarity minus best distractor, per query (query_id, score, is_target)."""
    out = scored.groupBy("query_id").agg(
        F.max(F.when(F.col("is_target"), F.col("score"))).alias("target"),
        F.max(F.when(~F.col("is_target"), F.col("score"))).alias("distractor"),
    )
    margin = F.col("target") - F.col("distractor")
    return out.withColumns({"margin": margin, "passed": margin > 0})
