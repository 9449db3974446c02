"""Rank fusion and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from merchlens.operators.lexical import first_of, listed_scores, rank, ranks_of, top_k
from merchlens.session import cut_lineage

RRF_K = 60
DENSE_POOL = 3


def reciprocal_rank_fusion(branches: dict[str, DataFrame], k: int, digits: int = 8) -> DataFrame:
    """R08 / J04. ``sum(1 / (60 + rank))`` over branches of (query_id, doc_id, rank, score).

    A union and one aggregate replace a full outer join.
    """
    rows = None
    for name, df in branches.items():
        part = df.select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), "score", F.lit(name).alias("branch"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", "doc_id").agg(
        F.sum(1 / (RRF_K + F.col("rank"))).alias("score"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("branch", F.struct("rank", "score"))))).alias("sources"),
    )
    return top_k(fused, k, digits=12)


def hybrid(dense_pool: DataFrame, lexical_scores: DataFrame, limit: int) -> DataFrame:
    """R08. Filtered dense pool and the filtered full lexical ranking, fused.

    A product outside the dense pool and below lexical rank ``limit`` cannot reach
    the result, so only the lexical top ``limit`` and the exact lexical ranks of
    the dense pool are made; the full list is never sorted.  ``lexical_scores`` are rows
    (query_id, doc_id, score) or stored `lexical.score_lists`, which are read as they are.
    """
    # Both sides are read several times below and are costly to make again.
    dense_pool = cut_lineage(dense_pool)
    lists = lexical_scores if "docs" in lexical_scores.columns else cut_lineage(listed_scores(lexical_scores))
    head = top_k(first_of(lists, limit), limit).select("query_id", "doc_id", "rank", "score")
    deep = ranks_of(lists, dense_pool).filter(F.col("rank") > limit)
    return reciprocal_rank_fusion({"dense": dense_pool, "lexical": head.unionByName(deep)}, limit)


def _q():
    return W.partitionBy("query_id")


def multi_signal(candidates: DataFrame) -> DataFrame:
    """R09. Mean branch rank utility; missing evidence is 0."""

    def utility(branch: str):
        r = F.col(f"sources.{branch}.rank")
        top = F.coalesce(F.max(r).over(_q()), F.lit(1))
        return F.coalesce((top - r + 1) / top, F.lit(0.0))

    return candidates.withColumn("rerank_score", (utility("dense") + utility("lexical")) / 2)


def rrf_passthrough(candidates: DataFrame) -> DataFrame:
    """R10."""
    return candidates.withColumn("rerank_score", F.col("score"))


def minmax(column: str):
    """W04. Per-query min-max; a flat list is 0.5."""
    lo, hi = F.min(column).over(_q()), F.max(column).over(_q())
    flat = F.abs(hi - lo) <= F.greatest(F.lit(1e-12), 1e-12 * F.greatest(F.abs(lo), F.abs(hi)))
    return F.when(flat, F.lit(0.5)).otherwise((F.col(column) - lo) / (hi - lo))


def pair_scores(candidates: DataFrame, scores: DataFrame, pair_weight: float = 1.0, signal_weight: float = 0.0) -> DataFrame:
    """R11. External pair scores (query_id, doc_id, pair_score), alone or weighted.

    A query with a missing or non-finite score is dropped whole (J07, F08).
    """
    joined = multi_signal(candidates).join(scores, ["query_id", "doc_id"], "left")
    p = F.col("pair_score")
    good = p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))
    complete = joined.withColumn("_ok", F.min(good).over(_q())).filter("_ok").drop("_ok")
    total = pair_weight + signal_weight
    final = minmax("pair_score") * (pair_weight / total) + F.col("rerank_score") * (signal_weight / total)
    return complete.withColumn("rerank_score", final)


def rerank(scored: DataFrame, k: int | None = None) -> DataFrame:
    """Order by (score, original rank, id); adds ``new_rank``."""
    order = _q().orderBy(F.desc(F.round("rerank_score", 8)), "rank", "doc_id")
    out = scored.withColumn("new_rank", F.row_number().over(order))
    return out if k is None else out.filter(F.col("new_rank") <= k)


def rank_shift(reranked: DataFrame) -> DataFrame:
    """W05."""
    return reranked.groupBy("query_id").agg(
        F.sum(F.abs(F.col("new_rank") - F.col("rank"))).alias("total_shift"),
        F.count(F.lit(1)).alias("candidates"),
    )


def overlap(a: DataFrame, b: DataFrame, ks: list[int]) -> DataFrame:
    """R14 / U02. Shared documents in the first K of two rankings."""
    pair = a.select("query_id", "doc_id", F.col("rank").alias("ra")).join(
        b.select("query_id", "doc_id", F.col("rank").alias("rb")), ["query_id", "doc_id"]
    )
    ids = a.select("query_id").union(b.select("query_id")).distinct()
    grid = ids.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    shared = pair.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(
        (F.col("ra") <= F.col("k")) & (F.col("rb") <= F.col("k"))
    )
    counts = shared.groupBy("query_id", "k").agg(F.count(F.lit(1)).alias("shared"))
    out = grid.join(counts, ["query_id", "k"], "left").fillna(0, ["shared"])
    return out.withColumn("overlap", F.round(F.col("shared") / F.col("k"), 6))


def head_to_head(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """R20. Overlap at K and the two best matches per query."""
    best = lambda df, name: df.filter("rank = 1").select("query_id", F.col("doc_id").alias(name))
    return (
        overlap(a, b, [k])
        .join(best(a, "first_best"), "query_id", "left")
        .join(best(b, "second_best"), "query_id", "left")
        .withColumn("same_best", F.coalesce(F.col("first_best") == F.col("second_best"), F.lit(False)))
    )


def capture_status(queries: DataFrame, unresolved: Column) -> DataFrame:
    """R19 gate. (query_id, stage, status, reason) of queries that are not captured.

    ``queries``: query_id, audited, expected_status.  An unaudited query is blocked, one
    whose pipeline stops before retrieval (F07) is skipped; a query that finds nothing is
    neither.
    """
    stop = F.when(unresolved, F.lit("CLARIFICATION_REQUIRED")).otherwise(F.col("expected_status"))
    unaudited = ~F.coalesce("audited", F.lit(False))
    goes_on = F.coalesce(stop.isin("SUCCESS", "NO_RESULTS"), F.lit(False))
    return queries.filter(unaudited | ~goes_on).select(
        "query_id",
        F.lit("capture").alias("stage"),
        F.when(unaudited, "BLOCKED").otherwise("SKIPPED").alias("status"),
        F.when(unaudited, F.lit("QUERY_AUDIT_INCOMPLETE"))
        .otherwise(F.concat(F.lit("PIPELINE_STOP:"), F.coalesce(stop, F.lit("None"))))
        .alias("reason"),
    )


def capture(methods: dict[str, DataFrame], depth: int) -> DataFrame:
    """R19. Runs of all methods, to the same depth, with a method column."""
    runs = None
    for name, df in methods.items():
        part = df.filter(F.col("rank") <= depth).select(
            "query_id", F.lit(name).alias("method"), "doc_id", F.col("rank").cast("int").alias("rank"), "score"
        )
        runs = part if runs is None else runs.unionByName(part)
    return runs


__all__ = [
    "capture", "capture_status", "head_to_head", "hybrid", "minmax", "multi_signal", "overlap", "pair_scores", "rank",
    "rank_shift", "reciprocal_rank_fusion", "rerank", "rrf_passthrough",
]
