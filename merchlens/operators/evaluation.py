"""Ranking metrics, intervals and agreement."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from merchlens.functions import stats as st

RELEVANT = 2
def _poisson_steps() -> tuple[float, ...]:
    steps, term, k = [], math.exp(-1.0), 0
    while not steps or steps[-1] < 1 - 2**-32:
        steps.append((steps[-1] if steps else 0.0) + term)
        k += 1
        term /= k
    return tuple(steps)


# Cumulative Poisson(1) probabilities: a uniform draw at or above the i-th is > i.  They go
# on as far as a 32-bit draw can reach.
POISSON_STEPS = _poisson_steps()
POISSON_LIMITS = tuple(math.ceil(step * 2**32) for step in POISSON_STEPS if step * 2**32 <= 2**32 - 1)
# 32-bit draws that one SHA-256 holds.
DRAWS = 8


def gain(grade: Column, rank: Column) -> Column:
    """E01."""
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def _ks(ks: list[int]) -> Column:
    return F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")


def ideal(qrels: DataFrame, ks: list[int]) -> DataFrame:
    """E02 / W07. IDCG per query and K, and the relevant count of the pool."""
    order = W.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")
    best = qrels.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= max(ks))
    idcg = (
        best.select("*", _ks(ks))
        .filter(F.col("pos") <= F.col("k"))
        .groupBy("query_id", "k")
        .agg(F.sum(gain(F.col("grade"), F.col("pos"))).alias("idcg"))
    )
    relevant = qrels.groupBy("query_id").agg(F.count_if(F.col("grade") >= RELEVANT).alias("pool_relevant"))
    return idcg.join(relevant, "query_id")


def cutoff_metrics(runs: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """E03. Metrics per (method, query, K); unjudged rows keep their rank.

    ``runs``: query_id, method, doc_id, rank and optionally ``satisfied`` (F03).
    """
    if "satisfied" not in runs.columns:
        runs = runs.withColumn("satisfied", F.lit(True))
    rows = (
        runs.filter(F.col("rank") <= max(ks))
        .join(qrels.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left")
        .select("*", _ks(ks))
        .filter(F.col("rank") <= F.col("k"))
    )
    rel = F.coalesce(F.col("grade") >= RELEVANT, F.lit(False))
    per = rows.groupBy("method", "query_id", "k").agg(
        F.count(F.lit(1)).alias("returned"),
        F.count("grade").alias("judged"),
        F.count_if(rel).alias("relevant"),
        F.min(F.when(rel, F.col("rank"))).alias("first_relevant"),
        F.coalesce(F.sum(F.when(F.col("grade") > 0, gain(F.col("grade"), F.col("rank")))), F.lit(0.0)).alias("dcg"),
        F.count_if(~F.col("satisfied")).alias("violations"),
    )
    out = per.join(ideal(qrels, ks), ["query_id", "k"], "left").fillna(0, ["idcg", "pool_relevant"])

    def ratio(a: Column, b: Column, empty=None) -> Column:
        return F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(empty)), 6)

    return out.select(
        "method", "query_id", "k", "returned", "judged", "relevant", "first_relevant",
        ratio(F.col("judged"), F.col("returned"), 1.0).alias("coverage"),
        ratio(F.col("relevant"), F.col("judged")).alias("precision_judged"),
        F.round(F.col("relevant") / F.col("k"), 6).alias("precision_conservative"),
        F.round(F.coalesce(1 / F.col("first_relevant"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round("dcg", 6).alias("dcg"),
        F.round("idcg", 6).alias("idcg"),
        F.round(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0), 6).alias("ndcg"),
        ratio(F.col("relevant"), F.col("pool_relevant")).alias("pool_recall"),
        F.round(1 - F.col("violations") / F.col("returned"), 6).alias("satisfaction"),
    )


METRICS = ("precision_judged", "precision_conservative", "reciprocal_rank", "ndcg", "pool_recall", "satisfaction")


def aggregate_metrics(per_query: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """A20. Means skip NULL, are exact and rounded once; coverage is judged over returned in total."""
    return per_query.groupBy(*by).agg(
        F.count(F.lit(1)).alias("queries"),
        F.sum("returned").alias("total_returned"),
        F.sum("judged").alias("total_judged"),
        F.round(F.coalesce(F.sum("judged") / F.nullif(F.sum("returned"), F.lit(0)), F.lit(1.0)), 6).alias("coverage"),
        *[st.exact_mean(F.sum(st.units(F.col(m))), F.count(m), digits).alias(f"mean_{m}") for m in METRICS],
    )


def judged_only(runs: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """E04. Ranks compacted over judged rows of the first K; NULL when none is judged."""
    rows = runs.filter(F.col("rank") <= k).join(
        qrels.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left"
    )
    group = ["method", "query_id"]
    judged = rows.filter(F.col("grade").isNotNull()).withColumns(
        {
            "pos": F.row_number().over(W.partitionBy(*group).orderBy("rank")),
            "best": F.row_number().over(W.partitionBy(*group).orderBy(F.desc("grade"), "rank")),
        }
    )
    rel = F.col("grade") >= RELEVANT
    scored = judged.groupBy(*group).agg(
        F.count(F.lit(1)).alias("judged"),
        F.round(F.avg(rel.cast("double")), 6).alias("precision"),
        F.round(F.coalesce(1 / F.min(F.when(rel, F.col("pos"))), F.lit(0.0)), 6).alias("mrr"),
        F.round(
            F.coalesce(
                F.sum(gain(F.col("grade"), F.col("pos")))
                / F.nullif(F.sum(gain(F.col("grade"), F.col("best"))), F.lit(0.0)),
                F.lit(0.0),
            ),
            6,
        ).alias("ndcg"),
        F.round(F.avg((~rel).cast("double")), 6).alias("violation_rate"),
    )
    returned = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("returned"))
    return returned.join(scored, group, "left").fillna(0, ["judged"])


def unjudged_as_zero(runs: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """E05. Unjudged is grade 0 and the ideal order is that of the returned list."""
    group = ["method", "query_id"]
    rows = (
        runs.filter(F.col("rank") <= k)
        .join(qrels.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left")
        .fillna(0, ["grade"])
        .withColumn("best", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("grade"), "rank")))
    )
    rel = F.col("grade") >= RELEVANT
    top = F.nullif(F.sum(gain(F.col("grade"), F.col("best"))), F.lit(0.0))
    return rows.groupBy(*group).agg(
        F.round(F.coalesce(F.sum(gain(F.col("grade"), F.col("rank"))) / top, F.lit(0.0)), 6).alias("ndcg"),
        F.round(F.coalesce(1 / F.min(F.when(rel, F.col("rank"))), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.count_if(rel) / k, 6).alias("precision"),
    )


def bootstrap(
    values: DataFrame, by: list[str], key: str, value: str, *, samples: int = 1000, alpha: float = 0.05, seed: int = 14014,
    upper_shift: int = 0,
) -> DataFrame:
    """E06. Mean and percentile interval per group.

    A row enters replicate r with a Poisson(1) weight taken from a hash of (seed, block of
    replicates, key): rows never meet a resampling join, one hash serves DRAWS replicates,
    and all replicates of a block are added up side by side on the map side.  Values count
    in whole millionths, so sums are exact and neither partitioning nor row order matters.
    """
    usable = values.filter(
        F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    ).select(*by, F.col(key).cast("string").alias("_key"), st.units(F.col(value).cast("double")).alias("_v"))
    blocks = -(-samples // DRAWS)
    drawn = usable.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("_b").cast("string"), "_key"), 256)
    drawn = drawn.withColumn("_h", digest)

    def weight(j: int) -> Column:
        h = F.conv(F.substring("_h", 8 * j + 1, 8), 16, 10).cast("bigint")
        return sum((F.when(h >= limit, 1).otherwise(0) for limit in POISSON_LIMITS[1:]), F.when(h >= POISSON_LIMITS[0], 1).otherwise(0))

    weighed = drawn.select(*by, "_b", "_v", *[weight(j).cast("bigint").alias(f"_w{j}") for j in range(DRAWS)])
    sums = weighed.groupBy(*by, "_b").agg(
        *[F.sum(f"_w{j}").alias(f"_n{j}") for j in range(DRAWS)],
        *[F.sum(F.col(f"_w{j}") * F.col("_v")).alias(f"_s{j}") for j in range(DRAWS)],
    )
    each = F.array(*[
        F.struct((F.col("_b") * DRAWS + j).alias("r"), st.exact_mean(F.col(f"_s{j}"), F.col(f"_n{j}")).alias("m"))
        for j in range(DRAWS)
    ])
    means = (
        sums.select(*by, F.inline(each))
        .filter((F.col("r") < samples) & F.col("m").isNotNull())
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list("m")).alias("_ms"))
    )
    lo = int(samples * alpha / 2)
    hi = min(samples - 1, int(samples * (1 - alpha / 2))) - upper_shift
    n = F.count(F.lit(1))
    stats = usable.groupBy(*by).agg(st.exact_mean(F.sum("_v"), n).alias("mean"), n.alias("n"))

    def at(i: int, name: str) -> Column:
        # Replicates that drew nothing are absent, which only tiny groups can have.
        pos = F.least(F.lit(i), F.size("_ms") - 1)
        return F.when(F.col("n") == 1, F.col("mean")).otherwise(F.get("_ms", pos)).alias(name)

    return stats.join(means, by).select(*by, "mean", "n", at(lo, "ci_lower"), at(hi, "ci_upper"))


def partition_gap(aggregated: DataFrame, by: list[str], partition: str, metric: str) -> DataFrame:
    """E08. Development minus held-out value of a metric."""
    dev = F.max(F.when(F.col(partition) == "development", F.col(metric)))
    held = F.max(F.when(F.col(partition) == "held_out", F.col(metric)))
    return aggregated.groupBy(*by).agg(
        dev.alias("development"), held.alias("held_out"), F.round(dev - held, 6).alias("gap")
    )


def weighted_kappa(pairs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """E09. Quadratic-weighted kappa and exact agreement per group.

    ``1 - n * sum((a-b)^2) / sum over marginals``; expanding the square reduces the
    marginal sum to moments, so a single aggregate suffices.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    n = F.count(F.lit(1))
    out = pairs.groupBy(*(by or [])).agg(
        n.alias("pairs"),
        F.round(F.avg((F.col(a) == F.col(b)).cast("double")), 6).alias("exact_agreement"),
        (F.sum((x - y) * (x - y)) / n).alias("_obs"),
        # sum over a,b of (a-b)^2 L[a] R[b] / n^2 = E[a^2] + E[b^2] - 2 E[a] E[b]
        (F.avg(x * x) + F.avg(y * y) - 2 * F.avg(x) * F.avg(y)).alias("_exp"),
    )
    kappa = F.when((F.col("pairs") >= 2) & (F.col("_exp") > 1e-12), 1 - F.col("_obs") / F.col("_exp"))
    return out.withColumn("kappa", F.round(kappa, 6)).drop("_obs", "_exp")


def agreement_by(pairs: DataFrame, a: str, b: str, strata: list[str]) -> DataFrame:
    """A19. Kappa overall and per stratum value, one scan."""
    keys = F.array(
        F.struct(F.lit("overall").alias("stratum"), F.lit("all").alias("value")),
        *[F.struct(F.lit(s).alias("stratum"), F.col(s).cast("string").alias("value")) for s in strata],
    )
    return weighted_kappa(pairs.select("*", F.inline(keys)), a, b, ["stratum", "value"])


def compare_labels(left: DataFrame, right: DataFrame, keys: list[str], grade: str = "grade") -> DataFrame:
    """E10 / J01. Confusion cells of two label sets on shared keys."""
    joined = left.select(*keys, F.col(grade).alias("a")).join(right.select(*keys, F.col(grade).alias("b")), keys)
    return joined.groupBy("a", "b").agg(F.count(F.lit(1)).alias("pairs"))
