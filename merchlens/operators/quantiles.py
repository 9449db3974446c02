"""Exact quantiles and distinct counts of large tables, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from merchlens.session import cut_lineage


# Rank error of the sketch is one in ACCURACY; brackets reach REACH errors to both sides of a rank.
ACCURACY, REACH = 10_000, 2


def exact_quantiles(df: DataFrame, by: str, value: str, q: list[float], nearest: list[float] | None = None) -> DataFrame:
    """(by, q, kind, value): interpolated quantiles ``q`` and nearest-rank ones of each group.

    One pass sketches every group and brackets each wanted rank by two values.  A second
    pass counts what lies below a bracket and keeps the values inside, about four in
    ACCURACY of the group; equal ones become one row with a count before they move.  Only
    these are sorted, so no group is shuffled or sorted whole.  The wanted rank may be
    one place outside the bracket in a small group: the next values on both sides are
    known too.  NULL and NaN are not values.  The interpolated quantile is that of
    ``percentile``, the nearest one that of ``percentile_disc``.
    """
    x = F.col(value).cast("double")
    slim = df.select(F.col(by).alias("g"), x.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    slim = cut_lineage(slim)  # two narrow columns, read twice
    places = sorted({*q, *(nearest or [])})
    aside = REACH / ACCURACY
    points = [max(0.0, p - aside) for p in places] + [min(1.0, p + aside) for p in places]
    sketch = slim.groupBy("g").agg(
        F.count(F.lit(1)).alias("total"), F.percentile_approx("v", points, ACCURACY).alias("bounds")
    )
    bounds = cut_lineage(sketch.select(F.col("g").alias("bg"), "total", "bounds"))
    lo = [F.get("bounds", F.lit(i)) for i in range(len(places))]
    hi = [F.get("bounds", F.lit(len(places) + i)) for i in range(len(places))]
    v = F.col("v")
    met = slim.join(bounds, F.col("g").eqNullSafe(F.col("bg")))
    around = met.groupBy("g").agg(
        F.first("total").alias("total"),
        *[F.count_if(v < low).alias(f"below{i}") for i, low in enumerate(lo)],
        *[F.max(F.when(v < low, v)).alias(f"before{i}") for i, low in enumerate(lo)],
        *[F.min(F.when(v > high, v)).alias(f"after{i}") for i, high in enumerate(hi)],
    )
    inside = F.array_compact(F.array(*[F.when(v.between(low, high), F.lit(i)) for i, (low, high) in enumerate(zip(lo, hi))]))
    cells = met.select("g", "v", F.explode(inside).alias("i")).groupBy("g", "i", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy("g", "i").orderBy("v"))
    kept = cells.select(F.col("g").alias("kg"), F.col("i").alias("ki"), F.col("v").alias("kept"), "n", upto.alias("upto"))
    kept = kept.withColumn("held", F.sum("n").over(W.partitionBy("kg", "ki")))
    last = F.col("total") - 1

    def target(p: float, kind: str, at: Column, part: Column):
        i = places.index(p)
        return F.struct(
            F.lit(i).alias("i"), F.lit(p).alias("q"), F.lit(kind).alias("kind"), part.alias("part"),
            (at.cast("bigint") - F.col(f"below{i}")).alias("at"), F.col(f"before{i}").alias("before"), F.col(f"after{i}").alias("after"),
        )

    wanted = []
    for p in q:
        floor = F.floor(last * F.lit(p))
        part = last * F.lit(p) - floor
        wanted += [target(p, "interpolated", floor, 1 - part), target(p, "interpolated", floor + 1, part)]
    for p in nearest or []:
        wanted.append(target(p, "nearest", F.greatest(F.ceil(F.col("total") * F.lit(p)) - 1, F.lit(0)), F.lit(1.0)))
    # The upper neighbour of the last place has no weight.
    spots = around.select("g", F.inline(F.array(*wanted))).filter("part > 0")
    here = (
        F.col("g").eqNullSafe(F.col("kg")) & (F.col("i") == F.col("ki"))
        & (
            ((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n")))
            | ((F.col("upto") == F.col("n")) & (F.col("at") < 0))
            | ((F.col("upto") == F.col("held")) & (F.col("at") >= F.col("held")))
        )
    )
    hits = spots.join(kept, here)
    chosen = F.when(F.col("at") < 0, F.col("before")).when(F.col("at") >= F.col("held"), F.col("after")).otherwise(F.col("kept"))
    return hits.groupBy(F.col("g").alias(by), "q", "kind").agg(F.sum(chosen * F.col("part")).alias("value"))


def wide(quantiles: DataFrame, by: str, names: dict[tuple[float, str], str]) -> DataFrame:
    """One row per group, one column per (q, kind)."""
    return quantiles.groupBy(by).agg(
        *[F.max(F.when((F.col("q") == q) & (F.col("kind") == k), F.col("value"))).alias(n) for (q, k), n in names.items()]
    )


def distinct_counts(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(column_name, distinct_count) of several expressions; NULL does not count.

    Each value travels as 128 bits of two hashes, however long it is, and repeats are
    collapsed before they move.
    """
    entries = [
        F.struct(F.lit(n).alias("column_name"), c.isNotNull().alias("there"), F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(n), c).alias("h2"))
        for n, c in columns.items()
    ]
    values = df.select(F.inline(F.array(*entries))).filter("there").select("column_name", "h1", "h2").distinct()
    counted = values.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count"))
    names = df.sparkSession.createDataFrame([(n,) for n in columns], "column_name string")
    return names.join(counted, "column_name", "left").fillna(0, ["distinct_count"])
