"""Equi-join that stays balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_SPLIT = 500_000


def salted_join(
    big: DataFrame, other: DataFrame, key: str, hot: DataFrame, spread: str, how: str = "inner"
) -> DataFrame:
    """Join on ``key`` where the hot keys of ``big`` are spread over several tasks.

    ``hot`` holds (key, _fan): in how many pieces each hot key is cut.  Rows of
    ``big`` pick a piece by hashing the column ``spread``; the matching rows of
    ``other`` are repeated once per piece.  Keys that are not hot have one piece,
    and without hot keys this is a plain join.  ``hot`` is looked at once, so it
    should come from something cheap to read.
    """
    if hot.isEmpty():
        return big.join(other, key, how)
    one = F.lit(1)
    cut = F.coalesce("_fan", one)
    left = big.join(hot, key, "left").withColumn("_piece", F.pmod(F.xxhash64(spread), cut)).drop("_fan")
    right = (
        other.join(hot, key, "left")
        .withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), cut.cast("bigint") - 1)))
        .drop("_fan")
    )
    return left.join(right, [key, "_piece"], how).drop("_piece")


def hot_keys(df: DataFrame, key: str, rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """(key, _fan) of keys with more rows than one task should hold."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") > rows_per_split).select(
        key, F.ceil(F.col("_n") / rows_per_split).cast("bigint").alias("_fan")
    )
