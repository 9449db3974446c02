"""Gapless numbers within groups, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchlens.session import cut_lineage


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... within each group of ``keys`` in the given order.

    Rows are dealt out by ranges of (keys, order), so a group of any size covers as many
    blocks as it needs.  Numbers are the position within the block plus the group's rows
    in earlier blocks; only block counts meet in one place, and there are no more
    blocks than partitions.  The dealt rows are written once, so block numbers are the
    same for both uses and after the loss of an executor.  Groups are null-safe; full
    ties are cut by the row's place in the scan, where any order gives equal rows.
    """
    group = [F.col(f"`{k}`") for k in keys]
    tie = F.monotonically_increasing_id()
    dealt = cut_lineage(
        df.withColumn("__tie", tie)
        .repartitionByRange(*group, *order, "__tie")
        .withColumn("__block", F.spark_partition_id())
    )
    ids = [f"__g{i}" for i in range(len(keys))]
    sizes = dealt.groupBy("__block", *[g.alias(i) for g, i in zip(group, ids)]).agg(
        F.count(F.lit(1)).alias("__n")
    )
    before = Window.partitionBy(*ids).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("__block").alias("__b"), *ids, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    inside = Window.partitionBy("__block", *group).orderBy(*order, "__tie")
    rows = dealt.withColumn("__i", F.row_number().over(inside) - 1)
    same = F.col("__block") == F.col("__b")
    for g, i in zip(group, ids):
        same = same & g.eqNullSafe(F.col(i))
    return rows.join(starts, same).select(
        *[F.col(f"`{c}`") for c in df.columns if c != name],
        (F.col("__start") + F.col("__i")).cast("bigint").alias(name),
    )
