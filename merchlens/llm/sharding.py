"""Sharding by weighted rendezvous hashing of stable record keys.

A record goes to the shard with the highest score ``-weight / ln(u)``, where u in (0, 1)
is a hash of (key, shard).  Scores of different shards do not depend on each other, so a
new shard takes only the records it wins and no record moves between old shards; a
shard's share is proportional to its weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens.llm.ordinals import numbered
from merchlens.llm.registry import query, read
from merchlens.session import cut_lineage

SHARDS = 40


def _score(key: Column, shard: Column, weight: Column) -> Column:
    """-weight / ln(u) with u from the upper 53 bits of XXH64("key:shard", seed 42)."""
    h = F.xxhash64(F.concat(key, F.lit(":"), shard.cast("string")))
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
    return -weight / F.ln(u)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Struct (score, shard) of the winning shard; equal scores go to the smaller number.

    A null key is the key ``null``; all weights must be positive.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    text = F.coalesce(key.cast("string"), F.lit("null"))
    scored = F.transform(
        F.array(*[F.lit(float(w)) for w in weights]),
        lambda w, i: F.struct(_score(text, i, w).alias("score"), (-i).alias("minus")),
    )
    best = F.array_max(scored)
    return F.struct(best.score.alias("score"), (-best.minus).alias("shard"))


def assign_shards(
    records: DataFrame, key: str, weights: list[float], grown_weight: float | None = None
) -> DataFrame:
    """All columns plus ``shard`` and ``grown_shard`` (null without ``grown_weight``).

    ``grown_shard`` is the record's place after one more shard of that weight joins: either
    the new shard or the same one.  Columns of these names are replaced.  Equal keys
    always share a shard; an empty table gives an empty table.
    """
    rest = [F.col(f"`{c}`") for c in records.columns if c not in ("shard", "grown_shard")]
    won = records.withColumn("__won", rendezvous(F.col(f"`{key}`"), weights))
    grown = F.lit(None).cast("int")
    if grown_weight is not None:
        text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))
        new = _score(text, F.lit(len(weights)), F.lit(float(grown_weight)))
        grown = F.when(new > F.col("__won.score"), F.lit(len(weights))).otherwise(F.col("__won.shard"))
    return won.select(*rest, F.col("__won.shard").alias("shard"), grown.alias("grown_shard"))


def with_slots(assigned: DataFrame, order: str) -> DataFrame:
    """Add ``slot``: the record's gapless place within its shard, in the order of a column.

    Works on rows in bounded blocks, so a shard of any size is numbered by many tasks.
    Keep texts out of ``assigned``: its rows are shuffled.
    """
    return numbered(assigned, ["shard"], [F.col(f"`{order}`")], "slot")


@query("op4_rendezvous_shards")
def op4_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard among 40 equal ones, its slot there, its shard among 41."""
    docs = read(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text").cast("bigint"), F.lit(0)) + 16
    slim = docs.select(
        "doc_id",
        size.cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    # The range exchange samples its input first: let it read these few columns, not the texts.
    assigned = cut_lineage(assign_shards(slim, "doc_id", [1.0] * SHARDS, 1.0))
    return with_slots(assigned, "doc_id").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
