"""A stored table that takes changed rows by rewriting only the folders they lie in."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens.operators.integrity import upsert
from merchlens.session import cut_lineage
from merchlens.sources.readers import ContractError
from merchlens.sources.sinks import exists, promote

# Folders of a table, fixed when it is made: one for about ROWS_PER_BUCKET rows.
ROWS_PER_BUCKET, MAX_BUCKETS = 200_000, 4_096
LAYOUT = "key string, buckets int"


def _keyed(df: DataFrame, key: str, fields: list[str], buckets: int) -> DataFrame:
    """Key and fields with the folder and the content hash of each row."""
    content = F.sha2(F.to_json(F.struct(*fields)), 256).alias("row_hash")
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    return df.select(key, *fields, content, bucket)


def _one_row_each(df: DataFrame, key: str) -> None:
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("keys")).first()
    if seen["n"] != seen["keys"]:
        raise ContractError(f"{seen['n'] - seen['keys']} row(s) lack a key of their own")


def create_table(df: DataFrame, path: str, key: str, fields: list[str], now: Column, buckets: int | None = None) -> None:
    """Store ``df`` as a table of key, fields, created_at, updated_at; refuse a taken path or repeated keys.

    Rows lie in folders by a hash of the key, one file each, with a hash of their content.
    """
    spark = df.sparkSession
    if exists(spark, path):
        raise ContractError(f"refusing to overwrite {path}")
    _one_row_each(df, key)
    buckets = buckets or max(1, min(MAX_BUCKETS, -(-df.count() // ROWS_PER_BUCKET)))
    rows = _keyed(df, key, fields, buckets).withColumns({"created_at": now, "updated_at": now})
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    rows.repartition("bucket").write.partitionBy("bucket").parquet(staging)
    spark.createDataFrame([(key, buckets)], LAYOUT).coalesce(1).write.json(f"{staging}/_layout")
    promote(spark, staging, path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket", "row_hash")


def apply_changes(spark: SparkSession, path: str, incoming: DataFrame, fields: list[str], now: Column) -> DataFrame:
    """(action, rows): INSERTED, UPDATED, UNCHANGED and KEPT rows of the table after ``incoming``.

    Incoming rows meet the stored hashes, so only keys and hashes of the table are
    read to find the changes.  Only the folders that hold a change are read whole and
    replaced (dynamic partition overwrite); the files of all others stay as they are.
    """
    layout = spark.read.schema(LAYOUT).json(f"{path}/_layout").first()
    key, buckets = layout["key"], layout["buckets"]
    _one_row_each(incoming, key)
    table = spark.read.parquet(path)
    given = _keyed(incoming, key, fields, buckets)
    known = table.select("bucket", key, F.col("row_hash").alias("known"))
    action = (
        F.when(F.col("known").isNull(), "INSERTED").when(F.col("known") != F.col("row_hash"), "UPDATED").otherwise("UNCHANGED")
    )
    met = cut_lineage(given.join(known, ["bucket", key], "left").withColumn("action", action).drop("known"))
    changes = met.filter("action <> 'UNCHANGED'")
    counts = met.groupBy("action").agg(F.count(F.lit(1)).alias("rows"))
    stored = table.agg(F.count(F.lit(1)).alias("stored"))
    matched = met.agg(F.count_if(F.col("action") != "INSERTED").alias("matched"))
    kept = stored.join(matched).select(F.lit("KEPT").alias("action"), (F.col("stored") - F.col("matched")).alias("rows"))
    report = cut_lineage(counts.unionByName(kept))
    touched = [r["bucket"] for r in changes.select("bucket").distinct().collect()]  # at most MAX_BUCKETS
    if touched:
        old = table.filter(F.col("bucket").isin(touched))
        merged = upsert(old, changes, key, fields, now)
        rows = _keyed(merged, key, [*fields, "created_at", "updated_at"], buckets).drop("row_hash")
        content = F.sha2(F.to_json(F.struct(*fields)), 256)
        fresh = cut_lineage(rows.withColumn("row_hash", content).select(*table.columns))
        writer = fresh.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket").parquet(path)
    return report
