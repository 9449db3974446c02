"""Scans with fixed schemas and one-pass contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_CATALOG = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "uniq_id",
            "crawl_timestamp",
            "product_url",
            "product_name",
            "product_category_tree",
            "pid",
            "retail_price",
            "discounted_price",
            "image",
            "is_FK_Advantage_product",
            "description",
            "product_rating",
            "overall_rating",
            "brand",
            "product_specifications",
        )
    ]
)

CANONICAL = (
    "product_id",
    "product_name",
    "category",
    "brand",
    "retail_price",
    "discounted_price",
    "rating",
    "description",
    "product_specifications",
    "product_url",
    "retrieval_text",
    "embedding",
    "embedding_model",
)


class ContractError(ValueError):
    """A source does not satisfy its declared contract."""


def table(spark: SparkSession, directory: str, name: str, spread: bool = False) -> DataFrame:
    """Parquet scan.  ``spread`` evens out a table with fewer splits than cores.

    That is a small table under per-row work heavy enough to want every core; a
    table with enough splits is never shuffled.
    """
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def _strip_bom(df: DataFrame) -> DataFrame:
    first = df.columns[0]
    return df.withColumnRenamed(first, first.lstrip("﻿"))


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType = RAW_CATALOG, multi_line: bool = False
) -> DataFrame:
    """S01/S06. CSV with header and an optional byte-order mark.

    Columns are matched by header name, so the declared schema may list them in any
    order; a missing column or an empty file is an error.  All values are read as text and
    cast, so nothing is inferred from the data.  Files are split among tasks unless
    ``multi_line`` says that quoted fields hold newlines; then each file is one task.
    """
    options = {"header": True, "escape": '"', "multiLine": multi_line, "inferSchema": False}
    raw = _strip_bom(spark.read.options(**options).csv(path))
    missing = [f.name for f in schema if f.name not in raw.columns]
    if missing:
        raise ContractError(f"CSV lacks columns {missing}")
    if raw.isEmpty():
        raise ContractError(f"CSV {path} has no rows")
    return raw.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S05. One JSON object per line; any bad line fails the scan."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(
        "value",
        F.from_json(
            "value",
            T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())]),
            {"columnNameOfCorruptRecord": "_corrupt_record"},
        ).alias("row"),
    )
    bad = parsed.agg(
        F.count_if(
            F.col("row._corrupt_record").isNotNull() | ~F.ltrim("value").startswith("{")
        ).alias("n")
    ).first()["n"]
    if bad:
        raise ContractError(f"{bad} line(s) of {path} are not JSON objects")
    return parsed.select([F.col(f"row.{f.name}").alias(f.name) for f in schema])


def schema_report(df: DataFrame, expected: list[str]) -> DataFrame:
    """S02. One row per expected or present field, with its type and non-null count."""
    names = list(dict.fromkeys([*expected, *df.columns]))
    types = dict(df.dtypes)
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in set(df.columns)]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("field"),
                F.lit(types.get(n)).cast("string").alias("dtype"),
                F.lit(n in types).alias("present"),
                F.lit(n in expected).alias("expected"),
                F.lit(df.columns.count(n) > 1).alias("duplicated"),
                (F.col(f"`{n}`") if n in types else F.lit(None)).cast("bigint").alias("non_null"),
                F.col("_rows").alias("row_count"),
            )
            for n in names
        ]
    )
    return counts.select(F.inline(rows))


def catalog_contract(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """S03. Row count, id uniqueness and text presence in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct(id_col).alias("distinct_ids"),
        F.count_if(F.col(id_col).isNull()).alias("null_ids"),
        F.count_if(F.coalesce(F.trim(text_col), F.lit("")) == "").alias("blank_texts"),
    ).withColumn(
        "ok",
        (F.col("row_count") > 0)
        & (F.col("distinct_ids") == F.col("row_count"))
        & (F.col("blank_texts") == 0),
    )


def read_catalog(
    spark: SparkSession,
    path: str,
    columns: list[str],
    id_col: str = "product_id",
    text_col: str = "retrieval_text",
    expected_rows: int | None = None,
) -> DataFrame:
    """S03/S04. Pruned Parquet scan that fails when the contract fails."""
    df = spark.read.parquet(path)
    missing = [c for c in {*columns, id_col, text_col} if c not in df.columns]
    if missing:
        raise ContractError(f"catalog lacks columns {sorted(missing)}")
    report = catalog_contract(df, id_col, text_col).first()
    if not report["ok"] or expected_rows not in (None, report["row_count"]):
        raise ContractError(f"catalog contract failed: {report.asDict()}")
    return df.select(*columns)
