"""A corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Every stage is written as Parquet in the shared folder and read again by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens.llm import decontam, jaccard, langid, linededup, packing, simhash
from merchlens.session import cut_lineage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; those without letters or without a majority language go."""
    return langid.keep_determined(docs, langid.fit_open(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; n_chars follows the text.

    Copies of a text count once: they are left to near-dedup.
    """
    cleaned = linededup.drop_boilerplate(docs, copies_once=True)
    n_chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
    return cleaned.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints within 3 bits (as in op3), or 0.8 or more of their five-word shingles in common."""
    return simhash.keep_one_per_group(docs, groups_of=jaccard.near_copy_groups, prints_of=jaccard.names)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in token sequences."""
    return packing.pack_documents(docs, special=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

# Language mixtures, fingerprints of hashes and byte-pair tokens are beyond SQL; the tests
# hold run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
