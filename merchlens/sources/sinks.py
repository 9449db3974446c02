"""Publishing, loading and index persistence."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens.session import shared_folder
from merchlens.sources.readers import CANONICAL, ContractError, catalog_contract


def content_hash(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """I07. Order-independent content fingerprint: row count and a hash sum.

    The sum is taken as decimal so that it neither overflows nor depends on order.
    """
    types = dict(df.dtypes)

    def plain(c: str):
        # Maps cannot be hashed; their text can.
        return F.to_json(F.struct(F.col(c))) if "map<" in types[c] else F.col(c)

    h = F.xxhash64(*[plain(c) for c in columns or df.columns]).cast("decimal(38,0)")
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("content_hash"),
    )


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def promote(spark: SparkSession, staging: str, path: str) -> None:
    """Rename a finished staging folder to its place; refuse if something is there.

    The rename itself refuses a taken target, so a writer that comes in between the look
    and the rename loses nothing and is not mixed with this one.
    """
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise ContractError(f"refusing to overwrite {path}")
    fs.mkdirs(target.getParent())
    hadoop, gateway = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._gateway
    files = hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    no_options = gateway.new_array(hadoop.fs.Options.Rename, 0)
    try:
        files.rename(fs.makeQualified(_fs(spark, staging)[1]), fs.makeQualified(target), no_options)
    except Py4JJavaError as refused:
        raise ContractError(f"could not promote {staging}: {refused.java_exception.getMessage()}") from refused


def publish(
    df: DataFrame, path: str, id_col: str = "product_id", text_col: str = "retrieval_text"
) -> DataFrame:
    """S07. Refuse a taken target, write a staging copy, read it back, check it, promote it."""
    spark = df.sparkSession
    if exists(spark, path):
        raise ContractError(f"refusing to overwrite {path}")
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    df.write.parquet(staging)
    report = catalog_contract(spark.read.parquet(staging), id_col, text_col).first()
    if not report["ok"]:
        raise ContractError(f"staged catalog rejected: {report.asDict()}")
    promote(spark, staging, path)
    return spark.read.parquet(path)


def write_new(df: DataFrame, path: str, fmt: str = "json") -> None:
    """S08. JSONL or CSV sink that never overwrites."""
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        kept = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        writer.options(**kept).csv(path)
    else:
        writer.option("ignoreNullFields", False).json(path)


def load_empty(df: DataFrame, path: str, key: str) -> DataFrame:
    """S09. Load a table that must be empty, all rows or none.

    The target may be missing or hold no rows; anything else is refused.  Rows are
    staged and counted, keys must be there and unique, then the staging folder takes
    the target's place.  A load that fails leaves the target as it was.
    """
    spark = df.sparkSession
    there = exists(spark, path)
    if there and not spark.read.parquet(path).isEmpty():
        raise ContractError(f"{path} is not empty")
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    df.write.parquet(staging)
    back = spark.read.parquet(staging)
    seen = back.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("keys")).first()
    if seen["n"] != seen["keys"]:
        raise ContractError(f"{seen['n'] - seen['keys']} row(s) lack a key of their own")
    if there:
        fs, target = _fs(spark, path)
        fs.delete(target, True)
    promote(spark, staging, path)
    return spark.read.parquet(path)


def shape_for_load(df: DataFrame) -> DataFrame:
    """S10. NaN and blank to NULL, trimmed text, decimals, specs as JSON text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if kind == "string":
            c = F.nullif(F.trim(c), F.lit(""))
        elif kind in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        elif kind == "array" and f.dataType.elementType.typeName() == "struct":
            c = F.to_json(c, {"ignoreNullFields": "false"})
        if f.name in ("retail_price", "discounted_price"):
            c = c.cast("decimal(10,2)")
        elif f.name == "rating":
            c = c.cast("decimal(3,2)")
        out.append(c.alias(f.name))
    return df.select(*out)


def unmatched_vectors(products: DataFrame, vectors: DataFrame) -> DataFrame:
    """S11. (product_id, problem) of products without exactly one vector and vectors without a product."""
    p = products.groupBy("product_id").agg(F.count(F.lit(1)).alias("_p"))
    v = vectors.groupBy("product_id").agg(F.count("embedding").alias("_v"))
    both = p.join(v, "product_id", "full_outer").fillna(0, ["_p", "_v"])
    problem = (
        F.when(F.col("_p") == 0, "NO_PRODUCT")
        .when(F.col("_p") > 1, "DUPLICATE_PRODUCT")
        .when(F.col("_v") == 0, "NO_VECTOR")
        .when(F.col("_v") > 1, "DUPLICATE_VECTOR")
    )
    return both.select("product_id", problem.alias("problem")).filter(F.col("problem").isNotNull())


def assemble_knowledge_base(
    products: DataFrame, vectors: DataFrame, model: str, columns: tuple[str, ...] = CANONICAL
) -> DataFrame:
    """S11. Attach vectors by key and fix the column order; refuse what does not match.

    Every product needs exactly one vector and every column of ``columns`` must be there:
    nothing is dropped silently.
    """
    made = {"embedding", "embedding_model"}
    missing = [c for c in columns if c not in products.columns and c not in made]
    if missing:
        raise ContractError(f"products lack columns {missing}")
    wrong = unmatched_vectors(products, vectors).groupBy("problem").count().collect()
    if wrong:
        raise ContractError(f"products and vectors differ: {[(r['problem'], r['count']) for r in wrong]}")
    joined = products.join(vectors, "product_id", "left").withColumn("embedding_model", F.lit(model))
    return joined.select(*columns)


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, modified) of the data files below a path, from the listing alone."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    return listed.load(path).select(
        F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")
    )


MANIFEST = "table string, row_count bigint, content_hash string, files bigint, bytes bigint"


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    """S12. Store tables under one path with a manifest, or refuse if the path exists.

    Everything is written to a staging folder of its own and renamed at the end, so
    readers see all tables or none where the file system renames atomically (HDFS and
    local ones do; object stores copy, and there the manifest, written last, decides).
    """
    spark = next(iter(tables.values())).sparkSession
    if exists(spark, path):
        raise ContractError(f"refusing to overwrite {path}")
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    rows = []
    for name, df in tables.items():
        df.write.parquet(f"{staging}/{name}")
        stored = content_hash(spark.read.schema(df.schema).parquet(f"{staging}/{name}")).first()
        size = _size(spark, f"{staging}/{name}")
        rows.append((name, stored["row_count"], stored["content_hash"], *size))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(f"{staging}/_manifest.json")
    promote(spark, staging, path)


def load_tables(spark: SparkSession, path: str, verify: bool = False) -> dict[str, DataFrame]:
    """S12. The stored tables, checked against the manifest.

    File counts and sizes are compared from the listing; ``verify`` also reads every row
    and compares the content hash.
    """
    out = {}
    for r in spark.read.schema(MANIFEST).json(f"{path}/_manifest.json").collect():
        df = spark.read.parquet(f"{path}/{r['table']}")
        actual = _size(spark, f"{path}/{r['table']}")
        if actual != (r["files"], r["bytes"]):
            raise ContractError(f"{r['table']} does not match its manifest: {actual}")
        if verify and tuple(content_hash(df).first()) != (r["row_count"], r["content_hash"]):
            raise ContractError(f"{r['table']} does not match its manifest: other rows")
        out[r["table"]] = df
    return out


def _size(spark: SparkSession, path: str) -> tuple[int, int]:
    size = files_of(spark, path).agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")
    ).first()
    return size["files"], size["bytes"]


def save_index(postings: DataFrame, vocab: DataFrame, size: DataFrame, path: str) -> None:
    """S12. Postings in blocks of documents, sorted by term, with vocabulary, corpus size and manifest.

    A document's postings lie in one block, so a scan adds up its scores before anything
    is shuffled; statistics of the sorted files let a reader skip terms it does not ask for.
    """
    blocks = postings.repartition("doc_id").sortWithinPartitions("term", "doc_id")
    save_tables({"postings": blocks, "vocab": vocab, "size": size}, path)


def stored(
    spark: SparkSession, directory: str, kind: str, inputs: list[str], make: Callable[[str], None]
) -> dict[str, DataFrame]:
    """The artifact ``kind`` of some input tables, made by ``make(path)`` where it is missing.

    It lives in the shared folder under a name that holds the files, sizes and times
    of its inputs: rewritten inputs get an artifact of their own.
    """
    seen = None
    for name in inputs:
        files = files_of(spark, f"{directory}/{name}.parquet")
        seen = files if seen is None else seen.unionByName(files)
    mark = seen.agg(F.sum(F.xxhash64("file", "bytes", "modified").cast("decimal(38,0)")).alias("m")).first()["m"]
    path = f"{shared_folder(spark)}/artifacts/{kind}-{int(mark) & (1 << 64) - 1:016x}"
    if not exists(spark, f"{path}/_manifest.json"):
        make(path)
    return load_tables(spark, path)
