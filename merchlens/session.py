"""Session defaults and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on.  Anything sized for one machine (master,
# memory, shuffle partitions) stays with the caller; AQE resizes at runtime.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A side is broadcast only below this size; above it Spark shuffles.
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def get_session(app: str = "merchlens", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if not _one_machine(spark.sparkContext.master):
        ship_package(spark)
    return spark


def _one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def ship_package(spark: SparkSession) -> str:
    """Give the executors this package, so that its Python functions can run there.

    Spark itself carries the archive; nothing reads the driver's folder.  Needless where the
    package is installed on the cluster (see pyproject.toml), and harmless there.
    """
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="merchlens-ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    return str(archive)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only on one machine (tests) may it be unset; a temporary folder is used then. On a
    cluster a folder local to each machine would lose rows silently, so that raises.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not _one_machine(sc.master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {sc.master}")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="merchlens-ckpt-"))
    return sc.getCheckpointDir()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write the rows once to the shared folder and read them back.

    A table is used rather than an RDD checkpoint: it is computed once, is columnar
    and compressed, lets later filters and column choices reach the scan, and its
    size is known, so joins with it are planned by size.  Losing an executor costs
    a re-read, never a recomputation.  `release` deletes the tables of a session;
    ending the interpreter does so too.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
    if not _WRITTEN:
        atexit.register(_release_at_exit)
    _WRITTEN.append((weakref.ref(spark), path))
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Within the block, tables go to Python in batches of at most so many rows: for rows of some kB.

    The memory that a batch took outside the heap stays with the executor.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


_WRITTEN: list = []


def drop_table(df: DataFrame) -> None:
    """Delete the table that `cut_lineage` wrote for this frame, once nothing reads it any more."""
    files = df.inputFiles()[:1]
    for entry in [e for e in _WRITTEN if any(f"/{Path(e[1]).name}/" in f for f in files)]:
        _delete(df.sparkSession, entry[1])
        _WRITTEN.remove(entry)


def release(spark: SparkSession) -> int:
    """Delete every intermediate table `cut_lineage` wrote for this session; returns how many."""
    mine = [(ref, path) for ref, path in _WRITTEN if ref() is spark]
    for entry in mine:
        _delete(spark, entry[1])
        _WRITTEN.remove(entry)
    return len(mine)


def _release_at_exit() -> None:
    for ref, path in _WRITTEN:
        spark = ref()
        # A stopped context has taken its gateway along; its tables stay for the folder's owner.
        if spark is not None and spark.sparkContext._jsc is not None:
            _delete(spark, path)
