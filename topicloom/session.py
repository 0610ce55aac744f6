"""Session-level helpers: the shared folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

# Bytes of a broadcast side, as its rows are in memory; Spark's own limit is 8 GB.
MAX_BROADCAST_BYTES = 320 * 2**20
ROW_OVERHEAD = 24
# Bytes of rows that Spark hands to a Python worker at once.  By default it is 64 MB or 10,000
# rows, which the executor, its pipe and the worker then hold at the same time.
BATCH_BYTES = 4 * 2**20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, visible to every executor.

    Only on a local master, as in tests, a temporary folder may take its place.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="topicloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result no longer depends on the jobs that made it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """Persist; a lost executor costs a recomputation, not the result."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Repartition by ``key`` an input that is read in fewer tasks than there are cores.

    Larger inputs are worked on where they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def row_bytes(df: DataFrame, text: int = 16, entries: int = 8) -> int:
    """An estimate of a row's size from its types: ``text`` bytes a string, ``entries`` a list."""

    def size(kind: T.DataType) -> int:
        if isinstance(kind, T.ArrayType):
            return 16 + entries * size(kind.elementType)
        if isinstance(kind, T.StructType):
            return 16 + sum(size(f.dataType) for f in kind)
        return 16 + text if isinstance(kind, (T.StringType, T.BinaryType)) else 8

    return ROW_OVERHEAD + size(df.schema)


def broadcast_if_small(
    df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES, width: int | None = None
) -> tuple[DataFrame, bool]:
    """Persist and count ``df``; hint a broadcast only when rows x width stays in ``max_bytes``.

    ``width`` is the size of a row, by default that of its types.
    """
    kept = keep(df)
    small = kept.count() * (width or row_bytes(df)) <= max_bytes
    return (F.broadcast(kept) if small else kept), small


def bound_batches(spark: SparkSession) -> None:
    """Batches of BATCH_BYTES in this session, unless it has a limit of its own."""
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, wherever they run, once for each Spark context, and
    batches of a bounded size."""
    bound_batches(spark)
    context = spark.sparkContext
    if getattr(context, "_topicloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="topicloom-"), "topicloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as target:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    target.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._topicloom_shipped = True


def path_exists(spark: SparkSession, path: str | None) -> bool:
    """True if ``path`` exists on whatever file system its scheme names; '' does not."""
    if not path:
        return False
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return file_system.exists(hadoop_path)


def table_complete(spark: SparkSession, path: str | None) -> bool:
    """True if the job that wrote ``path`` finished."""
    return bool(path) and path_exists(spark, f"{path.rstrip('/')}/_SUCCESS")
