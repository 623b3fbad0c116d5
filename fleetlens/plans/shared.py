"""Where a job may leave intermediate tables so that every executor can read them."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``.

    Where none is set, a temporary folder serves a session on one machine; on a cluster, whose
    executors couldn't read it, this raises.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not where:
        where = context.getCheckpointDir()
    if not where:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="fleetlens-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small or iterated frame with a reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/fleetlens/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one job in the shared folder; a table that is written anew replaces its predecessor.

    The predecessor's files go once the successor is written, so a frame that still reads the
    former must not be used after that. A job that iterates then holds two versions at most.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/fleetlens/{uuid.uuid4().hex}"
        self.version: dict[str, int] = {}

    def table(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write ``df``, in folders ``by`` a column if one is given, and read it back; then delete what ``name`` held before."""
        last = self.version.get(name, -1)
        path = f"{self.root}/{name}-{last + 1}"
        df.write.parquet(path, partitionBy=by)
        self.drop(name)
        self.version[name] = last + 1
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more; their names may be used again."""
        for name in names:
            if name in self.version:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}-{self.version[name]}")
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of rows that may be long texts: fewer rows, and bytes bounded where Spark can.

    This changes the session's batch size and no result.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def release_memory() -> None:
    """At the end of a Python task: give freed memory back, since idle workers stay with their executor."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
