"""Snapshots, ledgers and health records as tables that are written once however often they are sent.

Rows are partitioned by scope and run (or record), and a write replaces just the partitions that it holds, so a
job that is retried leaves what it left before. Partitions of others stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class RunTable:
    """A Parquet table in ``path``, partitioned by ``scope`` and ``key``; ``schema`` is that of all columns."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str = "run_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def read(self) -> DataFrame:
        """All rows; none before the first write."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(self.schema).option("pathGlobFilter", "*.parquet").parquet(self.path)
        return found.select(*self.schema.fieldNames())

    def write(self, rows: DataFrame) -> None:
        """Write ``rows``; what was there of their scopes and runs is replaced."""
        out = rows.select(*self.schema.fieldNames())
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scope", self.key).parquet(self.path)


SNAPSHOT = "scope string, run_id string, snapshot_id bigint, parent bigint, created_at timestamp"


class SnapshotTable(RunTable):
    """A chain of snapshots a scope; a snapshot is appended only onto the head."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, SNAPSHOT)

    def heads(self) -> DataFrame:
        """``scope, head, run_id``: the snapshot that is no other's parent; of several the latest, then the largest id."""
        rows = self.read()
        parents = rows.where(F.col("parent").isNotNull()).select("scope", F.col("parent").alias("snapshot_id"))
        ends = rows.join(parents, ["scope", "snapshot_id"], "left_anti")
        return ends.groupBy("scope").agg(F.max_by(F.struct("snapshot_id", "run_id"), F.struct("created_at", "snapshot_id")).alias("h")).select("scope", F.col("h.snapshot_id").alias("head"), F.col("h.run_id").alias("run_id"))

    def append(self, candidates: DataFrame) -> DataFrame:
        """Write the candidates that extend their scope's head; ``scope, run_id, snapshot_id, verdict`` of all.

        ``accepted``, ``already_there`` (the run has that snapshot), or ``conflict``: another parent than the
        head, or another candidate of the scope came first (the smallest id goes). Sending accepted ones again
        changes nothing.
        """
        had = self.read().select("scope", "run_id", "snapshot_id", F.lit(True).alias("there"))
        j = candidates.join(had, ["scope", "run_id", "snapshot_id"], "left").join(self.heads().select("scope", "head"), "scope", "left")
        fits = F.col("there").isNull() & F.col("parent").eqNullSafe(F.col("head"))
        first = F.row_number().over(Window.partitionBy("scope", fits).orderBy("snapshot_id", "run_id")) == 1
        verdict = F.when(F.col("there"), "already_there").when(fits & first, "accepted").otherwise("conflict")
        told = j.withColumn("verdict", verdict).select(*StructType.fromDDL(SNAPSHOT).fieldNames(), "verdict").checkpoint(eager=True)
        self.write(told.where("verdict = 'accepted'"))
        return told.select("scope", "run_id", "snapshot_id", "verdict")


def health_table(spark: SparkSession, path: str) -> RunTable:
    """Health records ``(scope, record, at, node, check, severity, status)``; a record is written whole."""
    return RunTable(spark, path, "scope string, record string, at timestamp, node string, check string, severity string, status string", key="record")


def latest_record(records: DataFrame) -> DataFrame:
    """The findings of each scope's newest record (ties: the larger name)."""
    newest = records.groupBy("scope").agg(F.max_by("record", F.struct("at", "record")).alias("record"))
    return records.join(newest, ["scope", "record"], "left_semi")
