"""Following run journals as Structured Streaming queries: X1, X6, X7. The fold (X2, X4, X5) is in ``live``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import runs
from fleetlens.plans.shared import checkpoint_dir
from fleetlens.sources.artifacts import parse_journal


def stream_journals(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Journal lines as they are flushed, one file a flush; the checkpoint keeps the place."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True).text(folder)
    return lines.withColumn("scope", F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2), "^scope=", ""))


def events(lines: DataFrame) -> DataFrame:
    """The readable events of a stream of lines; a repeated (run, seq) within an hour counts once."""
    e, _ = parse_journal(lines)
    return e.withWatermark("at", "1 hour").dropDuplicatesWithinWatermark(["scope", "run_id", "seq"])


def unreadable_lines(lines: DataFrame) -> DataFrame:
    """The running count of lines that can't be read, per scope (update or complete mode)."""
    return parse_journal(lines)[1]


def run_activity(e: DataFrame, duration: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Windows over event time; in append mode a window comes when the watermark passes it."""
    return runs.activity(e, duration, slide)


def follow(df: DataFrame, name: str, mode: str):
    """All that is there now, into a memory table; the checkpoint is in the shared folder."""
    where = f"{checkpoint_dir(df.sparkSession)}/streams/{name}"
    return df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", where).trigger(availableNow=True).start()
