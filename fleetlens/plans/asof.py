"""As-of joins without one sorted run a key: the last value before a time, in two levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Time is cut into so many buckets, at quantiles, so that they hold about as many rows each.
BUCKETS = 256


def last_before(asked: DataFrame, known: DataFrame, by: list[str], time: str, value: str, buckets: int = BUCKETS) -> DataFrame:
    """Of each ``asked(*by, time)`` the ``value`` of the last ``known(*by, time, value)`` strictly before it, or null.

    Of known rows of one time the greatest value counts. Each time of a key is one row, then: a bucket's
    last value, carried over the buckets of a key (``buckets`` rows at most), is what stands before its
    successor; within a bucket a window goes on from there. So no task sorts a key's whole history.
    Returns the distinct ``(*by, time)`` of ``asked`` with ``value``; rows with a null time get null.
    """
    k = known.where(F.col(time).isNotNull()).groupBy(*by, time).agg(F.max(value).alias("v"))
    rows = k.withColumn("asked", F.lit(False)).unionByName(asked.select(*by, time).distinct().withColumn("asked", F.lit(True)), allowMissingColumns=True)
    rows = rows.groupBy(*by, time).agg(F.max("v").alias("v"), F.max("asked").alias("asked"))
    cuts = rows.agg(F.approx_percentile(F.unix_micros(F.col(time).cast("timestamp")), [i / buckets for i in range(1, buckets)], F.lit(10_000))).first()[0] or []
    at = F.unix_micros(F.col(time).cast("timestamp"))
    rows = rows.withColumn("bucket", F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<bigint>"), lambda c: c < at)))
    last = rows.where(F.col("v").isNotNull()).groupBy(*by, "bucket").agg(F.max_by("v", time).alias("last"))
    every = rows.select(*by, "bucket").distinct().join(last, [*by, "bucket"], "left")
    earlier = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = every.select(*by, "bucket", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    within = Window.partitionBy(*by, "bucket").orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("here", F.last("v", ignorenulls=True).over(within)).where("asked").join(every, [*by, "bucket"])
    return rows.select(*by, time, F.when(F.col(time).isNotNull(), F.coalesce("here", "carried")).alias(value))
