"""Exact deduplication by a tree-merge of sorted digest runs, in DataFrame operations only.

A scan partition's digests, sorted, are a run. Runs meet in rounds along a binomial tree: in round
*r* the runs whose numbers differ only in the ``FAN_BITS`` bits from ``r * FAN_BITS`` on send their rows
to the lowest of them, which merges the ``2 ** FAN_BITS`` sorted streams (a multiway merge). Every merge
keeps of each digest one entry with the verified smallest and largest identifier: an entry counts
for a digest only together with the text's byte length and a second, independent hash, which must
be equal at every level. After ``RUN_BITS / FAN_BITS`` rounds run 0 is left, in which every digest stands once.

The exchange spreads a run's digests over tasks, and a task merges its share of the runs in digest
order. Rows are combined before each exchange, so a group of copies, however large, is at most one row
for each run.

On the way back, groups that hold more than one row in ``HEAVY`` (at most ``HEAVY`` of them, whatever
the size of the input) are broadcast; all others join by digest with no key above that share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.text import lower_ascii, text_of
from fleetlens.plans.shared import cut

#: A group counts as heavy above one row in so many, hence there are at most so many of them.
HEAVY = 1000

KEY = ["digest", "n_bytes", "check"]
#: At most 2 ** RUN_BITS runs (scan partitions share one beyond that); 2 ** FAN_BITS meet in a merge.
RUN_BITS, FAN_BITS = 8, 4


def with_digest(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """One row per document: id, SHA-256 of the normalised text, its length and a second hash."""
    base = docs.select(F.col("doc_id"), (lower_ascii(text_of()) if text is None else text).alias("t"))
    return base.select("doc_id", F.sha2("t", 256).alias("digest"), F.octet_length("t").cast("long").alias("n_bytes"), F.xxhash64("t").alias("check"))


def first_runs(digests: DataFrame) -> DataFrame:
    """Every row as an entry of its scan partition's run: ``run, digest, n_bytes, check, low, high, rows``."""
    run = F.pmod(F.spark_partition_id(), F.lit(1 << RUN_BITS))
    return digests.select(run.alias("run"), *KEY, F.struct("doc_id").alias("low"), F.struct("doc_id").alias("high"), F.lit(1).cast("long").alias("rows"))


def merge_round(level: DataFrame, turn: int) -> DataFrame:
    """One round: the runs that differ in this round's bits meet in the lowest of them.

    The identifiers are kept as structs, for which Spark aggregates sorted rows: each scan of a run
    is sorted by (run, digest), combined, exchanged and merged in that order.
    """
    target = F.shiftleft(F.shiftright("run", (turn + 1) * FAN_BITS), (turn + 1) * FAN_BITS)
    merged = level.withColumn("run", target).groupBy("run", *KEY)
    low = F.min(F.when(F.col("low.doc_id").isNotNull(), F.col("low"))).alias("low")
    return merged.agg(low, F.max("high").alias("high"), F.sum("rows").alias("rows"))


def merge_runs(digests: DataFrame) -> DataFrame:
    """Tree-merge the digest runs: one row per group with its smallest and largest id and its size."""
    level = first_runs(digests)
    for turn in range(-(-RUN_BITS // FAN_BITS)):
        level = merge_round(level, turn)
    return level.select(*KEY, F.col("low.doc_id").alias("first_id"), F.col("high.doc_id").alias("last_id"), F.col("rows").alias("group_size"))


def exact_dedup(docs: DataFrame, keep: str = "last", text: Column | None = None) -> DataFrame:
    """Group documents whose normalised texts are equal; the last (or first) id of a group stays.

    Input ``docs(doc_id, text, ...)``; other columns are ignored. Null text counts as empty, so
    null and empty texts are one group. Repeated rows (same id and text) each count in
    ``group_size``; the copies of the kept id all have ``kept`` true. A null id never wins
    unless its whole group has none, when ``keep_id`` is null and ``kept`` false. An empty table
    gives an empty result.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``.
    """
    d = cut(with_digest(docs, text))
    groups = cut(merge_runs(d))
    total = d.count()
    keeper = F.col("last_id" if keep == "last" else "first_id").alias("keep_id")
    slim = groups.select(*KEY, keeper, "group_size")
    heavy = slim.where(F.col("group_size") * HEAVY > total)
    light_docs = d.join(F.broadcast(heavy.select(*KEY)), KEY, "left_anti")
    out = d.join(F.broadcast(heavy), KEY).unionByName(light_docs.join(slim, KEY))
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.col("digest").alias("text_sha256"))


def keep_rows(docs: DataFrame, drop: DataFrame, twice: DataFrame, keys: dict[str, Column], most: int) -> DataFrame:
    """``docs`` without the rows whose ``keys`` are in ``drop``, and with one row for each key in ``twice``.

    Up to ``most`` keys are broadcast, so the texts needn't move; more are joined by a shuffle.
    """
    marked = docs.withColumns(keys)
    names = list(keys)

    def side(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= most else ids.hint("merge")

    drop, twice = cut(drop.select(*names).distinct()), cut(twice.select(*names).distinct())
    stay = marked.join(side(drop), names, "left_anti")
    if not twice.isEmpty():
        stay = stay.join(side(twice), names, "left_anti").unionByName(stay.join(side(twice), names, "left_semi").dropDuplicates(names))
    return stay.select(*[stay[f"`{c}`"] for c in docs.columns])


def keep_one(docs: DataFrame, keep: str = "last") -> DataFrame:
    """The documents that stay, with their own columns; of repeated rows with the kept id, one stays.

    A group whose ids are all null keeps all its rows: nothing tells them apart.
    """
    none = F.lit(-(2**63)).cast("long")
    keys = {"__dedup_id": F.coalesce(F.col("doc_id"), none), "__dedup_digest": F.unhex(F.sha2(lower_ascii(text_of()), 256))}
    verdict = cut(exact_dedup(docs, keep).select(F.coalesce("doc_id", none).alias("__dedup_id"), F.unhex("text_sha256").alias("__dedup_digest"), "kept", F.col("keep_id").isNotNull().alias("named")))
    twice = verdict.where("kept").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return keep_rows(docs, verdict.where("named and not kept"), twice, keys, most=200_000)
