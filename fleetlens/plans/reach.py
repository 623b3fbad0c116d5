"""How much each node reaches, counted by bitmaps that travel along the edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.plans.shared import Scratch

ID = ["scope", "node"]
CHECKED = 8
#: A row of a bitmap: so many words of 64 bits. Short rows cost a task little memory where few bits are set.
WORDS = [f"w{i}" for i in range(8)]
BITS = 64 * len(WORDS)


def united(rows: DataFrame, no: Column) -> DataFrame:
    """The bitmaps of each ``no`` and bucket as one; longs under ``bit_or`` are hashed and combine before the shuffle."""
    return rows.groupBy(no.alias("no"), "bucket").agg(*[F.bit_or(w).alias(w) for w in WORDS])


def size() -> Column:
    """How many bits of a row are set."""
    return reduce(Column.__add__, [F.bit_count(w).cast("long") for w in WORDS])


def numbered(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``nodes`` with dense numbers from 0 in ``no``: a task's rows in order, after those of the tasks before it."""
    near = nodes.repartitionByRange(*ID).sortWithinPartitions(*ID)  # a scope's nodes share few bitmaps
    rows = scratch.table(near.withColumn("task", F.spark_partition_id()).withColumn("in_task", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = sorted((r["task"], r["n"]) for r in rows.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a task
    offsets, total = [], 0
    for task, n in sizes:
        offsets += [F.lit(task), F.lit(total)]
        total += n
    if not offsets:
        return rows.select(*nodes.columns, F.lit(0).cast("long").alias("no"))
    return rows.select(*nodes.columns, (F.element_at(F.create_map(*offsets), F.col("task")) + F.col("in_task")).cast("long").alias("no"))


def reach_counts(edges: DataFrame, max_levels: int = 10_000) -> DataFrame:
    """``scope, node, n``: how many other nodes each parent of ``edges(scope, parent, child)`` reaches.

    A node's descendants are bits, ``BITS`` to a row, so a row stands for that many (node, descendant) pairs.
    At each level the bitmaps of the last go from child to parent and are joined by ``bit_or``,
    which combines before the shuffle. Every ``CHECKED`` levels only what adds to the known goes on.
    Numbers are dense and follow scope and name, so a scope's nodes share few bitmaps. On
    a cycle a node reaches itself, which isn't counted.
    """
    scratch = Scratch(edges.sparkSession)
    e = edges.select("scope", "parent", "child").distinct()
    nodes = e.select("scope", F.col("parent").alias("node")).union(e.select("scope", "child")).distinct()
    no = scratch.table(numbered(nodes, scratch), "no")
    e = e.join(no.select("scope", F.col("node").alias("child"), F.col("no").alias("child_no")).hint("merge"), ["scope", "child"])
    e = scratch.table(e.join(no.select("scope", F.col("node").alias("parent"), F.col("no").alias("parent_no")).hint("merge"), ["scope", "parent"]).select("parent_no", "child_no"), "edges")
    at = F.col("child_no") % BITS
    word = lambda i: F.when(F.floor(at / 64) == i, F.expr("shiftleft(1L, cast(child_no % 64 as int))")).otherwise(F.lit(0).cast("long"))
    direct = e.select("parent_no", F.floor(F.col("child_no") / BITS).alias("bucket"), *[word(i).alias(w) for i, w in enumerate(WORDS)])
    new = scratch.table(united(direct, F.col("parent_no")), "level-0")
    known = new
    for level in range(1, max_levels):
        came = united(new.join(e.select(F.col("child_no").alias("no"), "parent_no").hint("merge"), "no"), F.col("parent_no"))
        if level % CHECKED:
            new = scratch.table(came, f"level-{level}")
        else:  # keep what adds to what was known, so that walks around a cycle end
            came = scratch.table(came, "came")
            had = united(known.join(came.select("no", "bucket").hint("merge"), ["no", "bucket"], "left_semi"), F.col("no"))
            both = came.unionByName(had.withColumn("was", size()), allowMissingColumns=True).groupBy("no", "bucket").agg(*[F.bit_or(w).alias(w) for w in WORDS], F.max("was").alias("was"))
            new = scratch.table(both.where(size() > F.coalesce("was", F.lit(0))).select("no", "bucket", *WORDS), f"level-{level}")
        if new.isEmpty():
            break
        known = known.unionByName(new)
    else:
        raise ValueError(f"reach isn't settled after {max_levels} levels")
    # on a cycle a node's own bit is set
    own = F.element_at(F.array(*WORDS), (F.floor(F.col("no") % BITS / 64) + 1).cast("int"))
    itself = F.when(F.col("bucket") == F.floor(F.col("no") / BITS), F.getbit(own, (F.col("no") % 64).cast("int"))).otherwise(0)
    n = united(known, F.col("no")).groupBy("no").agg(F.sum(size() - itself).alias("n"))
    return no.join(n.hint("merge"), "no").select(*ID, "n")
