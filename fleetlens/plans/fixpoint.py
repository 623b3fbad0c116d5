"""Level-synchronous fixpoints: every graph operator advances all scopes by one level at a time."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.plans.shared import cut

#: A frontier of at most so many rows is broadcast, so that a level scans the edges and doesn't shuffle them.
NEAR = 50_000


def near(frontier: DataFrame, rows: int) -> DataFrame:
    """``frontier``, which has so many rows, as a side to be broadcast if they are few, and else never: Spark goes by compressed bytes."""
    return F.broadcast(frontier) if rows <= NEAR else frontier.hint("merge")


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], max_iter: int = 1000) -> DataFrame:
    """All rows reachable from ``seed``: ``step`` maps a frontier to candidate rows.

    A row is new if its ``keys`` weren't seen. Each level is cut from its lineage by a reliable
    checkpoint; what was seen grows by unions of checkpointed levels. Small frontiers and candidates are
    broadcast to the edges and to what was seen, so that a level doesn't shuffle either.
    """
    frontier = cut(seed.dropDuplicates(keys))
    seen, rows = frontier, frontier.count()
    for _ in range(max_iter):
        came = step(near(frontier, rows)).dropDuplicates(keys).select(*seen.columns)
        known = seen.select(*keys).hint("merge")
        if rows <= NEAR:
            came = cut(came)
            rows = came.count()
            if not rows:
                return seen
            if rows <= NEAR:
                known = F.broadcast(seen.select(*keys).join(near(came.select(*keys), rows), keys, "left_semi"))
        new = cut(came.join(known, keys, "left_anti").select(*seen.columns))
        rows = new.count()
        if not rows:
            return seen
        seen, frontier = seen.unionByName(new), new
    raise ValueError(f"no fixpoint after {max_iter} levels")


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The longest-path depth of every node: ``nodes(scope, node)``, ``edges(scope, parent, child)``.

    Edges to unknown ids are ignored and duplicates count once. Peels the nodes whose parents
    are all placed; nodes on or behind a cycle are never placed and are left out. Each node and
    edge is settled in one level: an edge brings along how many parents its child has, so a level joins
    the edges with its nodes and touches only the children that it reaches.
    """
    ids = ["scope", "node"]
    known = nodes.select(*ids).distinct()
    e = edges.select("scope", "parent", "child").distinct()
    e = e.join(known.select("scope", F.col("node").alias("parent")), ["scope", "parent"], "left_semi").join(known.select("scope", F.col("node").alias("child")), ["scope", "child"], "left_semi")
    e = cut(e.select("scope", "parent", "child"))
    need = e.groupBy("scope", "child").agg(F.count(F.lit(1)).alias("need"))
    e = cut(e.join(need, ["scope", "child"]).select("scope", F.col("parent").alias("node"), "child", "need"))
    ready = cut(known.join(need.select("scope", F.col("child").alias("node")), ids, "left_anti"))
    rows, placed, waiting = ready.count(), None, None
    for depth in count():  # every level places a node or is the last
        if not rows:
            break
        level = ready.withColumn("depth", F.lit(depth))
        placed = level if placed is None else placed.unionByName(level)
        met = e.join(near(ready, rows), ids).select("scope", F.col("child").alias("node"), "need", F.lit(1).cast("long").alias("have"))
        if waiting is not None:
            met = met.unionByName(waiting)
        met = cut(met.groupBy(*ids).agg(F.max("need").alias("need"), F.sum("have").alias("have")))
        ready, waiting = met.where("have = need").select(*ids), met.where("have < need")
        rows = ready.count()
    return placed if placed is not None else known.withColumn("depth", F.lit(0)).limit(0)
