"""Strongly connected components by colours, over all scopes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.plans.fixpoint import NEAR
from fleetlens.plans.shared import Scratch

ID = ["scope", "node"]


def strong_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``scope, node, component``: the nodes on cycles, with the smallest node of their component.

    ``nodes(scope, node)``, ``edges(scope, parent, child)``; edges to unknown nodes are ignored. A round
    first takes away nodes without a parent or without a child, all that are left of them at once, until
    none is. Then every node takes the smallest id that reaches it as its colour, and of each colour the
    nodes that reach that id back are one component. All colours, hence all scopes and all unrelated
    components, are settled in one round. A loop is a cycle of one node. While many edges are left no side of
    a join is broadcast: Spark would go by the tables' compressed bytes, and send one to the driver at each step.
    """
    scratch = Scratch(nodes.sparkSession)
    known = nodes.select(*ID).distinct()
    e = edges.select("scope", "parent", "child").distinct()
    by = lambda side, rows: side.hint("merge") if rows > NEAR else side
    size = known.count()
    e = e.join(by(known.select("scope", F.col("node").alias("parent")), size), ["scope", "parent"], "left_semi").join(by(known.select("scope", F.col("node").alias("child")), size), ["scope", "child"], "left_semi")
    e = scratch.table(e, "edges")
    loops = scratch.table(e.where("parent = child").select("scope", F.col("parent").alias("node")), "loops")
    e = scratch.table(e.where("parent <> child"), "edges")
    found = None
    for turn in range(max_rounds):
        size = e.count()
        while size:  # trim: edges whose parent has no parent or whose child has no child
            has_parent, has_child = e.select("scope", F.col("child").alias("parent")).distinct(), e.select("scope", F.col("parent").alias("child")).distinct()
            e = scratch.table(e.join(by(has_parent, size), ["scope", "parent"], "left_semi").join(by(has_child, size), ["scope", "child"], "left_semi"), "edges")
            left = e.count()
            if left == size:
                break
            size = left
        if not size:
            break
        colour = scratch.table(e.select("scope", F.col("parent").alias("node")).union(e.select("scope", "child")).distinct().withColumn("colour", F.col("node")), "colour")
        while True:  # one table a step: colours, and what they were
            came = colour.join(by(e.withColumnRenamed("parent", "node"), size), ID).select("scope", F.col("child").alias("node"), "colour")
            lower = colour.select(*ID, "colour", F.col("colour").alias("was")).unionByName(came, allowMissingColumns=True)
            colour = scratch.table(lower.groupBy(*ID).agg(F.min("colour").alias("colour"), F.max("was").alias("was")), "colour")
            if colour.where("colour < was").isEmpty():
                break
        same = e.join(by(colour.select("scope", F.col("node").alias("parent"), F.col("colour").alias("c1")), size), ["scope", "parent"])
        same = same.join(by(colour.select("scope", F.col("node").alias("child"), F.col("colour").alias("c2")), size), ["scope", "child"])
        same = scratch.table(same.where("c1 = c2").select("scope", "parent", "child"), "same")
        back = scratch.table(colour.where("node = colour").select("scope", "node", F.col("colour").alias("component"), F.lit(0).alias("at")), "back-0")
        frontier, every, hops = back, back, 0
        while True:
            hops += 1
            new = frontier.join(by(same.withColumnRenamed("child", "node"), size), ID).select("scope", F.col("parent").alias("node"), "component").distinct()
            frontier = scratch.table(new.join(by(every.select(*ID), size), ID, "left_anti").withColumn("at", F.lit(hops)), f"back-{hops}")
            if frontier.isEmpty():
                break
            every = every.unionByName(frontier)
        done = scratch.table(every.drop("at"), f"done-{turn}")
        sizes = done.groupBy("scope", "component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        own = scratch.table(done.join(by(sizes, size), ["scope", "component"], "left_semi").select("scope", "node", "component"), f"found-{turn}")
        found = own if found is None else found.unionByName(own)
        settled = done.select(*ID)
        e = e.join(by(settled.select("scope", F.col("node").alias("parent")), size), ["scope", "parent"], "left_anti").join(by(settled.select("scope", F.col("node").alias("child")), size), ["scope", "child"], "left_anti")
        e = scratch.table(e, "edges")
        scratch.drop(*[f"back-{h}" for h in range(hops + 1)], f"done-{turn}")
    else:
        raise ValueError(f"components aren't settled after {max_rounds} rounds")
    alone = loops.withColumn("component", F.col("node"))
    if found is None:
        return alone.select("scope", "node", "component")
    return found.unionByName(alone.join(found.select(*ID), ID, "left_anti").select("scope", "node", "component"))
