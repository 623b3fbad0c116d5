"""Connected components as rounds of joins: no neighbour list is ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.plans.shared import Scratch


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Map every node of ``edges(a, b)`` to the smallest node it reaches.

    Alternates the "large star" and "small star" contractions (Kiveris et al., 2014). Each is
    one aggregate (``min`` combines map-side) and one equi join, so a hub with a third of all
    edges is a skewed join for AQE to split, not a list in one task: the minima are materialised
    before each join, so both of its sides are plain shuffles. The number of rounds grows with the
    logarithm of the longest path; a graph that isn't settled after ``max_rounds`` raises. Nulls
    and loops are ignored; an empty input gives an empty result. Returns ``(node, component)``; a
    component's smallest node is included.
    """
    scratch = Scratch(edges.sparkSession)
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = scratch.table(e, "edges")
    last = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.table(large.where("u <> v").distinct(), "large")
        low = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        ends = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(low, "u").select(F.explode(ends).alias("x")).select("x.*").where("u <> v").distinct()
        e = scratch.table(small, "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise ValueError(f"components aren't settled after {max_rounds} rounds")
    scratch.drop("low", "large")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
