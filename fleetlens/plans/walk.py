"""Walks along a map from each node to one other, by doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.plans.shared import Scratch


def walk(starts: DataFrame, successor: DataFrame, by: list[str], node: str, to: str, max_rounds: int = 64) -> DataFrame:
    """Every node on the walk from ``starts(*by, node)`` along ``successor(*by, node, to)``, with its ``step``.

    One start and one successor a key. Round ``k`` knows the walks' first ``2^k`` nodes and the jumps of
    ``2^k`` steps; joining both with the jumps doubles them, so a walk of ``n`` steps takes about
    ``log2(n)`` rounds. A walk that comes back to a node ends before it.
    """
    scratch = Scratch(starts.sparkSession)
    jump = scratch.table(successor.select(*by, node, to), "jump")
    path = scratch.table(starts.select(*by, node, F.lit(0).cast("long").alias("step")), "path")
    known, reach = path.count(), 1
    for _ in range(max_rounds):
        further = path.join(jump, [*by, node]).select(*by, F.col(to).alias(node), (F.col("step") + reach).alias("step"))
        path = scratch.table(path.unionByName(further).groupBy(*by, node).agg(F.min("step").alias("step")), "path")
        now = path.count()
        if now == known:
            scratch.drop("jump")
            return path
        known, reach = now, 2 * reach
        onward = jump.select(*by, F.col(node).alias(to), F.col(to).alias("end"))
        jump = scratch.table(jump.join(onward, [*by, to]).select(*by, node, F.col("end").alias(to)), "jump")
    raise ValueError(f"a walk hasn't ended after {max_rounds} rounds")
