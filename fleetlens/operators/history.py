"""E1 and J7 in full: what happened to nodes over snapshots, and every change that explains it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE = ["scope", "node"]
CHANGE = "struct<what:string,name:string,before:string,after:string>"


def _differing(what: str, before: Column, after: Column, names: Column) -> Column:
    """A change for each of the names whose values differ; a missing name and a null value are alike null."""
    each = F.transform(F.array_sort(names), lambda k: F.struct(F.lit(what).alias("what"), k.alias("name"), F.element_at(before, k).alias("before"), F.element_at(after, k).alias("after")))
    return F.filter(each, lambda c: ~c["before"].eqNullSafe(c["after"]))


def changes(before: Column, after: Column) -> Column:
    """How a node differs between two states, structs of maps ``components``, ``inputs``, ``parents`` and a ``target``.

    ``code``: a component's digest (a component on one side only has null on the other). ``data``: the version
    of a source that is still read, or is read anew; one that isn't read any more is no change of data.
    ``upstream``: the run that built a parent. ``target``: where the state lives. Ordered so, then by name.
    """
    keys = lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>"))
    code = _differing("code", before["components"], after["components"], F.array_union(keys(before["components"]), keys(after["components"])))
    now = keys(after["inputs"])
    anew = F.transform(F.array_sort(F.array_except(now, keys(before["inputs"]))), lambda k: F.struct(F.lit("data").alias("what"), k.alias("name"), F.lit(None).cast("string").alias("before"), F.element_at(after["inputs"], k).alias("after")))
    data = F.concat(_differing("data", before["inputs"], after["inputs"], F.array_intersect(keys(before["inputs"]), now)), anew)
    upstream = _differing("upstream", before["parents"], after["parents"], F.array_union(keys(before["parents"]), keys(after["parents"])))
    moved = F.struct(F.lit("target").alias("what"), F.lit("").alias("name"), before["target"].alias("before"), after["target"].alias("after"))
    target = F.when(before["target"].eqNullSafe(after["target"]), F.array().cast(f"array<{CHANGE}>")).otherwise(F.array(moved))
    return F.concat(code, data, upstream, target)


def node_events(snapshots: DataFrame, states: DataFrame) -> DataFrame:
    """Per node and snapshot ``built`` (``first``, with the ``changes`` since the build before), ``tested`` or ``dropped``.

    ``snapshots(scope, snapshot, target)``, in the order of ``snapshot``; ``states(scope, snapshot, node, run_id,
    tested, components, inputs, parents)``. A state of the same run as the snapshot's before tells a test, if
    another run tested it since. A node that a snapshot lacks was dropped there, and begins anew after.
    Only a node's own states are compared; snapshots are numbered within their scope.
    """
    snaps = snapshots.select("scope", "snapshot", "target").dropDuplicates(["scope", "snapshot"])
    snaps = snaps.withColumn("n", F.row_number().over(Window.partitionBy("scope").orderBy("snapshot")))
    w = Window.partitionBy(*NODE).orderBy("n")
    s = states.join(snaps, ["scope", "snapshot"]).withColumn("now", F.struct("n", "run_id", "tested", "components", "inputs", "parents", "target"))
    s = s.withColumn("was", F.lag("now").over(w)).withColumn("next", F.lead("n").over(w))
    s = s.withColumn("was", F.when(F.col("was")["n"] == F.col("n") - 1, F.col("was")))
    same = F.coalesce(F.col("was")["run_id"] == F.col("run_id"), F.lit(False))
    tested = same & F.col("tested").isNotNull() & ~F.col("was")["tested"].eqNullSafe(F.col("tested"))
    none = F.array().cast(f"array<{CHANGE}>")
    happened = s.where(~same | tested).select(
        *NODE, "snapshot", F.when(same, "tested").otherwise("built").alias("event"), F.when(same, F.col("tested")).otherwise(F.col("run_id")).alias("run_id"),
        (~same & F.col("was").isNull()).alias("first"), F.when(same | F.col("was").isNull(), none).otherwise(changes(F.col("was"), F.col("now"))).alias("changes"),
    )
    last = snaps.groupBy("scope").agg(F.max("n").alias("last"))
    gone = s.join(last, "scope").where("n < last and (next is null or next > n + 1)").select(*NODE, (F.col("n") + 1).alias("n")).join(snaps.select("scope", "n", "snapshot"), ["scope", "n"])
    gone = gone.select(*NODE, "snapshot", F.lit("dropped").alias("event"), F.lit(None).cast("string").alias("run_id"), F.lit(False).alias("first"), none.alias("changes"))
    return happened.unionByName(gone)


def diff_nodes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Nodes added, removed, rebuilt (another run) or changed between two sets of states, with the ``changes``.

    Both as ``states`` of ``node_events``, with the set's ``target``, one row a node. Nodes that don't differ are left out.
    """
    pack = lambda df, name: df.select(*NODE, F.struct("run_id", "components", "inputs", "parents", "target").alias(name))
    j = pack(before, "b").join(pack(after, "a"), NODE, "full")
    none = F.array().cast(f"array<{CHANGE}>")
    both = F.col("b").isNotNull() & F.col("a").isNotNull()
    j = j.withColumn("changes", F.when(both, changes(F.col("b"), F.col("a"))).otherwise(none))
    verdict = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("b")["run_id"].eqNullSafe(F.col("a")["run_id"]), "rebuilt").when(F.size("changes") > 0, "changed")
    return j.withColumn("verdict", verdict).where("verdict is not null").select(*NODE, "verdict", "changes")
