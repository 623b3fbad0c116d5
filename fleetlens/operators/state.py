"""Fingerprints, snapshots, versions and what is recorded after a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.plans.asof import last_before



def scoped(df: DataFrame, *keys: str) -> list[str]:
    """The keys of a join, with the scope where the frame has one: two scopes may share a name."""
    return [*(["scope"] if "scope" in df.columns else []), *keys]


def fingerprint(components: DataFrame) -> DataFrame:
    """SHA-256 over ``name NUL digest LF`` of the sorted components, each the SHA-256 of its content."""
    lines = F.array_sort(F.collect_list(F.concat("component", F.lit("\0"), F.sha2("content", 256), F.lit("\n"))))
    return components.groupBy(*scoped(components, "node")).agg(F.sha2(F.array_join(lines, ""), 256).alias("digest"))


def fingerprint_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Components changed, added or removed of each node; one full outer join by ([scope,] node, component)."""
    keys = scoped(before, "node", "component")
    b, a = before.select(*keys, F.col("content").alias("was")), after.select(*keys, F.col("content").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return b.join(a, keys, "full").where(~F.col("was").eqNullSafe(F.col("now"))).select(*keys, change.alias("change"))


def cosmetic_changes(before: DataFrame, after: DataFrame, meaning: Column) -> DataFrame:
    """Components whose raw content differs though their ``meaning`` (of column ``content``) doesn't."""
    keys = scoped(before, "node", "component")
    b, a = before.select(*keys, F.col("content").alias("was"), meaning.alias("m1")), after.select(*keys, F.col("content").alias("now"), meaning.alias("m2"))
    return b.join(a, keys).where("was <> now and m1 = m2").select(*keys)


def diff_states(before: DataFrame, after: DataFrame) -> DataFrame:
    """Nodes added, removed or rebuilt (another run) between two snapshots ``(scope, node, run_id)``."""
    j = before.select("scope", "node", F.col("run_id").alias("was")).join(after.select("scope", "node", F.col("run_id").alias("now")), ["scope", "node"], "full")
    verdict = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "rebuilt")
    return j.select("scope", "node", verdict.alias("verdict")).where("verdict is not null")


def diff_project(before: DataFrame, after: DataFrame, versions: DataFrame, reads: DataFrame) -> DataFrame:
    """Nodes whose code changed, and sources still read whose version moved."""
    within = scoped(before)
    code = fingerprint_diff(before, after).select(*within, F.col("node").alias("id")).distinct().withColumn("what", F.lit("code"))
    moved = versions.where(~F.col("recorded_version").eqNullSafe(F.col("now_version"))).join(reads.select(*within, "source").distinct(), [*within, "source"], "left_semi")
    return code.unionByName(moved.select(*within, F.col("source").alias("id")).withColumn("what", F.lit("source")))


def node_history(ledger: DataFrame) -> DataFrame:
    """What each snapshot did to a node: ``first``, ``built`` or ``dropped``; ``ledger(scope, snapshot, node)``.

    Snapshots are numbered within their scope; a node is dropped by the snapshot after its last
    uninterrupted one. Only a node's own rows are compared, so there is no snapshot x node grid.
    """
    snaps = ledger.select("scope", "snapshot").distinct().withColumn("n", F.row_number().over(Window.partitionBy("scope").orderBy("snapshot")))
    own = ledger.select("scope", "snapshot", "node").distinct().join(snaps, ["scope", "snapshot"])
    w = Window.partitionBy("scope", "node").orderBy("n")
    own = own.withColumn("before", F.lag("n").over(w)).withColumn("after", F.lead("n").over(w))
    seen = own.select("scope", "node", "n", F.when(F.col("before").isNull(), "first").otherwise("built").alias("event"))
    last = snaps.groupBy("scope").agg(F.max("n").alias("last"))
    gone = own.join(F.broadcast(last), "scope").where("n < last and (after is null or after > n + 1)").select("scope", "node", (F.col("n") + 1).alias("n"), F.lit("dropped").alias("event"))
    return seen.unionByName(gone).join(snaps, ["scope", "n"]).select("scope", "node", "snapshot", "event")


def choose_source_versions(readings: DataFrame) -> DataFrame:
    """Of a source's readings ``(source, rank, version)`` the one of the lowest rank, and what was skipped.

    Strategies: a relation's version (0), its freshness (1); none gives ``none``.
    """
    have = F.col("version").isNotNull()
    key = scoped(readings, "source")
    g = readings.groupBy(*key).agg(
        F.min_by("version", F.when(have, F.col("rank"))).alias("version"), F.min(F.when(have, F.col("rank"))).alias("rank"),
        F.array_sort(F.collect_set(F.when(~have, F.col("strategy")))).alias("without"), F.min_by("strategy", F.when(have, F.col("rank"))).alias("strategy"),
    )
    return g.select(*key, "version", F.coalesce("strategy", F.lit("none")).alias("strategy"), F.array_join("without", ",").alias("without"))


def merge_readings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two readings ``(source, version, taken_at)``: the later one; of one time the same answer, or unknown."""
    key = scoped(a, "source")
    j = a.select(*key, F.col("version").alias("va"), F.col("taken_at").alias("ta")).join(b.select(*key, F.col("version").alias("vb"), F.col("taken_at").alias("tb")), key, "full")
    version = (
        F.when(F.col("tb").isNull() | (F.col("ta") > F.col("tb")), F.col("va")).when(F.col("ta").isNull() | (F.col("tb") > F.col("ta")), F.col("vb"))
        .when(F.col("va").eqNullSafe(F.col("vb")), F.col("va"))
    )
    return j.select(*key, version.alias("version"), F.greatest("ta", "tb").alias("taken_at"))


def source_checks(sources: DataFrame) -> DataFrame:
    """TEST or SKIP per source: ``([scope,] source, tested, checks_changed, recorded_version, now_version)``."""
    reason = (
        F.when(~F.col("tested"), "not_tested").when(F.col("checks_changed"), "checks_changed").when(F.col("now_version").isNull() | F.col("recorded_version").isNull(), "version_unknown")
        .when(F.col("now_version") < F.col("recorded_version"), "version_stale").when(F.col("now_version") > F.col("recorded_version"), "version_moved").otherwise("unchanged")
    )
    return sources.select(*scoped(sources, "source"), F.when(reason == "unchanged", "SKIP").otherwise("TEST").alias("action"), reason.alias("reason"))


def record(results: DataFrame, previous: DataFrame) -> DataFrame:
    """The next snapshot: successes advance, failures keep the last good state but lose ``tested``.

    ``results(scope, node, run_id, at, action, fp)``; ``previous(scope, node, run_id, built_at, fp,
    tested)``. Nodes that the run didn't touch keep their state; one that failed and never was
    built isn't recorded.
    """
    r = results.select("scope", "node", F.col("run_id").alias("r_run"), "at", "action", F.col("fp").alias("r_fp"))
    j = previous.join(r, ["scope", "node"], "full")
    won, lost = F.col("action") == "built", F.col("action") == "failed"
    return j.where(F.coalesce(won, F.lit(False)) | F.col("run_id").isNotNull()).select(
        "scope", "node", F.when(won, F.col("r_run")).otherwise(F.col("run_id")).alias("run_id"), F.when(won, F.col("at")).otherwise(F.col("built_at")).alias("built_at"),
        F.when(won, F.col("r_fp")).otherwise(F.col("fp")).alias("fp"), F.when(~F.coalesce(won | lost, F.lit(False)), F.col("tested")).alias("tested"),
    )


def record_tests(state: DataFrame, tests: DataFrame, key: str = "node") -> DataFrame:
    """G18 (nodes), G19 (``key="source"``): a test-only run sets ``tested`` where all passed and clears it where one failed."""
    t = tests.groupBy("scope", key).agg(F.bool_and(F.col("status") == "passed").alias("fine"), F.max("run_id").alias("by"))
    return state.join(t, ["scope", key], "left").select("scope", key, F.when(F.col("fine").isNull(), F.col("tested")).when(F.col("fine"), F.col("by")).alias("tested"))


def states_around(runs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """As-of: the last snapshot before each run began, and the snapshot that it committed.

    ``runs(scope, run_id, started_at)``, ``snapshots(scope, snapshot_id, created_at, by_run)``. A two-level
    as-of (``plans.asof``), so the largest task is bounded however many runs a scope has; no range join.
    """
    times = last_before(runs.select("scope", F.col("started_at").alias("t")), snapshots.select("scope", F.col("created_at").alias("t"), "snapshot_id"), ["scope"], "t", "snapshot_id")
    before = runs.select("scope", "run_id", F.col("started_at").alias("t")).join(times.withColumnRenamed("snapshot_id", "before"), ["scope", "t"], "left").drop("t")
    made = snapshots.select("scope", F.col("by_run").alias("run_id"), F.col("snapshot_id").alias("committed"))
    return before.join(made, ["scope", "run_id"], "left")


def append_snapshots(candidates: DataFrame, heads: DataFrame) -> DataFrame:
    """A candidate is accepted only if its parent is its scope's head; others are conflicts. Idempotent by run."""
    j = candidates.join(heads.select("scope", "head", F.col("run_id").alias("head_run")), "scope", "left")
    verdict = F.when(F.col("run_id").eqNullSafe(F.col("head_run")), "already_there").when(F.col("parent").eqNullSafe(F.col("head")), "accepted").otherwise("conflict")
    return j.select("scope", "snapshot_id", "parent", verdict.alias("verdict"))


def check_snapshots(snapshots: DataFrame, heads: DataFrame) -> DataFrame:
    """Parents outside the scope, heads that point nowhere, scopes without a head."""
    ids = snapshots.select("scope", F.col("snapshot_id").alias("id"))
    orphan = snapshots.where("parent is not null").join(ids.withColumnRenamed("id", "parent"), ["scope", "parent"], "left_anti").select("scope", F.col("snapshot_id").alias("id"), F.lit("parent_missing").alias("problem"))
    nowhere = heads.join(ids.withColumnRenamed("id", "head"), ["scope", "head"], "left_anti").select("scope", F.col("head").alias("id"), F.lit("head_missing").alias("problem"))
    headless = snapshots.join(heads, "scope", "left_anti").select("scope", F.col("snapshot_id").alias("id"), F.lit("no_head").alias("problem"))
    return orphan.unionByName(nowhere).unionByName(headless)


def in_target(state: DataFrame, target: Column) -> DataFrame:
    """State built in another or an unknown target counts as empty."""
    same = F.coalesce(F.col("target") == target, F.lit(False))
    return state.select("scope", "node", F.when(same, F.col("run_id")).alias("run_id"))


def recorded_versions(inputs: DataFrame) -> DataFrame:
    """Per source and version seen by readers: how many, the newest build and its run."""
    return inputs.groupBy(*scoped(inputs, "source", "version")).agg(F.count(F.lit(1)).alias("readers"), F.max("built_at").alias("newest"), F.max_by("run_id", F.struct("built_at", "run_id")).alias("run_id"))


def choose_pointers(nodes: DataFrame) -> DataFrame:
    """Where a deferred node points, by the first matching rule.

    ``nodes(node, selected, in_upstream, built_here, same_code, relation_here, data_moved)``.
    """
    rules = [
        (F.col("selected"), "this_target", "selected"), (~F.col("in_upstream"), "this_target", "not_upstream"), (~F.col("built_here"), "upstream", "never_built_here"),
        (~F.col("same_code"), "upstream", "code_differs"), (F.col("data_moved").isNull(), "upstream", "data_unknown"), (F.col("data_moved"), "upstream", "data_moved"),
        (F.col("relation_here") == "missing", "upstream", "relation_missing"), (F.col("relation_here") == "unverified", "upstream", "relation_unverified"), (F.lit(True), "this_target", "unchanged"),
    ]
    pointer = reason = None
    for condition, where, why in rules:
        pointer = F.when(condition, where) if pointer is None else pointer.when(condition, where)
        reason = F.when(condition, why) if reason is None else reason.when(condition, why)
    return nodes.select(*scoped(nodes, "node"), pointer.alias("pointer"), reason.alias("reason"))


def defer_candidates(nodes: DataFrame) -> DataFrame:
    """The nodes that the first six rules leave open, so only these are looked up."""
    return choose_pointers(nodes.withColumn("relation_here", F.lit("present"))).where("reason = 'unchanged'").drop("pointer", "reason")


def deferred_relations(upstream: DataFrame, here: DataFrame, pointers: DataFrame) -> DataFrame:
    """The upstream relations, replaced for nodes that point to this target."""
    key = scoped(upstream, "node")
    j = upstream.join(pointers.select(*key, "pointer"), key, "left").join(here.select(*key, F.col("relation").alias("own")), key, "left")
    return j.select(*key, F.when((F.col("pointer") == "this_target") & F.col("own").isNotNull(), F.col("own")).otherwise(F.col("relation")).alias("relation"))


def relation_check(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Reuse candidates whose relation is missing, or listed without being verified, must build."""
    key = scoped(expected, "key")
    there = present.select(*key[:-1], F.lower("relation").alias("key"), "verified", F.lit(True).alias("there"))
    j = expected.withColumn("key", F.lower("relation")).join(there, key, "left")
    return j.select(*key[:-1], "node", F.when(F.col("there").isNull(), "missing").when(~F.col("verified"), "unverified").otherwise("present").alias("fact"))


def choose_strategy(offered: DataFrame, strategies: DataFrame) -> DataFrame:
    """Per scope the most preferred strategy whose required capabilities are all offered.

    ``offered(scope, capability)``, ``strategies(strategy, rank, requires ARRAY)``; a strategy
    without requirements is the fallback. Strategies are a short list of the caller's.
    """
    have = offered.groupBy("scope").agg(F.collect_set("capability").alias("have"))
    j = have.join(F.broadcast(strategies), F.size(F.array_except("requires", "have")) == 0)
    return j.groupBy("scope").agg(F.min_by("strategy", "rank").alias("strategy"))


def run_list(snapshots: DataFrame, ledger: DataFrame, journals: DataFrame) -> DataFrame:
    """One row a run from three sources; the ledger's outcome wins over the journal's, a snapshot alone is a success."""
    s = snapshots.select("scope", "run_id", F.lit("success").alias("so")).distinct()
    j = s.join(ledger.select("scope", "run_id", F.col("outcome").alias("lo")).distinct(), ["scope", "run_id"], "full").join(journals.select("scope", "run_id", F.col("outcome").alias("jo")).distinct(), ["scope", "run_id"], "full")
    seen = F.concat_ws("+", F.when(F.col("so").isNotNull(), "snapshot"), F.when(F.col("lo").isNotNull(), "ledger"), F.when(F.col("jo").isNotNull(), "journal"))
    return j.select("scope", "run_id", F.coalesce("lo", "jo", "so").alias("outcome"), seen.alias("seen_in"))
