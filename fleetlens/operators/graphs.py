"""Node graphs: layers, closures, selections and the planner, level by level over all scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.plans.fixpoint import fixpoint, layers
from fleetlens.plans.shared import Scratch, cut
from fleetlens.plans.strong import strong_components

ID = ["scope", "node"]


def closure(seeds: DataFrame, edges: DataFrame, direction: str = "down", limit: int | None = None) -> DataFrame:
    """Every node within ``limit`` hops of ``seeds(scope, node)``, with its distance; seeds at 0."""
    here, there = ("parent", "child") if direction == "down" else ("child", "parent")
    e = cut(edges.select("scope", F.col(here).alias("node"), F.col(there).alias("next")).distinct())

    def step(frontier: DataFrame) -> DataFrame:
        near = frontier if limit is None else frontier.where(F.col("hops") < limit)
        return near.join(e, ID).select("scope", F.col("next").alias("node"), (F.col("hops") + 1).alias("hops"))

    return fixpoint(seeds.select(*ID).distinct().withColumn("hops", F.lit(0)), step, ID)


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """Ids that a scope has more than once."""
    return nodes.groupBy(*ID).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def find_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A shortest cycle through the smallest id of each scope that is on one, as a path.

    Strongly connected components say which nodes are on cycles, so one breadth-first search a scope,
    within the component of its smallest such node, finds the cycle. Returns ``scope, cycle`` (array, the
    smallest id first and last); ties go to the smaller path.
    """
    parts = cut(strong_components(nodes, edges))
    starts = parts.groupBy("scope").agg(F.min("node").alias("root"))
    own = parts.join(starts.select("scope", F.col("root").alias("component")), ["scope", "component"], "left_semi")  # the smallest node names its component
    e = edges.select("scope", "parent", "child").distinct().join(own.select("scope", F.col("node").alias("parent")), ["scope", "parent"], "left_semi")
    e = cut(e.join(own.select("scope", F.col("node").alias("child")), ["scope", "child"], "left_semi"))
    found = cut(starts.select("scope", F.array("root").alias("cycle")).limit(0))
    paths = cut(starts.select("scope", "root", F.col("root").alias("node"), F.array("root").alias("path")))
    seen = paths.select(*ID)
    while not paths.isEmpty():  # ends: every step reaches nodes not seen before, and the root lies on a cycle
        nxt = paths.join(e.withColumnRenamed("parent", "node"), ID).select("scope", "root", F.col("child").alias("node"), F.array_append("path", F.col("child")).alias("path"))
        nxt = cut(nxt.groupBy("scope", "root", "node").agg(F.min("path").alias("path")))
        found = found.unionByName(nxt.where("node = root").select("scope", F.col("path").alias("cycle")))
        paths = cut(nxt.join(found.select("scope"), "scope", "left_anti").join(seen, ID, "left_anti"))
        seen = seen.unionByName(paths.select(*ID))
    return found


def select(nodes: DataFrame, edges: DataFrame, specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph selection by specs ``name``, ``+name``, ``name+``, ``+name+``.

    Returns the selected nodes and the specs that match nothing. No specs select everything.
    """
    s = specs.select("scope", "spec", F.regexp_replace("spec", r"^\+|\+$", "").alias("name"), F.col("spec").startswith("+").alias("up"), F.col("spec").endswith("+").alias("down"))
    hits = cut(s.join(nodes.select("scope", "node", F.col("node").cast("string").alias("name")), ["scope", "name"]))
    missing = specs.join(hits.select("scope", "spec"), ["scope", "spec"], "left_anti")
    if specs.isEmpty():
        return nodes.select(*ID), missing
    up = closure(hits.where("up"), edges, "up").select(*ID)
    down = closure(hits.where("down"), edges, "down").select(*ID)
    return hits.select(*ID).unionByName(up).unionByName(down).distinct(), missing


def select_sources(nodes: DataFrame, edges: DataFrame, sources: DataFrame, specs: DataFrame) -> DataFrame:
    """Sources reached as ancestors of ``+name`` specs; ``name`` alone brings none, no specs all."""
    if specs.isEmpty():
        return sources.select(*ID)
    up = specs.where(F.col("spec").startswith("+"))
    reached, _ = select(nodes, edges, up) if not up.isEmpty() else (nodes.limit(0), None)
    return sources.select(*ID).join(reached, ID, "left_semi")


def sources_read(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """The sources that each node reads, directly or through others: ``scope, node, source``."""
    e = cut(edges.select("scope", F.col("parent").alias("at"), F.col("child").alias("node")).distinct())
    seed = sources.select("scope", F.col("node").alias("source"), F.col("node").alias("at"))
    keys = ["scope", "source", "at"]
    step = lambda f: f.join(e, ["scope", "at"]).select("scope", "source", F.col("node").alias("at"))
    return fixpoint(seed, step, keys).where("at <> source").select("scope", F.col("at").alias("node"), "source")


def neighbourhood(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Nodes within ``depth`` edges of ``seeds``, whichever way the edges point."""
    both = edges.select("scope", "parent", "child").unionByName(edges.select("scope", F.col("child").alias("parent"), F.col("parent").alias("child")))
    return closure(seeds, both, "down", depth)


def lanes(built: DataFrame, edges: DataFrame) -> DataFrame:
    """How many built parents each built node waited on in a row: layers of the built part."""
    return layers(built, edges).withColumnRenamed("depth", "lane")


def trail(seeds: DataFrame, edges: DataFrame, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """T4: the steps of a change in breadth-first order, cut at ``most`` a scope (a report), and whether it was."""
    reach = cut(closure(seeds, edges, "down"))
    steps = reach.select("scope", F.col("node").alias("parent"), "hops").join(edges.distinct(), ["scope", "parent"]).select("scope", "hops", "parent", "child")
    w = Window.partitionBy("scope").orderBy("hops", "parent", "child")
    ranked = steps.withColumn("step", F.row_number().over(w))
    return ranked.where(F.col("step") <= most), steps.groupBy("scope").agg((F.count(F.lit(1)) > most).alias("cut"))


# Reasons by which a parent's build makes its children's code count as changed.
CODE_REASONS = ["never_built", "code_evidence_incomplete", "code_changed", "upstream_code_changed", "unknown_dependency"]


def plan(nodes: DataFrame, edges: DataFrame, now: Column) -> DataFrame:
    """BUILD or REUSE for every node, with a reason; the first matching rule wins.

    ``nodes(scope, node, ...)`` with what can be said of a node alone: ``full_refresh``,
    ``recorded``, ``same_target``, ``fp_error``, ``fp_changed``, ``policy_blocked``,
    ``self_contained``, ``built_at``, ``lag_s``, ``quorum``, ``relation`` (present, missing,
    unverified, unchecked), ``checks_required``; ``source_inputs`` and ``source_new``,
    ``source_bad`` count its source inputs, those with new data and those without usable
    evidence. ``edges(scope, parent, child, recorded)``: whether the parent's run that the child
    read is on record. Rules that need parents are applied a level at a time. A level's decisions go along
    the edges to the children once and are kept as counts by child, in folders by the child's level; nodes and
    edges are in folders by level too, so a level reads what is its own.
    """
    scratch = Scratch(nodes.sparkSession)
    depth = cut(layers(nodes, edges))
    spread = lambda d, by, *keys: d.repartition(by, F.pmod(F.xxhash64(*keys), F.lit(16)))  # noqa: E731  # few files a level
    e = edges.select("scope", "parent", "child", "recorded").dropDuplicates(["scope", "parent", "child"])
    e = e.join(nodes.select("scope", F.col("node").alias("parent"), F.lit(True).alias("known")), ["scope", "parent"], "left")
    e = e.join(depth.select("scope", F.col("node").alias("child"), F.col("depth").alias("child_depth")), ["scope", "child"])
    e = cut(e.join(depth.select("scope", F.col("node").alias("parent"), "depth"), ["scope", "parent"], "left"))
    alone = e.groupBy("scope", F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("parents"), F.coalesce(F.bool_or(F.col("known").isNull()), F.lit(False)).alias("unknown_parent"))
    n = scratch.table(spread(nodes.join(depth, ID).join(alone, ID, "left"), "depth", *ID), "nodes", "depth")
    e = scratch.table(spread(e.where("depth is not null").select("scope", "parent", "child", "recorded", "child_depth", "depth"), "depth", "scope", "parent"), "edges", "depth")
    deepest = depth.agg(F.max("depth")).first()[0]
    decided, sent = None, []
    for level in range((deepest if deepest is not None else -1) + 1):
        here = n.where(F.col("depth") == level)
        counts = ["code_parents", "refreshed_parents", "new_parents", "bad_parents"]
        if sent:
            met = sent[0].where(F.col("child_depth") == level)
            for s in sent[1:]:
                met = met.unionByName(s.where(F.col("child_depth") == level))
            here = here.join(met.groupBy(*ID).agg(*[F.sum(c).alias(c) for c in counts]), ID, "left")
        else:
            here = here.withColumns({c: F.lit(None).cast("long") for c in counts})
        j = here.fillna(0, ["parents", *counts]).fillna(False, ["unknown_parent"])
        j = j.withColumns({c.removesuffix("s"): F.col(c) > 0 for c in counts if c != "new_parents"})
        inputs = F.col("parents") + F.col("source_inputs")
        new = F.col("new_parents") + F.col("source_new")
        reason = (
            F.when(F.col("full_refresh"), "full_refresh_requested")
            .when(~F.col("recorded"), "never_built").when(~F.col("same_target"), "target_changed")
            .when(F.col("fp_error"), "code_evidence_incomplete").when(F.col("fp_changed"), "code_changed")
            .when(F.col("code_parent"), "upstream_code_changed").when(F.col("refreshed_parent"), "upstream_full_refresh")
            .when(F.col("unknown_parent"), "unknown_dependency").when(F.col("policy_blocked"), "policy_blocks_reuse")
            .when((inputs == 0) & ~F.col("self_contained"), "missing_data_evidence")
            .when((F.col("source_bad") > 0) | F.col("bad_parent"), "missing_data_evidence")
            .when((new > 0) & (F.col("quorum") == "all") & (new < inputs), "quorum_not_met")
            .when((new > 0) & (F.col("lag_s") > 0) & (F.unix_timestamp(now) < F.unix_timestamp("built_at") + F.col("lag_s")), "within_lag_tolerance")
            .when(new > 0, "new_upstream_data").otherwise("unchanged")
        )
        reuse = F.col("reason").isin("quorum_not_met", "within_lag_tolerance", "unchanged")
        after = (
            F.when(reuse & (F.col("relation") == "missing"), "relation_missing")
            .when(reuse & ((F.col("relation") == "unverified") | ((F.col("relation") == "unchecked") & F.col("checks_required"))), "relation_unverified").otherwise(F.col("reason"))
        )
        out = j.withColumn("reason", reason).withColumn("reason", after)  # the action follows the final reason
        out = cut(out.select(*ID, F.when(reuse, "REUSE").otherwise("BUILD").alias("action"), "reason", "depth"))
        decided = out if decided is None else decided.unionByName(out)
        builds = F.col("action") == "BUILD"
        told = e.where(F.col("depth") == level).drop("depth").join(out.select("scope", F.col("node").alias("parent"), "action", "reason"), ["scope", "parent"])
        told = told.groupBy("scope", F.col("child").alias("node"), "child_depth").agg(
            F.count_if(builds & F.col("reason").isin(*CODE_REASONS)).alias("code_parents"), F.count_if(F.col("reason") == "full_refresh_requested").alias("refreshed_parents"),
            F.count_if(builds).alias("new_parents"), F.count_if((F.col("action") == "REUSE") & ~F.col("recorded")).alias("bad_parents"),
        )
        if level < deepest:
            sent.append(scratch.table(told, f"told-{level}", "child_depth"))
    if decided is None:
        return nodes.select(*ID, F.lit("").alias("action"), F.lit("").alias("reason"), F.lit(0).alias("depth")).limit(0)
    return decided


def reuse_candidates(nodes: DataFrame, edges: DataFrame, now: Column) -> DataFrame:
    """What would be reused if relations weren't looked at and nothing were refreshed in full."""
    free = nodes.withColumn("relation", F.lit("present")).withColumn("full_refresh", F.lit(False))
    return plan(free, edges, now).where("action = 'REUSE'").select(*ID)


def plan_counts(planned: DataFrame) -> DataFrame:
    """Entries by action and reason."""
    return planned.groupBy("scope", "action", "reason").agg(F.count(F.lit(1)).alias("n"))


# The reasons of a build that a parent's build can cause.
CAUSED = ["upstream_code_changed", "upstream_full_refresh", "new_upstream_data"]


def explain(planned: DataFrame, edges: DataFrame) -> DataFrame:
    """For every BUILD, the root causes that it traces back to through parents that can cause it.

    Root causes go from cause to caused, so that a row is a node with one of its roots, never a node with all
    that lies between.
    """
    b = cut(planned.where("action = 'BUILD'").select(*ID, "reason"))
    cause = edges.select("scope", F.col("parent").alias("cause"), F.col("child").alias("node")).distinct()
    cause = cause.join(b.select(*ID, "reason"), ID).where(F.col("reason").isin(*CAUSED))
    causes_code = F.col("why").isin(*CODE_REASONS)
    cause = cause.join(b.select("scope", F.col("node").alias("cause"), F.col("reason").alias("why")), ["scope", "cause"])
    fits = (F.col("reason") == "upstream_code_changed") & causes_code | (F.col("reason") == "upstream_full_refresh") & (F.col("why") == "full_refresh_requested") | (F.col("reason") == "new_upstream_data")
    cause = cut(cause.where(fits).select("scope", "node", "cause"))
    roots = b.join(cause.select(*ID).distinct(), ID, "left_anti").select(*ID, F.col("node").alias("root"), F.col("reason").alias("root_reason"))
    down = lambda f: f.withColumnRenamed("node", "cause").join(cause, ["scope", "cause"]).select(*ID, "root", "root_reason")
    return fixpoint(roots, down, [*ID, "root"])


def split_retry(planned: DataFrame, edges: DataFrame, retry: DataFrame, buildable: DataFrame) -> DataFrame:
    """What a retry runs.

    ``retried``: asked, planned to build, and no parent is held back or must build unasked;
    ``held_back``: asked, but a parent must build and isn't retried (cascades down); ``reused``:
    asked, planned to reuse; ``changed_since``: builds and is buildable, but wasn't asked;
    ``not_planned``: asked, but not in the plan.
    """
    p = planned.select(*ID, "action")
    asked = retry.select(*ID).distinct().withColumn("asked", F.lit(True))
    j = cut(p.join(asked, ID, "left"))
    builds = j.where("action = 'BUILD'")
    blockers = builds.where("asked is null").select(*ID)
    wanted = cut(builds.where("asked").select(*ID))
    # only edges into what is asked and builds hold anything back; they are the same in every round
    below = edges.select("scope", F.col("parent").alias("node"), "child").join(wanted.withColumnRenamed("node", "child"), ["scope", "child"], "left_semi")
    below = cut(below.select(*ID, "child").distinct())
    step = lambda f: f.join(below, ID).select("scope", F.col("child").alias("node"))
    held = fixpoint(step(blockers), step, ID).select(*ID)
    lab = lambda d, s: d.select(*ID, F.lit(s).alias("verdict"))
    return (
        lab(wanted.join(held, ID, "left_anti"), "retried").unionByName(lab(held, "held_back")).unionByName(lab(j.where("asked and action = 'REUSE'"), "reused"))
        .unionByName(lab(blockers.join(buildable.select(*ID), ID, "left_semi"), "changed_since")).unionByName(lab(asked.join(p, ID, "left_anti"), "not_planned"))
    )


def unbuilt_parents(planned: DataFrame, edges: DataFrame, requested: DataFrame) -> DataFrame:
    """Parents that need building but are left out, with how many requested nodes will read them stale."""
    left_out = planned.where("action = 'BUILD'").select(*ID).join(requested.select(*ID), ID, "left_anti").withColumnRenamed("node", "parent")
    reads = edges.select("scope", "parent", F.col("child").alias("node")).distinct().join(requested.select(*ID).distinct(), ID, "left_semi")
    return left_out.join(reads, ["scope", "parent"]).groupBy("scope", "parent").agg(F.count(F.lit(1)).alias("readers"))


def blocked_by_failure(outcomes: DataFrame, edges: DataFrame) -> DataFrame:
    """Skipped nodes downstream of a failed one, and whether they keep a last good build."""
    failed = outcomes.where("status = 'failed'").select(*ID)
    down = closure(failed, edges, "down").where("hops > 0").select(*ID)
    return outcomes.where("status = 'skipped'").join(down, ID, "left_semi").select(*ID, "has_build")
