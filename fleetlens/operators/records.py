"""What a run leaves in the state, and whether the stored snapshots can be trusted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AT = ["scope", "node"]


def record_run(results: DataFrame, nodes: DataFrame, parents: DataFrame, versions: DataFrame, previous: DataFrame, reads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """G17 in full: the next state, what each build read, and what became of each result.

    ``results(scope, node, run_id, at, outcome, tested, build_ms)``, one a node; ``nodes(scope, node, fp, checks)`` of the project, ``fp``
    null where the code can't be fingerprinted, ``checks`` null where it has none; ``parents(scope, node, parent)``, models and sources;
    ``versions(scope, source, version, predates)``: what a source held, and whether that was seen before the run started;
    ``previous(scope, node, run_id, built_at, fp, build_ms, tested)`` and ``reads(scope, node, kind, name, value)`` of the state before.

    * A success with a fingerprint advances: this run's id, time, fingerprint and build time (never the one before's), tested
      only with checks; its parents with the run that built what it read (this one or the one before), its sources with their
      version, null where that wasn't seen before the run.
    * A success without a fingerprint, and a failure, keep the last state but lose ``tested``; what was skipped keeps it whole.
    * A node that isn't in the project is ignored. A node without a state that doesn't advance gets none.

    Returns ``scope, node, run_id, built_at, fp, build_ms, tested``, then ``scope, node, kind, name, value``, then ``scope, node, became``.
    """
    r = results.select(*AT, F.col("run_id").alias("r_run"), "at", "outcome", F.col("tested").alias("r_tested"), F.col("build_ms").alias("r_ms"))
    known = nodes.select(*AT, F.col("fp").alias("n_fp"), "checks", F.lit(True).alias("here"))
    judged = r.join(known, AT, "left")
    became = (
        F.when(F.col("here").isNull(), "ignored").when((F.col("outcome") == "success") & F.col("n_fp").isNotNull(), "advanced")
        .when(F.col("outcome") == "success", "kept_no_fingerprint").when(F.col("outcome") == "failed", "kept_failed").otherwise("kept_skipped")
    )
    judged = judged.withColumn("became", became)
    j = previous.join(judged.where("became <> 'ignored'"), AT, "full")
    won = F.coalesce(F.col("became") == "advanced", F.lit(False))
    doubt = F.coalesce(F.col("became").isin("kept_no_fingerprint", "kept_failed"), F.lit(False))
    vouched = F.when(F.col("r_tested") & F.col("checks").isNotNull(), F.col("r_run"))
    pick = lambda new, old: F.when(won, F.col(new)).otherwise(F.col(old)).alias(old)
    state = j.where(won | F.col("run_id").isNotNull()).select(
        *AT, pick("r_run", "run_id"), pick("at", "built_at"), pick("n_fp", "fp"), pick("r_ms", "build_ms"), F.when(won, vouched).when(~doubt, F.col("tested")).alias("tested"),
    )
    advanced = judged.where("became = 'advanced'").select(*AT)
    edges = parents.select(*AT, F.col("parent").alias("name")).distinct().join(advanced, AT, "left_semi")
    built = state.join(nodes.select(*AT), AT, "left_semi").select("scope", F.col("node").alias("name"), F.col("run_id").alias("value"))
    of_models = edges.join(built, ["scope", "name"]).select(*AT, F.lit("parent").alias("kind"), "name", "value")
    seen = versions.select("scope", F.col("source").alias("name"), F.when(F.col("predates"), F.col("version")).alias("value"))
    of_sources = edges.join(seen, ["scope", "name"]).select(*AT, F.lit("input").alias("kind"), "name", "value")
    kept = reads.join(advanced, AT, "left_anti").select(*AT, "kind", "name", "value")
    return state, of_models.unionByName(of_sources).unionByName(kept), judged.select(*AT, "became")


def check_records(snapshots: DataFrame, heads: DataFrame) -> DataFrame:
    """J24 in full: what is wrong with stored snapshots, as ``scope, id, problem, field``.

    ``snapshots(scope, snapshot_id, parent, run_id, nodes, document)``, where ``document`` is the snapshot as JSON with the fields
    ``parent``, ``run_id`` and ``nodes`` (how many) that the columns repeat; ``heads(scope, head)``. Ids are unique over all scopes.

    ``unreadable``: no JSON, or without a run. ``inconsistent``: a column doesn't match the document, with the first such field.
    ``broken_chain``: the parent isn't a snapshot of the scope. ``head_missing``: nor is the head. ``no_head``: a scope, once,
    with its latest snapshot. A snapshot can have several problems.
    """
    doc = F.from_json("document", "parent long, run_id string, nodes long, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    s = snapshots.withColumn("d", doc)
    bad = F.col("d._bad").isNotNull() | F.col("d.run_id").isNull()
    field = F.when(~F.col("d.parent").eqNullSafe(F.col("parent")), "parent").when(~F.col("d.run_id").eqNullSafe(F.col("run_id")), "run_id").when(~F.col("d.nodes").eqNullSafe(F.col("nodes")), "nodes")
    none = F.lit(None).cast("string")
    row = lambda df, i, problem, f=none: df.select("scope", F.col(i).alias("id"), F.lit(problem).alias("problem"), f.alias("field"))
    read = s.withColumn("unreadable", bad).withColumn("differs", F.when(~bad, field))
    ids = snapshots.select("scope", F.col("snapshot_id").alias("found")).distinct()
    orphans = snapshots.where("parent is not null").join(ids.withColumnRenamed("found", "parent"), ["scope", "parent"], "left_anti")
    nowhere = heads.join(ids.withColumnRenamed("found", "head"), ["scope", "head"], "left_anti")
    headless = snapshots.groupBy("scope").agg(F.max("snapshot_id").alias("latest")).join(heads.select("scope"), "scope", "left_anti")
    parts = [row(read.where("unreadable"), "snapshot_id", "unreadable"), row(read.where("differs is not null"), "snapshot_id", "inconsistent", F.col("differs"))]
    out = row(orphans, "snapshot_id", "broken_chain").unionByName(row(nowhere, "head", "head_missing")).unionByName(row(headless, "latest", "no_head"))
    return parts[0].unionByName(parts[1]).unionByName(out)


def past_plan(run_nodes: DataFrame, before: DataFrame, after: DataFrame, parents: DataFrame) -> DataFrame:
    """G24 in full: a past run's plan, from the states around it.

    ``run_nodes(scope, run_id, node)``; ``before(scope, run_id, node, digest, components MAP)`` from the state before
    each run, ``after(..., recorded_by)`` from the one that it left, where ``recorded_by`` is the run that built the
    node; ``parents(scope, node, parent)`` as the project has them now. A node that both states have, that this very
    run recorded, and whose digest differs, was built as its code changed: ``changed`` lists the components that
    differ, came or went, ``was`` and ``now`` the digests. Of the others nothing tells the reason. Returns
    ``scope, run_id, node, depends_on, action, reason, changed, was, now``, a row a node and run.
    """
    keys = ["scope", "run_id", "node"]
    b = before.select(*keys, F.col("digest").alias("was"), F.col("components").alias("had"))
    a = after.where(F.col("recorded_by") == F.col("run_id")).select(*keys, F.col("digest").alias("now"), F.col("components").alias("has"))
    up = parents.groupBy(*AT).agg(F.array_sort(F.collect_set("parent")).alias("depends_on"))
    other = F.array_sort(F.concat(
        F.filter(F.map_keys("has"), lambda k: ~F.try_element_at("has", k).eqNullSafe(F.try_element_at("had", k))), F.filter(F.map_keys("had"), lambda k: ~F.map_contains_key("has", k)),
    ))
    differs = F.coalesce(F.col("was") != F.col("now"), F.lit(False))
    j = run_nodes.select(*keys).distinct().join(b, keys, "left").join(a, keys, "left").join(up, AT, "left")
    return j.select(
        *keys, F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"), F.lit("BUILD").alias("action"),
        *[F.when(differs, c).alias(name) for name, c in (("reason", F.lit("code_changed")), ("changed", other), ("was", F.col("was")), ("now", F.col("now")))],
    )
