"""G11 in full: what proposed changes of columns do to every node, which tests must run, and who is left alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.lineage import breaks, column_origins, reader_marks, taken_elsewhere
from fleetlens.plans.fixpoint import fixpoint
from fleetlens.plans.scopes import by_scope
from fleetlens.plans.shared import cut

scoped = by_scope("relation", "node", "upstream")
CHANGE = ["relation", "column", "kind"]


def engine_changes(proposed: DataFrame, nodes: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The changes that lineage follows, and the columns that go away.

    ``proposed(node, column, change, to)``: ``drop``, ``rename`` (to a name that the caller has checked is
    free) or ``retype``. Proposals for nodes that aren't in ``nodes(node)`` are left out. A rename removes one
    name and adds another. A node of unknown columns changes in all its rows, and what it drops or renames is
    still removed, so that its readers become unknown.
    """
    known = outputs.select("node").distinct().withColumn("listed", F.lit(True))
    p = cut(proposed.where("column is not null").join(nodes.select("node").distinct(), "node", "left_semi").join(known, "node", "left"))
    listed, goes = F.col("listed").isNotNull(), F.col("change").isin("drop", "rename")
    one = lambda when, column, kind: F.when(when, F.struct(F.col(column).alias("column") if column else F.lit("").alias("column"), F.lit(kind).alias("kind")))
    found = F.array(
        one(listed & goes, "column", "removed"), one(listed & (F.col("change") == "retype"), "column", "modified"),
        one(listed & (F.col("change") == "rename") & F.col("to").isNotNull(), "to", "added"), one(~listed, None, "rows"),
    )
    changes = p.select(F.col("node").alias("relation"), F.explode(F.array_compact(found)).alias("c")).select("relation", "c.column", "c.kind")
    gone = p.where(goes)
    return changes.distinct(), gone.select(F.col("node").alias("relation"), "column").distinct()


def _effects(changes: DataFrame, hits: DataFrame, readers: DataFrame, origins: DataFrame) -> DataFrame:
    """What changes do to their readers, one step on: ``relation, column, kind, reason, upstream``; ``hits`` are the uses by readers that aren't blind."""

    def at(d: DataFrame, kind, reason: str, column: Column | None = None) -> DataFrame:
        what = F.struct(F.lit("").alias("column") if column is None else column.alias("column"), kind.alias("kind"), F.lit(reason).alias("reason"))
        return d.select(F.col("node").alias("relation"), F.col("relation").alias("upstream"), what.alias("what"))

    rows = F.lit("rows")
    read = changes.join(readers, "relation")
    clear = read.where("not blind")
    added = clear.where("kind = 'added'")
    star = added.where("star")
    hit = changes.where("kind in ('removed', 'modified')").join(hits, ["relation", "column"])
    found = [
        at(read.where("blind"), rows, "opaque"), at(clear.where("kind = 'rows'"), rows, "rows"),
        at(star, F.lit("added"), "wildcard", F.col("column")), at(star.where("shaped"), rows, "wildcard"),
        at(taken_elsewhere(added, changes, origins), rows, "name_capture"),
        at(hit, F.when(F.col("to_column").isNull(), "rows").otherwise("modified"), "column", F.coalesce("to_column", F.lit(""))),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("relation", "what.*", "upstream").distinct()


@scoped
def simulate_changes(
    proposed: DataFrame, nodes: DataFrame, outputs: DataFrame, uses: DataFrame, reads: DataFrame, declared: DataFrame, wildcards: DataFrame, opaque: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """The nodes that must run, with a verdict each, and the readers that needn't.

    ``proposed`` as in ``engine_changes``; ``nodes(node)``; ``outputs(node, column)``; ``uses(relation, column,
    node, to_column NULL = shapes rows)``; ``reads(relation, node)`` from SQL, ``declared(relation, node)`` by
    hand; ``wildcards(relation, node)``; ``opaque(node)``. What a node declares but doesn't read it may use in
    any way. A ``*`` over a relation takes its new columns on, and changes rows where the reader shapes rows by
    that relation.

    Must run: ``node, verdict, changed_here, lineage, rows_changed, columns, how``. Verdicts: ``breaks`` (names
    a column that goes), ``unknown`` (opaque, or reads what is uncertain), ``loses_column`` (passed it on by
    ``*``), ``affected``, and ``changed`` for a changed node that nothing else reaches. ``lineage`` is ``opaque``,
    ``inferred`` where only opaque nodes lead to it, or ``parsed``. ``columns`` are those that change: all where
    rows do, null where unknown. ``how`` lists the reasons. Left alone: ``node, upstream, columns``, for each
    reader of something changed that nothing reaches and that isn't changed itself.
    """
    changes, removed = engine_changes(proposed, nodes, outputs)
    opaque = cut(opaque.select("node").distinct())
    sql = reads.select("relation", "node").distinct()
    only = declared.select("relation", "node").distinct().join(sql, ["relation", "node"], "left_anti")
    readers = sql.withColumn("blind", F.lit(False)).unionByName(only.withColumn("blind", F.lit(True))).join(opaque.withColumn("dark", F.lit(True)), "node", "left")
    readers = readers.select("relation", "node", (F.col("blind") | F.col("dark").isNotNull()).alias("blind"))
    uses, wildcards = cut(uses.select("relation", "column", "node", "to_column").distinct()), cut(wildcards.select("relation", "node").distinct())

    readers, origins = reader_marks(readers, wildcards, uses), column_origins(uses)
    hits = cut(uses.join(readers.where("not blind"), ["relation", "node"], "left_semi"))
    everything = cut(fixpoint(changes.select(*CHANGE), lambda f: _effects(f, hits, readers, origins).select(*CHANGE), CHANGE))
    reasons = cut(_effects(everything, hits, readers, origins))
    dark = reasons.select(F.col("relation").alias("node")).distinct().join(opaque, "node", "left_semi").select(F.col("node").alias("upstream"), F.lit(True).alias("dark"))
    by_dark = (F.col("reason") == "rows") & F.col("dark").isNotNull()
    reached = reasons.join(dark, "upstream", "left").groupBy(F.col("relation").alias("node")).agg(
        F.bool_or(F.col("kind") == "rows").alias("rows_changed"), F.bool_and(by_dark).alias("inferred"),
        F.array_sort(F.collect_set(F.when(by_dark, "via_opaque").otherwise(F.col("reason")))).alias("how"),
        F.array_sort(F.collect_set(F.when(F.col("kind") != "rows", F.col("column")))).alias("reached_columns"),
    )
    copies = uses.where("to_column = column").join(wildcards, ["relation", "node"], "left_semi").select("relation", "column", "node")
    broken = breaks(removed, uses, readers.select("relation", "node"), copies, wildcards, opaque)
    here = proposed.where("column is not null").join(nodes.select("node").distinct(), "node", "left_semi")
    here = here.groupBy("node").agg(F.array_sort(F.collect_set("column")).alias("own_columns"))
    every = outputs.groupBy("node").agg(F.array_sort(F.collect_set("column")).alias("all_columns"))
    j = here.join(reached, "node", "full").join(broken, "node", "left").join(opaque.withColumn("is_opaque", F.lit(True)), "node", "left").join(every, "node", "left")
    met, dark_node = F.col("how").isNotNull(), F.col("is_opaque").isNotNull()
    verdict = (
        F.when(~met, "changed").when(F.col("verdict") == "broken", "breaks").when(dark_node | (F.col("verdict") == "unknown"), "unknown")
        .when(F.col("verdict") == "dropped", "loses_column").otherwise("affected")
    )
    columns = F.when(~met, F.col("own_columns")).when(dark_node, F.lit(None)).when(F.col("rows_changed"), F.coalesce("all_columns", F.array().cast("array<string>"))).otherwise(F.col("reached_columns"))
    must = cut(j.select(
        "node", verdict.alias("verdict"), F.col("own_columns").isNotNull().alias("changed_here"),
        F.when(dark_node, "opaque").when(met & F.col("inferred"), "inferred").otherwise("parsed").alias("lineage"),
        F.coalesce("rows_changed", F.lit(False)).alias("rows_changed"), columns.alias("columns"), F.coalesce("how", F.array().cast("array<string>")).alias("how"),
    ))
    changed = everything.groupBy("relation").agg(F.array_sort(F.collect_set(F.when(F.col("column") != "", F.col("column")))).alias("columns"))
    alone = changed.join(readers.select("relation", "node"), "relation").join(must.select("node"), "node", "left_anti").select("node", F.col("relation").alias("upstream"), "columns")
    return must, alone


def simulation_totals(nodes: DataFrame, must: DataFrame, alone: DataFrame) -> DataFrame:
    """How many nodes must run, are read past and aren't downstream, by scope where there is one."""
    within = ["scope"] if "scope" in nodes.columns else []
    tag = lambda d, s: d.select(*within, "node").distinct().withColumn("kind", F.lit(s))
    every = tag(nodes, "node").unionByName(tag(must, "must_run")).unionByName(tag(alone, "left_alone"))
    n = every.groupBy(*within).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("node", "must_run", "left_alone")])
    rest = F.greatest(F.col("node") - F.col("must_run") - F.col("left_alone"), F.lit(0))
    return n.select(*within, "must_run", "left_alone", rest.alias("not_downstream"))


def tests_to_run(tests: DataFrame, must: DataFrame) -> DataFrame:
    """The tests declared on the nodes that must run."""
    keys = ["scope", "node"] if "scope" in tests.columns else ["node"]
    return tests.join(must.select(*keys).distinct(), keys, "left_semi")
