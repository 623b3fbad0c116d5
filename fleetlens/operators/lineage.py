"""Column lineage: uses, impact, breaks, comparison with what was observed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.plans.fixpoint import fixpoint
from fleetlens.plans.scopes import by_scope
from fleetlens.plans.shared import cut

#: The columns that name something within a scope; inputs may have a ``scope``, which results then have too.
NAMES = ("relation", "node", "from_relation", "seed", "path")
scoped = by_scope(*NAMES)


@scoped
def consumer_index(edges: DataFrame, reads: DataFrame, declared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every use of each upstream column, and every reader of each relation (from SQL or declared)."""
    uses = edges.groupBy("relation", "column").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("node").alias("nodes"))
    readers = reads.select("node", "relation").unionByName(declared.select("node", "relation")).distinct()
    return uses, readers


@scoped
def inputs_of(edges: DataFrame, row_inputs: DataFrame) -> DataFrame:
    """An output column's direct inputs and its node's row inputs, as a set."""
    outs = edges.select("node", "output").distinct()
    return edges.select("node", "output", "source").unionByName(outs.join(row_inputs.select("node", "source"), "node").select("node", "output", "source")).distinct()


@scoped
def unresolved_readers(unresolved: DataFrame, columns: DataFrame) -> DataFrame:
    """Nodes whose SQL reads one of the given (relation, column) pairs, which their relation lacks."""
    return unresolved.join(columns, ["relation", "column"], "left_semi").select("node").distinct()


@scoped
def missing_columns(reads: DataFrame, outputs: DataFrame, known: DataFrame, identity: DataFrame) -> DataFrame:
    """Columns read that a known upstream doesn't produce, ignoring case, with what they may be called now.

    Rename candidates: outputs of the upstream that copy a column of that name.
    """
    key = lambda d, c: d.withColumn("key", F.lower(c))
    gone = key(reads.join(known, "relation", "left_semi"), "column").join(key(outputs, "column").select("relation", "key"), ["relation", "key"], "left_anti")
    may = identity.select("relation", F.lower("from_column").alias("key"), F.col("column").alias("now")).distinct()
    return gone.join(may, ["relation", "key"], "left").groupBy("node", "relation", "column").agg(F.array_join(F.array_sort(F.collect_set("now")), ",").alias("candidates"))


@scoped
def compare_observed(predicted: DataFrame, observed: DataFrame) -> DataFrame:
    """Per node, predicted against observed (source, output) pairs.

    A pair found only as an indirect input of the node counts as ``matched_indirect``, not missing.
    """
    p = predicted.groupBy("node", "source", "output").agg(F.bool_or(F.col("edge_type") == "DIRECT").alias("direct"))
    o = observed.select("node", "source", "output").distinct().withColumn("seen", F.lit(True))
    indirect = p.where(~F.col("direct")).select("node", "source").distinct().withColumn("ind", F.lit(True))
    j = p.join(o, ["node", "source", "output"], "full").join(indirect, ["node", "source"], "left")
    has, seen, ind = F.col("direct").isNotNull() & F.col("direct"), F.coalesce("seen", F.lit(False)), F.coalesce("ind", F.lit(False))
    g = j.groupBy("node").agg(
        F.count_if(has & seen).alias("matched"), F.count_if(~has & seen & ind).alias("matched_indirect"), F.count_if(~has & seen & ~ind).alias("missing"), F.count_if(has & ~seen).alias("unobserved"),
    )
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    good = F.col("matched") + F.col("matched_indirect")
    return g.withColumns({"precision": ratio(F.col("matched"), F.col("matched") + F.col("unobserved")), "recall": ratio(good, good + F.col("missing"))})


def comparison_totals(compared: DataFrame) -> DataFrame:
    """A10: fleet precision and recall; null where nothing was there to compare."""
    g = compared.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("matched", "matched_indirect", "missing", "unobserved")])
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    good = F.col("matched") + F.col("matched_indirect")
    return g.withColumns({"precision": ratio(F.col("matched"), F.col("matched") + F.col("unobserved")), "recall": ratio(good, good + F.col("missing"))})


@scoped
def with_observed(predicted: DataFrame, observed: DataFrame, opaque: DataFrame, trust: bool) -> tuple[DataFrame, DataFrame]:
    """Opaque nodes take the observed edges; they stay opaque for impact unless trusted."""
    taken = observed.join(opaque.select("node"), "node", "left_semi").select("node", "source", "output", F.lit("DIRECT").alias("edge_type")).distinct()
    rest = opaque.join(taken.select("node").distinct(), "node", "left_anti") if trust else opaque
    return predicted.unionByName(taken), rest.select("node")


@scoped
def reaches(seeds: DataFrame, edges: DataFrame, outputs: DataFrame) -> DataFrame:
    """Every (relation, column) affected by ``seeds``; a use that shapes rows affects all outputs of its node.

    ``edges(from_relation, from_column, node, to_column NULL = shapes rows)``.
    """
    direct = edges.where("to_column is not null").select("from_relation", "from_column", F.col("node").alias("relation"), F.col("to_column").alias("column"))
    shape = edges.where("to_column is null").select("from_relation", "from_column", F.col("node").alias("relation")).distinct().join(outputs.select("relation", "column"), "relation").select("from_relation", "from_column", "relation", "column")
    e = cut(direct.unionByName(shape).distinct())
    step = lambda f: f.select(F.col("relation").alias("from_relation"), F.col("column").alias("from_column")).join(e, ["from_relation", "from_column"]).select("relation", "column")
    return fixpoint(seeds.select("relation", "column"), step, ["relation", "column"])


@scoped
def value_sources(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """The columns that values come from at last: inputs over direct edges that have none themselves.

    First the columns above the seeds, each once; then their last inputs, from the top down. So a row is a
    column with one of its last inputs, never a seed with all that lies between.
    """
    e = cut(edges.where("to_column is not null").select(F.col("from_relation").alias("r"), F.col("from_column").alias("c"), F.col("node").alias("relation"), F.col("to_column").alias("column")).distinct())
    at, up = ["relation", "column"], F.struct(F.col("r").alias("relation"), F.col("c").alias("column"))
    above = cut(fixpoint(seeds.select(*at), lambda f: f.join(e, at).select(up.alias("x")).select("x.*"), at))
    e = cut(e.join(above, at, "left_semi"))
    last = above.join(e.select(*at), at, "left_anti").select(*at, F.col("relation").alias("from_relation"), F.col("column").alias("from_column"))
    below = lambda f: f.withColumnsRenamed({"relation": "r", "column": "c"}).join(e, ["r", "c"]).select(*at, "from_relation", "from_column")
    found = fixpoint(last, below, [*at, "from_relation", "from_column"]).join(seeds.select(*at).distinct(), at)
    found = found.where((F.col("relation") != F.col("from_relation")) | (F.col("column") != F.col("from_column")))
    return found.select(F.concat_ws(".", "relation", "column").alias("seed"), F.col("from_relation").alias("relation"), F.col("from_column").alias("column")).distinct()


@scoped
def lineage_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns added, removed or modified (digest or place differs): ``(node, column, digest, ordinal)``."""
    b = before.select("node", "column", F.col("digest").alias("was"), F.col("ordinal").alias("at"))
    a = after.select("node", "column", F.col("digest").alias("now"), F.col("ordinal").alias("to"))
    j = b.join(a, ["node", "column"], "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when((F.col("was") != F.col("now")) | (F.col("at") != F.col("to")), "modified")
    return j.select("node", "column", change.alias("change")).where("change is not null")


def reader_marks(readers: DataFrame, wildcards: DataFrame, uses: DataFrame) -> DataFrame:
    """``readers(relation, node, blind)`` with ``star`` (reads it by ``*``) and ``shaped`` (shapes rows by it), once for all rounds."""
    at = ["relation", "node"]
    star = wildcards.select(*at).distinct().withColumn("star", F.lit(True))
    shaped = uses.where("to_column is null").select(*at).distinct().withColumn("shaped", F.lit(True))
    marked = readers.join(star, at, "left").join(shaped, at, "left")
    return cut(marked.select(*at, "blind", F.col("star").isNotNull().alias("star"), F.col("shaped").isNotNull().alias("shaped")))


def column_origins(uses: DataFrame) -> DataFrame:
    """Of each node and column name the first and last relation that the node takes it from."""
    return cut(uses.groupBy("node", "column").agg(F.min("relation").alias("first"), F.max("relation").alias("last")))


def taken_elsewhere(added: DataFrame, changes: DataFrame, origins: DataFrame) -> DataFrame:
    """The rows of ``added(relation, column, node)``, from ``changes``, whose node takes that column name from another relation too."""
    named = origins.join(changes.where("kind = 'added'").select("column").distinct(), "column", "left_semi")
    return added.join(named, ["node", "column"]).where("first <> relation or last <> relation")


@scoped
def impact(changes: DataFrame, uses: DataFrame, readers: DataFrame, wildcards: DataFrame, opaque: DataFrame) -> DataFrame:
    """What changes reach, with the reason: column, rows, wildcard, name_capture or opaque.

    ``changes(relation, column, kind)``: kind added, removed, modified, or rows (no column).
    ``uses(relation, column, node, to_column NULL = shapes rows)``; ``readers(relation, node)``.
    Each distinct change is followed once; every round joins the frontier with the five rules.
    Returns ``(relation, column, kind, reason)``: the changes at each node, reason of the first round.
    """
    dark = opaque.select("node").distinct()
    readers = reader_marks(readers.join(dark.withColumn("blind", F.lit(True)), "node", "left").select("relation", "node", F.col("blind").isNotNull().alias("blind")).distinct(), wildcards, uses)
    hits, other = cut(uses.select("relation", "column", "node", "to_column").distinct().join(dark, "node", "left_anti")), column_origins(uses)
    none = F.lit("")
    seed = changes.select("relation", F.coalesce("column", none).alias("column"), "kind", F.lit("seed").alias("reason"))
    row = lambda d, reason: d.select(F.col("node").alias("relation"), none.alias("column"), F.lit("rows").alias("kind"), F.lit(reason).alias("reason"))

    def step(f: DataFrame) -> DataFrame:
        f = f.select("relation", "column", "kind")
        read = f.join(readers, "relation")
        blind, clear = row(read.where("blind"), "opaque"), read.where("not blind")
        rows = row(clear.where("kind = 'rows'"), "rows")
        added = clear.where("kind = 'added'")
        star = added.where("star").select(F.col("node").alias("relation"), "column", "kind", F.lit("wildcard").alias("reason"))
        capture = row(taken_elsewhere(added, f, other), "name_capture")
        hit = f.where("kind in ('removed', 'modified')").join(hits, ["relation", "column"])
        value = hit.where("to_column is not null").select(F.col("node").alias("relation"), F.col("to_column").alias("column"), F.lit("modified").alias("kind"), F.lit("column").alias("reason"))
        shaped = row(hit.where("to_column is null"), "column")
        found = blind.unionByName(rows).unionByName(star).unionByName(capture).unionByName(value).unionByName(shaped)
        return found.groupBy("relation", "column", "kind").agg(F.min("reason").alias("reason"))

    return fixpoint(seed, step, ["relation", "column", "kind"])


@scoped
def pruned_readers(changes: DataFrame, readers: DataFrame, impacted: DataFrame) -> DataFrame:
    """Readers of changed relations that nothing reached, with how many changed columns they don't use."""
    near = changes.select("relation", "column").distinct().join(readers.distinct(), "relation")
    return near.join(impacted.where("reason <> 'seed'").select(F.col("relation").alias("node")).distinct(), "node", "left_anti").groupBy("node").agg(F.count(F.lit(1)).alias("unused"))


@scoped
def breaks(removed: DataFrame, uses: DataFrame, readers: DataFrame, copies: DataFrame, wildcards: DataFrame, opaque: DataFrame) -> DataFrame:
    """What removed columns break: ``broken`` names one, ``dropped`` passed it on by ``*``, else ``unknown``.

    ``copies(relation, column, node)``: identity copies that a ``*`` makes, which go on as removed.
    Uncertainty starts at opaque readers and goes on through opaque and ``*`` readers. Broken wins.
    """
    copies, uses, readers, opaque = cut(copies.distinct()), cut(uses.distinct()), cut(readers.distinct()), cut(opaque.distinct())
    keys = ["relation", "column"]
    gone = fixpoint(removed.select(*keys), lambda f: f.join(copies, keys).select(F.col("node").alias("relation"), "column"), keys)
    gone = cut(gone)
    used = gone.join(uses, keys).join(opaque, "node", "left_anti").join(copies, [*keys, "node"], "left_anti").select("node").distinct()
    dropped = gone.join(copies, keys).select("node").distinct()
    start = gone.select("relation").distinct().join(readers, "relation").join(opaque, "node", "left_semi").select("node").distinct()
    passes = cut(readers.join(opaque, "node", "left_semi").unionByName(wildcards.select("relation", "node")).distinct())
    unsure = fixpoint(start, lambda f: f.select(F.col("node").alias("relation")).join(passes, "relation").select("node"), ["node"])
    lab = lambda d, s: d.select("node", F.lit(s).alias("verdict"))
    sure = lab(used, "broken").unionByName(lab(dropped.join(used, "node", "left_anti"), "dropped"))
    return sure.unionByName(lab(unsure.join(sure.select("node"), "node", "left_anti"), "unknown"))


@scoped
def downstream_uses(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """The paths of uses from a column, of any length, none twice on its own path; a use that shapes rows ends one."""
    e = cut(edges.select(F.concat_ws(".", "from_relation", "from_column").alias("at"), F.when(F.col("to_column").isNotNull(), F.concat_ws(".", "node", "to_column")).otherwise(F.concat(F.col("node"), F.lit(".*"))).alias("next"), F.col("to_column").isNull().alias("ends")).distinct())
    paths = cut(seeds.select(F.concat_ws(".", "relation", "column").alias("at")).withColumn("path", F.array("at")))
    out = None
    while True:  # ends, since no path repeats a column
        paths = cut(paths.join(e, "at").where(~F.array_contains("path", F.col("next"))).select(F.col("next").alias("at"), F.array_append("path", F.col("next")).alias("path"), "ends"))
        if paths.isEmpty():
            break
        done = paths.select(F.array_join("path", ">").alias("path"), F.size("path").alias("steps"))
        out = done if out is None else out.unionByName(done)
        paths = paths.where("not ends").select("at", "path")
    return out if out is not None else seeds.select(F.lit("").alias("path"), F.lit(0).alias("steps")).limit(0)


@scoped
def openlineage_events(reads: DataFrame, edges: DataFrame, opaque: DataFrame) -> DataFrame:
    """One event per node as JSON: inputs, output, column lineage (opaque nodes: inputs only), a stable run id."""
    ins = reads.groupBy("node").agg(F.array_sort(F.collect_set("relation")).alias("inputs"))
    fields = edges.groupBy("node", "output").agg(F.array_sort(F.collect_set("source")).alias("from")).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("output", "from"))).alias("columns"))
    j = ins.join(fields.join(opaque, "node", "left_anti"), "node", "left")
    h = F.sha2(F.col("node").cast("string"), 256)
    run = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return j.select("node", F.to_json(F.struct(F.lit("COMPLETE").alias("eventType"), run.alias("runId"), F.col("node").cast("string").alias("output"), "inputs", "columns")).alias("event"))


@scoped
def simulate(changes: DataFrame, impacted: DataFrame, broken: DataFrame) -> DataFrame:
    """A verdict per node for proposed changes: broken, dropped, unknown, changed (rows or values) or reached only by name."""
    i = impacted.where("reason <> 'seed'").groupBy(F.col("relation").alias("node")).agg(F.bool_or(F.col("kind") == "rows").alias("rows"), F.bool_or(F.col("kind") == "modified").alias("values"))
    j = i.join(broken, "node", "full")
    verdict = F.when(F.col("verdict").isNotNull(), F.col("verdict")).when(F.col("rows"), "rows_change").when(F.col("values"), "values_change").otherwise("gains_columns")
    return j.select("node", verdict.alias("verdict"))




def relation_changes(before: DataFrame, after: DataFrame, outputs_before: DataFrame, outputs_after: DataFrame) -> DataFrame:
    """G8 in full: what changed between two analyses of each relation, as ``scope, node, change, column, why``.

    ``before`` and ``after`` hold ``(scope, node, opaque, row_digest)``, one row a relation, the outputs ``(scope, node, column, digest, ordinal)``.

    Where nothing can be proven unchanged there is one ``rows`` change, and every column may differ: the relation is ``new``, ``opaque``
    on either side, its ``row_digest`` differs, or a name stands twice on either side (``duplicate_name``; the first of these is why).
    Otherwise columns are ``added``, ``removed`` or ``modified``; among the columns of both sides one whose place differs is modified too
    (``moved``), since unions and stars read by position. Null digests equal one another; outputs without a name aren't compared.
    Relations that are no longer there aren't listed.
    """
    at = ["scope", "node"]
    twice = lambda o: o.where("column is not null").groupBy(*at, "column").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*at)
    doubled = twice(outputs_before).unionByName(twice(outputs_after)).distinct().withColumn("doubled", F.lit(True))
    b = before.select(*at, F.col("opaque").alias("b_opaque"), F.col("row_digest").alias("was"), F.lit(True).alias("there"))
    m = after.select(*at, "opaque", F.col("row_digest").alias("now")).join(b, at, "left").join(doubled, at, "left")
    why = F.when(F.col("there").isNull(), "new").when(F.col("opaque") | F.col("b_opaque"), "opaque").when(~F.col("was").eqNullSafe(F.col("now")), "row_digest").when(F.col("doubled"), "duplicate_name")
    m = m.select(*at, why.alias("why"))
    whole = m.where("why is not null").select(*at, F.lit("rows").alias("change"), F.lit(None).cast("string").alias("column"), "why")
    plain = m.where("why is null").select(*at)
    side = lambda o, s: o.where("column is not null").join(plain, at, "left_semi").select(*at, "column", F.col("digest").alias(f"{s}_digest"), F.col("ordinal").alias(f"{s}_at"), F.lit(True).alias(s))
    j = side(outputs_before, "old").join(side(outputs_after, "new"), [*at, "column"], "full")
    # a relation has few columns, so a window over them is small
    both = F.col("old") & F.col("new")
    place = lambda s: F.row_number().over(Window.partitionBy(*at, both.isNotNull()).orderBy(f"{s}_at", "column"))
    j = j.withColumn("was", place("old")).withColumn("now", place("new"))
    same = F.col("old_digest").eqNullSafe(F.col("new_digest"))
    j = j.withColumn("change", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~same | (F.col("was") != F.col("now")), "modified"))
    reason = F.when(both & same, "moved").when(both, "digest")
    return whole.unionByName(j.where("change is not null").select(*at, "change", "column", reason.alias("why")))
