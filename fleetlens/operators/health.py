"""Health checks, badges, coverage, facets and catalog lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.plans.fixpoint import fixpoint

# Every health, in order.
HEALTHS = ["failing", "warning", "unknown", "healthy"]


def by(df: DataFrame, *keys: str) -> list[str]:
    """Keys, with the scope where the frame has one: two projects may have a node of one name."""
    return [*(["scope"] if "scope" in df.columns else []), *keys]


def finding(nodes: DataFrame, check: str, severity: str, status: Column) -> DataFrame:
    return nodes.select(*by(nodes, "node"), F.lit(check).alias("check"), F.lit(severity).alias("severity"), status.alias("status"))


def select_nodes(nodes: DataFrame, types: list[str] | None = None, tags: list[str] | None = None, glob: str | None = None, exclude: Column | None = None) -> DataFrame:
    """Type AND any tag AND name glob, each ignored when empty; an exclusion wins."""
    out = nodes
    if types:
        out = out.where(F.col("resource_type").isin(types))
    if tags:
        out = out.where(F.col("tag").isin(tags))
    if glob:
        pattern = "^" + "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c == " " else "\\" + c for c in glob) + "$"
        out = out.where(F.col("name").rlike(pattern))
    return out if exclude is None else out.where(~exclude)


def built(nodes: DataFrame, state: DataFrame) -> DataFrame:
    """H1: pass if a build is recorded, else unknown."""
    key = by(nodes, "node")
    j = nodes.join(state.select(*key, "built_at"), key, "left")
    return finding(j, "built", "warn", F.when(F.col("built_at").isNotNull(), "pass").otherwise("unknown"))


def last_run(nodes: DataFrame, results: DataFrame, state: DataFrame, action: str) -> DataFrame:
    """H2 (failed), H3 (skipped): fail if so in the last run and not built strictly after it began (whole seconds)."""
    key = by(nodes, "node")
    j = nodes.join(results.select(*key, "action", "started_at"), key, "left").join(state.select(*key, "built_at"), key, "left")
    later = F.coalesce(F.unix_timestamp("built_at") > F.unix_timestamp("started_at"), F.lit(False))
    status = F.when(F.col("action").isNull(), "unknown").when((F.col("action") == action) & ~later, "fail").otherwise("pass")
    return finding(j, f"last_run_{action}", "error", status)


def tests_required(nodes: DataFrame) -> DataFrame:
    """H4: fail without tests."""
    return finding(nodes, "tests_required", "warn", F.when(F.col("tests") == 0, "fail").otherwise("pass"))


def tests_passed(nodes: DataFrame) -> DataFrame:
    """H5: skipped without tests or a build; fail if not recorded as passed or the tests changed since."""
    status = F.when((F.col("tests") == 0) | ~F.col("was_built"), "skipped").when(F.col("tested_checks").isNull(), "fail").when(F.col("tested_checks") != F.col("checks"), "fail").otherwise("pass")
    return finding(nodes, "tests_passed", "error", status)


def declared(nodes: DataFrame, check: str, severity: str, condition: Column) -> DataFrame:
    """H6: a declared condition as findings: never unknown."""
    return finding(nodes, check, severity, F.when(F.coalesce(condition, F.lit(False)), "pass").otherwise("fail"))


def probe_check(nodes: DataFrame, check: str, severity: str, condition: Column, guards: Column) -> DataFrame:
    """H7: a probe's verdict; any unmet guard makes it unknown, never a pass."""
    status = F.when(~F.coalesce(guards, F.lit(False)), "unknown").when(condition, "pass").when(~condition, "fail").otherwise("unknown")
    return finding(nodes, check, severity, status)


def reconcile(asked: DataFrame, answers: DataFrame, everyone: DataFrame, checks: list[str]) -> DataFrame:
    """H8: the answers of the registered ``checks``. Unanswered or answered twice: unknown; a stranger voids the check; unasked: skipped.

    Every node gets a row for each registered check, one that answers nothing included. All frames may
    have a ``scope``, within which nodes are told apart. Answers of other checks are left out.
    """
    on = by(everyone, "node")
    known = answers.where(F.col("check").isin(checks))
    # one row a check at most
    strangers = known.join(everyone.select(*on), on, "left_anti").select(*on[:-1], "check").distinct().withColumn("void", F.lit(True))
    a = known.groupBy("check", *on).agg(F.count(F.lit(1)).alias("n"), F.min("status").alias("status"))
    grid = everyone.select(*on, F.explode(F.array(*map(F.lit, checks))).alias("check"))
    j = grid.join(a, ["check", *on], "left").join(strangers, [*on[:-1], "check"], "left").join(asked.select(*on).withColumn("asked", F.lit(True)), on, "left")
    status = F.when(F.col("asked").isNull(), "skipped").when(F.col("void"), "unknown").when(F.col("n").isNull() | (F.col("n") > 1), "unknown").otherwise(F.col("status"))
    return j.select(*on, "check", status.alias("status"))


def badge(findings: DataFrame) -> DataFrame:
    """A node's health: failing on an error; unknown if undecided; warning on a warning; healthy on a pass."""
    bad = F.col("status") == "fail"
    key = by(findings, "node")
    g = findings.groupBy(*key).agg(
        F.bool_or(bad & (F.col("severity") == "error")).alias("e"), F.bool_or((F.col("status") == "unknown") & (F.col("severity") == "error")).alias("u"),
        F.bool_or(bad & (F.col("severity") == "warn")).alias("w"), F.bool_or(F.col("status") == "pass").alias("p"),
        F.array_join(F.array_sort(F.collect_set(F.when(bad, F.col("check")))), ",").alias("reasons"),
    )
    return g.select(*key, F.when(F.col("e"), "failing").when(F.col("u"), "unknown").when(F.col("w"), "warning").when(F.col("p"), "healthy").otherwise("unknown").alias("health"), "reasons")


def health_counts(badges: DataFrame) -> DataFrame:
    """Nodes by health, of each scope where there are scopes; every health is listed, with zeros."""
    within = by(badges)
    counts = badges.groupBy(*within).agg(*[F.count_if(F.col("health") == h).alias(h) for h in HEALTHS])
    return counts.select(*within, F.explode(F.array(*[F.struct(F.lit(h).alias("health"), F.col(h).alias("n")) for h in HEALTHS])).alias("x")).select(*within, "x.health", "x.n")


def report_fails(findings: DataFrame, strict: bool, coverage: DataFrame | None = None, unmatched: DataFrame | None = None) -> DataFrame:
    """Whether a report fails: an error-level failure; strict also counts what couldn't be decided.

    ``coverage(severity, status)`` holds the verdicts of coverage targets, ``unmatched(severity)`` the enabled probes that
    selected nothing: they checked nothing, hence are unknown. ``n`` counts what failed the report.
    """
    within = by(findings)
    every = findings.select(*within, "severity", "status")
    if coverage is not None:
        every = every.unionByName(coverage.select(*within, "severity", "status"))
    if unmatched is not None:
        every = every.unionByName(unmatched.select(*within, "severity", F.lit("unknown").alias("status")))
    bad = (F.col("severity") == "error") & (F.col("status").isin("fail", "unknown") if strict else F.col("status") == "fail")
    return every.groupBy(*within).agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("fails"), F.count_if(bad).alias("n"))


def unmatched_probes(probes: DataFrame, selected: DataFrame) -> DataFrame:
    """Probes that select no node."""
    key = by(probes, "probe")
    return probes.join(selected.select(*key).distinct(), key, "left_anti")


def merge_recorded(live: DataFrame, recorded: DataFrame) -> DataFrame:
    """H9: live findings now, others from the latest record."""
    key = by(live, "node", "check")
    return live.unionByName(recorded.join(live.select(*key), key, "left_anti"))


def latest_records(records: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` records of each scope."""
    w = Window.partitionBy("scope").orderBy(F.desc("at"), F.desc("id"))
    return records.withColumn("age", F.row_number().over(w)).where(F.col("age") <= keep)


def coverage(nodes: DataFrame, facet: str) -> DataFrame:
    """Covered and total for tests and descriptions; null where there is nothing to measure."""
    return nodes.groupBy(*by(nodes, facet)).agg(F.count_if(F.col("tests") > 0).alias("tested"), F.count_if("described").alias("described"), F.nullif(F.count(F.lit(1)), F.lit(0)).alias("total"))


def coverage_verdict(covered: DataFrame, target: int) -> DataFrame:
    """Integer thousandths: ``covered * 1000 >= target * total``; the share is rounded down."""
    c, t = F.col("tested"), F.col("total")
    return covered.withColumns({"share": F.floor(c * 1000 / t), "verdict": F.when(t.isNull(), "unknown").when(c * 1000 >= t * target, "pass").otherwise("fail")})


def facets(nodes: DataFrame, columns: list[str], domains: dict[str, list] | None = None, chosen: dict[str, list] | None = None) -> DataFrame:
    """Value counts of several facets in one pass, of each scope where there are scopes.

    Values of a fixed domain (``domains``) and values that are selected (``chosen``) are listed with 0 where no node has them.
    """
    within = by(nodes)
    pair = lambda c, value: F.struct(F.lit(c).alias("facet"), value.cast("string").alias("value"))
    out = nodes.select(*within, F.explode(F.array(*[pair(c, F.col(c)) for c in columns])).alias("x"), F.lit(1).alias("one"))
    listed = [(c, v) for some in (domains or {}, chosen or {}) for c, values in some.items() if c in columns for v in values]
    if listed:
        scopes = nodes.select(*within).distinct() if within else nodes.sparkSession.range(1).select()
        out = out.unionByName(scopes.select(*within, F.explode(F.array(*[pair(c, F.lit(v)) for c, v in listed])).alias("x"), F.lit(0).alias("one")))
    return out.groupBy(*within, "x.facet", "x.value").agg(F.sum("one").alias("n"))


def run_facets(runs: DataFrame, chosen: dict[str, str]) -> DataFrame:
    """Each facet's counts under the other facets' choices, in one pass."""
    names = list(chosen)
    ok = {c: F.col(c) == v for c, v in chosen.items()}
    others = lambda c: [ok[o] for o in names if o != c]
    every = lambda xs: F.lit(True) if not xs else xs[0] if len(xs) == 1 else xs[0] & every(xs[1:])
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value"), every(others(c)).alias("hit")) for c in names])
    return runs.select(F.explode(pairs).alias("x")).groupBy("x.facet", "x.value").agg(F.count_if("x.hit").alias("n"))


def catalog_filter(nodes: DataFrame, chosen: dict[str, list], text: str) -> DataFrame:
    """P5: any chosen value of a facet, all facets; the name or the node's id contains the text, ignoring case."""
    out = nodes
    for c, values in chosen.items():
        out = out.where(F.col(c).isin(values))
    holds = lambda c: F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False))
    return out.where(holds("name") | holds("node") if "node" in out.columns else holds("name"))


def catalog_sort(nodes: DataFrame, column: str, descending: bool, within: str = "scope") -> DataFrame:
    """Places in the order of a column among the nodes of one ``within``; missing values last both ways; ties by node."""
    key = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    return nodes.select("node", F.row_number().over(Window.partitionBy(within).orderBy(key, "node")).alias("place"), within)


def layer_order(nodes: DataFrame) -> DataFrame:
    """A layer stands where its shallowest node does."""
    return nodes.groupBy(*by(nodes, "layer")).agg(F.min("depth").alias("position"))


def privilege_audit(grants: DataFrame, owners: DataFrame, relations: DataFrame) -> DataFrame:
    """Per relation and login: read_only, elevated with what elevates it, or unknown (external relations).

    ``grants(relation, login, privilege)``, ``owners(relation, login)``, ``relations(relation, external)``.
    """
    more = grants.select("relation", "login", "privilege").unionByName(owners.select("relation", "login").withColumn("privilege", F.lit("OWNERSHIP")))
    g = more.groupBy("relation", "login").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("privilege") != "SELECT", F.col("privilege")))), ",").alias("beyond"))
    j = g.join(relations, "relation", "left")
    return j.select("relation", "login", F.when(F.coalesce("external", F.lit(True)), "unknown").when(F.col("beyond") == "", "read_only").otherwise("elevated").alias("verdict"), "beyond")


# The privileges that only read, by the level they are granted at; and the relations whose data only grants reach.
READING = {
    "relation": ["SELECT", "BROWSE"],
    "schema": ["SELECT", "BROWSE", "USE SCHEMA"],
    "catalog": ["SELECT", "BROWSE", "USE CATALOG", "USE SCHEMA"],
    "metastore": ["USE MARKETPLACE ASSETS"],
}
GOVERNED = ["MANAGED", "VIEW", "MATERIALIZED_VIEW"]


def effective_privileges(grants: DataFrame, owners: DataFrame, members: DataFrame, logins: DataFrame) -> DataFrame:
    """What each login holds beyond reading, itself or through groups: ``level, securable, login, what``.

    ``grants(level, securable, principal, privilege, grantable)`` in either spelling of a privilege,
    ``owners(level, securable, principal)``, ``members(member, group)`` nested to any depth, ``logins(login)``.
    A reading privilege that may be granted on is beyond reading.
    """
    step = lambda f: f.join(members.select(F.col("member").alias("principal"), F.col("group").alias("next")), "principal").select("login", F.col("next").alias("principal"))
    acts_as = fixpoint(logins.select("login", F.col("login").alias("principal")).distinct(), step, ["login", "principal"])
    spelt = grants.withColumn("privilege", F.translate(F.upper("privilege"), "_", " "))
    reads = F.lit(False)
    for level, names in READING.items():
        reads = reads | ((F.col("level") == level) & F.col("privilege").isin(names))
    beyond = spelt.where(~reads | F.coalesce("grantable", F.lit(False))).select("level", "securable", "principal", F.col("privilege").alias("what"))
    held = beyond.unionByName(owners.select("level", "securable", "principal", F.lit("OWNERSHIP").alias("what")))
    return held.join(acts_as, "principal").select("level", "securable", "login", "what").distinct()


def privilege_report(asked: DataFrame, relations: DataFrame, held: DataFrame) -> DataFrame:
    """J22 over the hierarchy: ``relation, login, verdict, beyond`` for each ``asked(relation, login)``.

    ``relations(relation, schema, catalog, metastore, kind)``; ``held`` as of ``effective_privileges``, where
    a grant on a schema, catalog or metastore reaches every relation in it. A relation that isn't listed, or of a
    kind whose files are reached past the grants, is unknown; ``beyond`` says what elevates, by level.
    """
    places = asked.join(relations, "relation", "left")
    found = None
    for level in READING:
        own = held.where(F.col("level") == level).groupBy("securable", "login").agg(F.array_sort(F.collect_set("what")).alias("what"))
        one = places.join(own.withColumnRenamed("securable", level), [level, "login"]).select("relation", "login", F.concat(F.array_join("what", ", "), F.lit(f" on the {level}")).alias("line"), F.lit(list(READING).index(level)).alias("n"))
        found = one if found is None else found.unionByName(one)
    lines = found.groupBy("relation", "login").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("n", "line"))), lambda x: x["line"]), "; ").alias("beyond"))
    out = places.join(lines, ["relation", "login"], "left")
    known = F.coalesce(F.upper("kind").isin(GOVERNED), F.lit(False))
    return out.select("relation", "login", F.when(~known, "unknown").when(F.col("beyond").isNull(), "read_only").otherwise("elevated").alias("verdict"), F.when(known, F.coalesce("beyond", F.lit(""))).alias("beyond"))


def expected_relation(found: DataFrame) -> DataFrame:
    """A relation that isn't the one its build made, ignoring case, is unknown."""
    return found.select("node", F.when(F.lower("expected").eqNullSafe(F.lower("found")), "match").otherwise("unknown").alias("verdict"))


def column_views(code: DataFrame, warehouse: DataFrame, tests: DataFrame) -> DataFrame:
    """One row a column, ignoring case: where it is known from, its tests; only the warehouse lists it: possibly stale."""
    c = code.select("node", F.lower("column").alias("column"), F.lit(True).alias("c"))
    w = warehouse.select("node", F.lower("column").alias("column"), "type", F.lit(True).alias("w"))
    t = tests.groupBy("node", F.lower("column").alias("column")).agg(F.array_join(F.array_sort(F.collect_set("test")), ",").alias("tests"))
    j = c.join(w, ["node", "column"], "full").join(t, ["node", "column"], "left")
    return j.select("node", "column", "type", F.coalesce("tests", F.lit("")).alias("tests"), F.col("c").isNull().alias("possibly_stale"))


# ---- coverage and columns at the catalog's width -----------------------------------------------

# What coverage measures, in order.
MEASURES = ["tests", "descriptions", "constraints", "source_freshness"]


def coverage_measures(models: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A8 in full: each scope's four measures, and everything that they find uncovered.

    ``models(scope, node, name, tests, description, constraints)`` with numbers of tests and of column constraints,
    ``sources(scope, node, name, measured_with, read_by_runs, version)``: a source is covered if any of the three is known.
    Blank descriptions describe nothing, unknown numbers count as none.

    Returns ``scope, measure, covered, total`` for all measures of every scope of either side, ``covered`` null where there is nothing
    to measure, and ``scope, measure, node, name``: one row for each that isn't covered, so that no list grows with a project.
    """
    held = lambda m, ok: F.struct(F.lit(m).alias("measure"), F.coalesce(ok, F.lit(False)).alias("ok"))
    of_models = models.select("scope", "node", "name", F.explode(F.array(held("tests", F.col("tests") > 0), held("descriptions", F.trim("description") != ""), held("constraints", F.col("constraints") > 0))).alias("x"))
    known = F.col("measured_with").isNotNull() | F.col("read_by_runs").isNotNull() | F.col("version").isNotNull()
    of_sources = sources.select("scope", "node", "name", held("source_freshness", known).alias("x"))
    each = of_models.unionByName(of_sources).select("scope", "node", "name", "x.measure", "x.ok")
    scopes = models.select("scope").unionByName(sources.select("scope")).distinct()
    frame = scopes.select("scope", F.explode(F.array(*[F.lit(m) for m in MEASURES])).alias("measure"))
    counts = each.groupBy("scope", "measure").agg(F.count_if("ok").alias("covered"), F.count(F.lit(1)).alias("total"))
    return frame.join(counts, ["scope", "measure"], "left").select("scope", "measure", "covered", F.coalesce("total", F.lit(0)).alias("total")), each.where(~F.col("ok")).select("scope", "measure", "node", "name")


def column_catalog(listed: DataFrame, code: DataFrame, tests: DataFrame, constraints: DataFrame, edges: DataFrame) -> DataFrame:
    """J25 in full: one row a listed column, ignoring case.

    ``listed(scope, node, column, lister, type)`` with ``lister`` ``declared`` or ``warehouse``; ``code(scope, node, column)`` as the code
    gives them; ``tests(scope, node, column, test)``; ``constraints(scope, node, column, constraint)``; ``edges(scope, node, column,
    from_node, from_column)``.

    Returns ``scope, node, column, type, type_source, possibly_stale, tests, constraints, upstream``: the declared spelling before the
    warehouse's, the warehouse's type before the declared one (of several the first), possibly stale if only the warehouse lists
    the column and the code doesn't give it; names joined by commas, null where there are none; inputs of the node itself bare,
    others as ``node.column``.
    """
    key = ["scope", "node", "key"]
    low = lambda df: df.withColumn("key", F.lower("column"))
    names = lambda df, c, out: low(df).groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set(c)), ",").alias(out))
    of = lambda w, c: F.when(F.col("lister") == w, F.col(c))
    c = low(listed).groupBy(*key).agg(F.min(of("declared", "column")).alias("d"), F.min(of("warehouse", "column")).alias("w"), F.min(of("declared", "type")).alias("dt"), F.min(of("warehouse", "type")).alias("wt"))
    given = low(code).select(*key).distinct().withColumn("given", F.lit(True))
    source = F.when(F.col("from_node") == F.col("node"), F.col("from_column")).otherwise(F.concat_ws(".", "from_node", "from_column"))
    j = c.join(given, key, "left").join(names(tests, "test", "tests"), key, "left").join(names(constraints, "constraint", "constraints"), key, "left").join(names(edges.where("from_column is not null"), source, "upstream"), key, "left")
    origin = F.when(F.col("wt").isNotNull(), "warehouse").when(F.col("dt").isNotNull(), "declared")
    return j.select("scope", "node", F.coalesce("d", "w").alias("column"), F.coalesce("wt", "dt").alias("type"), origin.alias("type_source"), (F.col("d").isNull() & F.col("given").isNull()).alias("possibly_stale"), "tests", "constraints", "upstream")
