"""What a project's manifest says: facts about keys, code fingerprints, coverage, opaque nodes, freshness.

All operators are keyed by scope. What can't be told is a diagnostic or null, never a guess.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.state import fingerprint
from fleetlens.plans.fixpoint import fixpoint, layers, near
from fleetlens.plans.reach import reach_counts
from fleetlens.plans.shared import cut

ID = ["scope", "node"]

# How a check's statuses over several nodes rank, and how exact a version is.
CHECK_RANK = {"passed": 0, "warned": 1, "unknown": 2, "skipped": 3, "failed": 4}
EXACTNESS = ["none", "inferred", "proxy", "semantic", "exact"]
# Configuration that doesn't change what a node builds.
IGNORED_CONFIG = ["docs", "freshness", "meta", "state", "tags"]
# Where a configuration has hooks, and the names by which they read what is known only at run time.
HOOKS = ["pre-hook", "post-hook", "pre_hook", "post_hook"]
RUNTIME = ["var", "env_var", "builtins", "context", "target", "flags", "run_query", "statement"]
AT_RUN_TIME = rf"(?<![\p{{L}}\p{{N}}_])({'|'.join(RUNTIME)})(?![\p{{L}}\p{{N}}_])"
#: The version of how code is read; digests of two versions never agree.
SCHEME = "code/2"
#: Macros of the engine itself; its version is a component of its own.
ENGINE_MACRO = r"^macro\.dbt(_[a-z0-9]+)?\."

FACT = ["scope", "entity", "fact", "columns", "to", "to_columns", "basis", "evidence"]


def _facts(rows: DataFrame, fact: str, columns: Column, basis: str, to: Column | None = None, to_columns: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    of = {"fact": F.lit(fact), "columns": columns, "to": none if to is None else to, "to_columns": none.cast("string") if to_columns is None else to_columns, "basis": F.lit(basis)}
    return rows.select("scope", "entity", "evidence", *[c.alias(n) for n, c in of.items()]).select(*FACT)


def join_facts(joins: DataFrame, entities: DataFrame) -> DataFrame:
    """Join keys seen in SQL, ``joins(scope, entity, column, to, to_column, evidence)``, as facts; both sides are known entities."""
    known = entities.select("scope", "entity").distinct()
    both = joins.join(known, ["scope", "entity"], "left_semi").join(known.withColumnRenamed("entity", "to"), ["scope", "to"], "left_semi")
    return _facts(both, "join", F.col("column"), "joined", F.col("to"), F.col("to_column")).distinct()


def test_facts(tests: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What data tests assert about keys, and what they can't be used for.

    ``tests(scope, test, package, name, attached, column, where, field, columns, depends_on ARRAY)``;
    ``columns`` is joined by commas. A test belongs to the entity it is attached to, else to the
    only known one that it depends on. Tests of a part of the rows (``where``) say nothing about a key.
    Returns facts, and diagnostics ``(scope, evidence, reason)``.
    """
    known = entities.select("scope", F.col("entity").alias("id")).distinct()
    deps = tests.select("scope", "test", F.explode("depends_on").alias("id")).join(known, ["scope", "id"], "left_semi").distinct()
    deps = deps.groupBy("scope", "test").agg(F.collect_set("id").alias("known"))
    sure = known.select("scope", F.col("id").alias("attached"), F.lit(True).alias("is_known"))
    t = tests.join(deps, ["scope", "test"], "left").join(sure, ["scope", "attached"], "left")
    one = lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0)))
    t = t.withColumn("entity", F.when(F.col("is_known"), F.col("attached")).otherwise(one(F.col("known")))).withColumn("evidence", F.col("test"))
    plain = F.col("package").isNull()
    key_test = plain & F.col("name").isin("unique", "not_null", "relationships")
    combined = (F.col("package") == "dbt_utils") & (F.col("name") == "unique_combination_of_columns")
    lost = t.where(F.col("entity").isNull() & key_test).select("scope", "evidence", F.lit("no entity").alias("reason"))
    t = t.where("entity is not null")
    partial = F.col("where").isNotNull() & (F.trim("where") != "")
    part = t.where(partial & (key_test | combined)).select("scope", "evidence", F.lit("only some rows").alias("reason"))
    t = t.where(~partial)
    refers = one(F.filter("known", lambda x: x != F.col("entity")))
    rel = t.where(key_test & (F.col("name") == "relationships") & F.col("column").isNotNull()).withColumn("to", refers)
    whole = F.col("to").isNotNull() & F.col("field").isNotNull()
    facts = [
        _facts(t.where(key_test & (F.col("name") == "unique") & F.col("column").isNotNull()), "unique", F.col("column"), "tested"),
        _facts(t.where(key_test & (F.col("name") == "not_null") & F.col("column").isNotNull()), "not_null", F.col("column"), "tested"),
        _facts(rel.where(whole), "foreign_key", F.col("column"), "tested", F.col("to"), F.col("field")),
        _facts(t.where(combined & (F.coalesce("columns", F.lit("")) != "")), "unique", F.col("columns"), "tested"),
    ]
    unclear = rel.where(~whole).select("scope", "evidence", F.lit("no target").alias("reason"))
    return reduce(DataFrame.unionByName, facts), lost.unionByName(part).unionByName(unclear)


def constraint_facts(constraints: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declared constraints, ``(scope, entity, kind, columns, to, to_columns, evidence)``, as facts.

    A foreign key whose target isn't a known entity is a diagnostic.
    """
    c = constraints.where(F.coalesce("columns", F.lit("")) != "")
    known = entities.select("scope", F.col("entity").alias("to")).distinct()
    fk = c.where("kind = 'foreign_key'")
    each = c.where("kind = 'not_null'").withColumn("column", F.explode(F.split("columns", ",")))
    facts = [
        _facts(c.where("kind = 'primary_key'"), "primary_key", F.col("columns"), "declared"),
        _facts(c.where("kind = 'unique'"), "unique", F.col("columns"), "declared"),
        _facts(each, "not_null", F.col("column"), "declared"),
        _facts(fk.join(known, ["scope", "to"], "left_semi"), "foreign_key", F.col("columns"), "declared", F.col("to"), F.col("to_columns")),
    ]
    unclear = fk.join(known, ["scope", "to"], "left_anti").select("scope", "evidence", F.lit("no target").alias("reason"))
    return reduce(DataFrame.unionByName, facts), unclear


def check_coverage(tests: DataFrame) -> DataFrame:
    """Each check with the nodes that it covers: ``tests(scope, check, depends_on ARRAY)``."""
    return tests.select("scope", "check", F.explode("depends_on").alias("node")).distinct()


def checks_from_report(report: DataFrame) -> DataFrame:
    """One row a check of a run: its nodes, and failed before skipped, unknown, warned and passed.

    ``report(scope, run_id, check, node, status)``; a null node is a check whose nodes aren't known.
    """
    rank = F.create_map(*[F.lit(x) for pair in CHECK_RANK.items() for x in pair])
    worst = F.max_by("status", rank[F.col("status")])
    return report.groupBy("scope", "run_id", "check").agg(worst.alias("status"), F.array_join(F.array_sort(F.collect_set("node")), ",").alias("nodes"))


def narrow(entries: DataFrame, types: list[str], excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``entries(scope, node, kind)`` those that a command builds, and those left out with the reason."""
    out = excluded.select(*ID).distinct().withColumn("out", F.lit(True))
    why = F.when(F.col("out"), "excluded").when(~F.col("kind").isin(types) if types else F.lit(False), "other type")
    e = entries.join(out, ID, "left").withColumn("reason", why)
    return e.where("reason is null").select(*entries.columns), e.where("reason is not null").select(*ID, "reason")


def requirements(nodes: DataFrame, rules: list[str]) -> DataFrame:
    """What each node lacks of ``description``, ``tests``, ``test:<type>``, ``constraints`` and ``tag:<tag>``.

    ``nodes(scope, node, described, tests, test_types ARRAY, constraints, tags ARRAY)``.
    """

    def met(rule: str) -> Column:
        kind, _, value = rule.partition(":")
        if kind in ("test", "tag") and value:
            return F.array_contains("test_types" if kind == "test" else "tags", value)
        fixed = {"description": F.col("described"), "tests": F.col("tests") > 0, "constraints": F.col("constraints") > 0}
        if rule not in fixed:
            raise ValueError(f"no such requirement: {rule}")
        return fixed[rule]

    lacking = F.array(*[F.when(~F.coalesce(met(r), F.lit(False)), F.lit(r)) for r in rules])
    return nodes.select(*ID, F.array_join(F.filter(lacking, lambda x: x.isNotNull()), ",").alias("lacking"))


def normalize_identifiers(edges: DataFrame, case: str = "lower") -> DataFrame:
    """Observed edges with their names in one case; those that become equal are one."""
    fold = {"lower": F.lower, "upper": F.upper}[case]
    names = [c for c in edges.columns if c != "scope"]
    return edges.select(*[c if c not in names else fold(F.col(c)).alias(c) for c in edges.columns]).distinct()


def node_opaque(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of which nothing tells how they use their inputs.

    ``nodes(scope, node, kind, lineage)``, where ``lineage`` is ``analysed``, ``unanalysed`` or null
    (none). Without lineage, a model is opaque, and so is any node that has upstreams.
    """
    reads = edges.select("scope", F.col("child").alias("node")).distinct().withColumn("reads", F.lit(True))
    opaque = F.when(F.col("lineage").isNotNull(), F.col("lineage") == "unanalysed").otherwise((F.col("kind") == "model") | F.coalesce("reads", F.lit(False)))
    return nodes.join(reads, ID, "left").select(*ID, opaque.alias("opaque"))


def allows_reuse(unknown: Column, blocking: Column, exactness: Column) -> Column:
    """No unknown setting, no unapplied one that blocks reuse (array of flags), a version of semantic or exact grade."""
    grade = F.array_position(F.array(*map(F.lit, EXACTNESS)), exactness)
    return (F.size(unknown) == 0) & ~F.exists(blocking, lambda x: x) & (grade > EXACTNESS.index("semantic"))


def macros_reached(uses: DataFrame, calls: DataFrame) -> DataFrame:
    """Every macro that a node uses, through the calls between macros: ``scope, node, macro``."""
    step = lambda f: f.join(calls.select("scope", "macro", F.col("calls").alias("next")), ["scope", "macro"]).select(*ID, F.col("next").alias("macro"))
    return fixpoint(uses.select(*ID, "macro"), step, [*ID, "macro"])


def macro_lines(uses: DataFrame, calls: DataFrame, macros: DataFrame) -> DataFrame:
    """Of each node that uses macros: ``content``, a line for each macro it reaches, ``lacks``, those without SQL, and
    ``reads``, whether one that isn't the engine's reads what is known only at run time.

    Calls are closed once for each distinct macro, not for each node and macro; nodes then join their
    direct macros' closures.
    """
    used = uses.select("scope", F.col("macro").alias("root")).distinct().withColumn("macro", F.col("root"))
    step = lambda f: f.join(calls.select("scope", "macro", F.col("calls").alias("next")), ["scope", "macro"]).select("scope", "root", F.col("next").alias("macro"))
    closed = fixpoint(used, step, ["scope", "root", "macro"]).join(macros.select("scope", "macro", "sql").dropDuplicates(["scope", "macro"]), ["scope", "macro"], "left")
    reads = F.col("sql").rlike(AT_RUN_TIME) & ~F.col("macro").rlike(ENGINE_MACRO)
    closed = closed.select("scope", "root", "macro", F.sha2("sql", 256).alias("digest"), F.coalesce(reads, F.lit(False)).alias("reads"))
    closed = cut(closed)
    # the closures of the macros go to the nodes, if they are few, and not the nodes to the closures
    reached = uses.select(*ID, F.col("macro").alias("root")).distinct().join(near(closed, closed.count()), ["scope", "root"]).select(*ID, "macro", "digest", "reads").distinct()
    return reached.groupBy(*ID).agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("macro", F.lit(" "), "digest"))), "\n").alias("content"),
        F.nullif(F.array_join(F.array_sort(F.collect_list(F.when(F.col("digest").isNull(), F.col("macro")))), ", "), F.lit("")).alias("lacks"),
        F.bool_or("reads").alias("reads"),
    )


def code_components(nodes: DataFrame, uses: DataFrame, calls: DataFrame, macros: DataFrame, meaning: Column) -> tuple[DataFrame, DataFrame]:
    """The parts of a node's code that decide what it builds, and the nodes that can't be fingerprinted.

    ``nodes(scope, node, resource_type, language, compiled, checksum, pure, config MAP, contract,
    relation, engine)``; ``meaning`` is the normalised SQL of column ``compiled``. A SQL model or snapshot
    has ``sql``, and its ``file`` unless its template is ``pure``; other nodes have their ``file``, and a
    Python model its ``compiled_code`` as well. Configuration that doesn't change a build is left out. ``scheme``
    is the version of this reading of code, so that digests of two versions never agree. A node whose
    artifacts lack a macro that it reaches, or its hooks, is refused: what isn't known isn't hashed.
    Returns ``(scope, node, component, content)`` and ``(scope, node, reason)``.
    """
    code = F.col("resource_type").isin("model", "snapshot")
    sql = code & ~F.coalesce(F.col("language") == "python", F.lit(False))
    given = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    needs_file = ~sql | ~F.coalesce(F.col("pure"), F.lit(False))
    hooked = F.exists(F.array(*map(F.lit, HOOKS)), lambda h: ~F.coalesce(F.trim(F.element_at("config", h)), F.lit("")).isin("", "[]", "null"))
    hooks = F.exists(F.array(*map(F.lit, HOOKS)), lambda h: F.coalesce(F.element_at("config", h), F.lit("")).rlike(AT_RUN_TIME))
    reason = (
        F.when(F.col("config").isNull(), "no config").when(hooks, "hooks read what is known at run time").when(code & ~given("compiled"), "no compiled code").when(needs_file & ~given("checksum"), "no checksum")
    )
    n = nodes.withColumn("reason", reason).withColumn("hooked", hooked)
    refused = n.where("reason is not null").select(*ID, "reason")
    kept = F.map_filter("config", lambda k, v: ~k.isin(IGNORED_CONFIG))
    # a value that is JSON is written with its keys in order at every level, as variants keep them
    plain = lambda v: F.coalesce(F.to_json(F.try_parse_json(v)), v, F.lit("null"))
    config = F.array_join(F.transform(F.array_sort(F.map_keys(kept)), lambda k: F.concat(k, F.lit("="), plain(F.element_at(kept, k)))), "\n")
    part = lambda name, content, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(name).alias("component"), F.coalesce(content, F.lit("")).alias("content")))
    parts = F.array(
        part("scheme", F.lit(SCHEME)), part("config", config), part("contract", F.col("contract")), part("relation", F.col("relation")), part("engine", F.col("engine")),
        part("sql", meaning, sql), part("file", F.col("checksum"), needs_file), part("compiled_code", F.col("compiled"), code & ~sql),
    )
    fine = n.where("reason is null")
    own = fine.select(*ID, F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p")).select(*ID, "p.component", "p.content")
    lines = cut(macro_lines(uses, calls, macros))
    called = fine.select(*ID, "hooked").join(lines, ID, "left")
    why = F.when(F.col("hooked") & F.col("reads"), "hooks' macros read what is known at run time").otherwise(F.concat(F.lit("macros that the artifacts don't include: "), "lacks"))
    called = called.withColumn("why", why)
    lacking = called.where("why is not null").select(*ID, F.col("why").alias("reason"))
    called = called.where("why is null").select(*ID, F.lit("macros").alias("component"), F.coalesce("content", F.lit("")).alias("content"))
    return own.join(lacking, ID, "left_anti").unionByName(called), refused.unionByName(lacking)


def code_fingerprint(nodes: DataFrame, uses: DataFrame, calls: DataFrame, macros: DataFrame, meaning: Column) -> DataFrame:
    """Each node's digest, or why it has none."""
    components, refused = code_components(nodes, uses, calls, macros, meaning)
    return fingerprint(components).withColumn("reason", F.lit(None).cast("string")).unionByName(refused.select(*ID, F.lit(None).cast("string").alias("digest"), "reason"))


def checks_digest(tests: DataFrame, engine: str) -> DataFrame:
    """A digest of each node's set of checks: ``tests(scope, check, depends_on ARRAY, content)``; nodes without checks have none."""
    covered = tests.select("scope", F.explode("depends_on").alias("node"), F.col("check").alias("component"), "content").distinct()
    base = covered.select(*ID).distinct().select(*ID, F.lit("engine").alias("component"), F.lit(engine).alias("content"))
    return fingerprint(covered.select(*ID, F.concat(F.lit("check "), "component").alias("component"), "content").unionByName(base))


def project_summary(opaque: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges and opaque nodes of each scope: ``opaque(scope, node, opaque)``."""
    n = opaque.groupBy("scope").agg(F.count(F.lit(1)).alias("nodes"), F.count_if("opaque").alias("opaque"))
    return n.join(edges.groupBy("scope").agg(F.count(F.lit(1)).alias("edges")), "scope", "left").fillna(0, ["edges"])


def list_opaque(opaque: DataFrame, edges: DataFrame) -> DataFrame:
    """The opaque nodes, and how many readers each forces to be treated as using everything."""
    readers = edges.select("scope", F.col("parent").alias("node"), "child").distinct().groupBy(*ID).agg(F.count(F.lit(1)).alias("readers"))
    return opaque.where("opaque").select(*ID).join(readers, ID, "left").fillna(0, ["readers"])


def build_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A lineage build: ``nodes(scope, node, analysed, cached, opaque)``; dependencies on unknown nodes are missing."""
    missing = edges.join(nodes.select("scope", F.col("node").alias("parent")), ["scope", "parent"], "left_anti").select("scope", "parent").distinct().groupBy("scope").agg(F.count(F.lit(1)).alias("missing"))
    waves = layers(nodes, edges).groupBy("scope").agg((F.max("depth") + 1).cast("long").alias("waves"))
    s = nodes.groupBy("scope").agg(F.count_if("analysed").alias("analysed"), F.count_if("cached").alias("cached"), F.count_if("opaque").alias("opaque"))
    return s.join(waves, "scope", "left").join(missing, "scope", "left").fillna(0, ["waves", "missing"])


def freshness_view(sources: DataFrame, edges: DataFrame, planned: DataFrame) -> DataFrame:
    """Each source or seed: version, whether its grade allows reuse, its readers by decision, all that is downstream.

    ``sources(scope, source, version, exactness)``, ``planned(scope, node, action)``. Readers are direct; what is
    downstream is counted by bitmaps (``plans.reach``), not as pairs.
    """
    e = edges.select("scope", F.col("parent").alias("node"), F.col("child").alias("next")).distinct()
    below = reach_counts(edges).select("scope", F.col("node").alias("source"), F.col("n").alias("downstream"))
    direct = sources.select("scope", "source").join(e.withColumnRenamed("node", "source"), ["scope", "source"]).join(planned.select("scope", F.col("node").alias("next"), "action"), ["scope", "next"], "left")
    readers = direct.groupBy("scope", "source").agg(F.count(F.lit(1)).alias("readers"), F.count_if(F.col("action") == "BUILD").alias("readers_built"), F.count_if(F.col("action").isNull()).alias("readers_undecided"))
    grade = F.coalesce(F.array_position(F.array(*map(F.lit, EXACTNESS)), F.col("exactness")) > EXACTNESS.index("semantic"), F.lit(False))
    out = sources.withColumn("allows_reuse", grade & F.col("version").isNotNull()).join(readers, ["scope", "source"], "left").join(below, ["scope", "source"], "left")
    return out.fillna(0, ["readers", "readers_built", "readers_undecided", "downstream"])


def plan_from_states(run_nodes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """A past run's plan from the states around it.

    ``run_nodes(scope, run_id, node)``; ``before`` and ``after`` hold ``(scope, run_id, node, component, digest)``:
    the components of the state before the run and of the one that the run itself recorded. A node of both whose
    components differ was built because its code changed; of the others nothing tells the reason.
    """
    keys = ["scope", "run_id", "node"]
    both = before.select(*keys).distinct().join(after.select(*keys).distinct(), keys)
    b, a = before.select(*keys, "component", F.col("digest").alias("was")), after.select(*keys, "component", F.col("digest").alias("now"))
    diff = b.join(a, [*keys, "component"], "full").join(both, keys, "left_semi").where(~F.col("was").eqNullSafe(F.col("now")))
    changed = diff.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("component")), ",").alias("changed"))
    return run_nodes.select(*keys).distinct().join(changed, keys, "left").select(*keys, F.lit("BUILD").alias("action"), F.when(F.col("changed").isNotNull(), "code_changed").alias("reason"), "changed")
