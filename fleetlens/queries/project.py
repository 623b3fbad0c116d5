"""Manifest facts, fingerprints, coverage, opaque nodes, freshness and registrations over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.bindings import bind, oracle
from fleetlens.operators import project as P
from fleetlens.operators.registry import Registry
from fleetlens.sources.artifacts import observed_lineage

QUERIES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def view(spark, sf, sql: str, *names: str):
    """A SELECT over tables and bindings, which Spark and DuckDB both run."""
    for n in names or ("node_facts",):
        bind(spark, sf, n).createOrReplaceTempView(n)
    return spark.sql(sql)


def listed(df, *columns: str):
    """Comma-joined columns as arrays; the empty string is the empty array."""
    return df.withColumns({c: F.filter(F.split(c, ","), lambda x: x != "") for c in columns})


SCOPE = "'r' || CAST(p_partkey % 5 AS STRING)"
ENT = f"SELECT {SCOPE} AS scope, 'e' || CAST(p_partkey AS STRING) AS entity FROM part WHERE p_size <> 7"
# every order line is a join seen in some SQL: its part's entity with its supplier's part number
JOINS = "SELECT 'r' || CAST(l_partkey % 5 AS STRING) AS scope, 'e' || CAST(l_partkey AS STRING) AS entity, 'k' || CAST(l_linenumber AS STRING) AS \"column\", 'e' || CAST(l_suppkey * 5 + l_partkey % 5 AS STRING) AS \"to\", 'id' AS to_column, 'sql' AS evidence FROM lineitem"


def spark_sql(text: str) -> str:
    return text.replace('"column"', "`column`").replace('"to"', "`to`").replace('"where"', "`where`").replace('"check"', "`check`")


@query("j18_join_facts", f"SELECT DISTINCT scope, entity, 'join' AS fact, \"column\" AS columns, \"to\", to_column AS to_columns, 'joined' AS basis, evidence FROM ({JOINS}) WHERE (scope, entity) IN (SELECT (scope, entity) FROM ({ENT})) AND (scope, \"to\") IN (SELECT (scope, entity) FROM ({ENT}))")
def j18(spark, sf):
    return P.join_facts(view(spark, sf, spark_sql(JOINS)), view(spark, sf, ENT))


TESTS = f"""SELECT {SCOPE} AS scope, 't' || CAST(p_partkey AS STRING) AS test, CASE WHEN p_partkey % 7 = 3 THEN 'dbt_utils' END AS package,
 CASE WHEN p_partkey % 7 = 3 THEN 'unique_combination_of_columns' WHEN p_partkey % 7 < 3 THEN 'unique' WHEN p_partkey % 7 = 4 THEN 'not_null' WHEN p_partkey % 7 = 5 THEN 'relationships' ELSE 'expression' END AS name,
 CASE WHEN p_partkey % 3 <> 0 THEN 'e' || CAST(p_partkey AS STRING) END AS attached, CASE WHEN p_partkey % 11 <> 0 THEN 'c1' END AS "column", CASE WHEN p_size = 9 THEN 'x > 1' WHEN p_size = 10 THEN ' ' END AS "where",
 CASE WHEN p_partkey % 13 <> 0 THEN 'id' END AS field, CASE WHEN p_partkey % 2 = 0 THEN 'a,b' ELSE '' END AS columns, 'e' || CAST(p_partkey AS STRING) AS d1, CASE WHEN p_partkey % 4 < 2 THEN 'e' || CAST(p_partkey + 5 AS STRING) END AS d2 FROM part"""
TE = f"""(SELECT t.*, k1.entity IS NOT NULL AS k1, k2.entity IS NOT NULL AS k2 FROM ({TESTS}) t LEFT JOIN ({ENT}) k1 ON k1.scope = t.scope AND k1.entity = d1 LEFT JOIN ({ENT}) k2 ON k2.scope = t.scope AND k2.entity = d2)"""
TD = f"""(SELECT *, CASE WHEN attached IS NOT NULL AND k1 THEN attached WHEN k1 AND NOT k2 THEN d1 WHEN k2 AND NOT k1 THEN d2 END AS entity, trim(coalesce("where", '')) <> '' AS partial, package IS NULL AND name IN ('unique', 'not_null', 'relationships') AS kt, package IS NOT NULL AS cb FROM {TE})"""
TO = f"""(SELECT *, CASE WHEN entity = d1 AND k2 THEN d2 WHEN entity = d2 AND k1 THEN d1 END AS target FROM {TD})"""


def tests(spark, sf):
    return view(spark, sf, spark_sql(TESTS)).withColumn("depends_on", F.filter(F.array("d1", "d2"), lambda x: x.isNotNull()))


@query("j19_test_facts", f"""SELECT scope, entity, 'unique' AS fact, "column" AS columns, CAST(NULL AS VARCHAR) AS "to", CAST(NULL AS VARCHAR) AS to_columns, 'tested' AS basis, test AS evidence FROM {TO} WHERE entity IS NOT NULL AND NOT partial AND kt AND name = 'unique' AND "column" IS NOT NULL
 UNION ALL SELECT scope, entity, 'not_null', "column", NULL, NULL, 'tested', test FROM {TO} WHERE entity IS NOT NULL AND NOT partial AND kt AND name = 'not_null' AND "column" IS NOT NULL
 UNION ALL SELECT scope, entity, 'foreign_key', "column", target, field, 'tested', test FROM {TO} WHERE entity IS NOT NULL AND NOT partial AND kt AND name = 'relationships' AND "column" IS NOT NULL AND target IS NOT NULL AND field IS NOT NULL
 UNION ALL SELECT scope, entity, 'unique', columns, NULL, NULL, 'tested', test FROM {TO} WHERE entity IS NOT NULL AND NOT partial AND cb AND columns <> ''""")
def j19(spark, sf):
    return P.test_facts(tests(spark, sf), view(spark, sf, ENT))[0]


@query("j19_test_diagnostics", f"""SELECT scope, test AS evidence, CASE WHEN entity IS NULL THEN 'no entity' WHEN partial THEN 'only some rows' ELSE 'no target' END AS reason FROM {TO}
 WHERE (entity IS NULL AND kt) OR (entity IS NOT NULL AND partial AND (kt OR cb)) OR (entity IS NOT NULL AND NOT partial AND kt AND name = 'relationships' AND "column" IS NOT NULL AND (target IS NULL OR field IS NULL))""")
def j19d(spark, sf):
    return P.test_facts(tests(spark, sf), view(spark, sf, ENT))[1]


CONS = f"SELECT {SCOPE} AS scope, 'e' || CAST(p_partkey AS STRING) AS entity, CASE p_size % 5 WHEN 0 THEN 'primary_key' WHEN 1 THEN 'unique' WHEN 2 THEN 'not_null' WHEN 3 THEN 'foreign_key' ELSE 'check' END AS kind, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' ELSE 'a,b' END AS columns, 'e' || CAST(p_partkey + 5 AS STRING) AS \"to\", 'id' AS to_columns, p_brand AS evidence FROM part"


@query("j19_constraint_facts", f"""WITH c AS (SELECT * FROM ({CONS}) WHERE columns <> '') SELECT scope, entity, kind AS fact, columns, CAST(NULL AS VARCHAR) AS "to", CAST(NULL AS VARCHAR) AS to_columns, 'declared' AS basis, evidence FROM c WHERE kind IN ('primary_key', 'unique')
 UNION ALL SELECT scope, entity, kind, unnest(string_split(columns, ',')), NULL, NULL, 'declared', evidence FROM c WHERE kind = 'not_null'
 UNION ALL SELECT scope, entity, kind, columns, "to", to_columns, 'declared', evidence FROM c WHERE kind = 'foreign_key' AND (scope, "to") IN (SELECT (scope, entity) FROM ({ENT}))""")
def j19c(spark, sf):
    return P.constraint_facts(view(spark, sf, spark_sql(CONS)), view(spark, sf, ENT))[0]


@query("j20_check_coverage", f"SELECT scope, test AS \"check\", d1 AS node FROM ({TESTS}) UNION SELECT scope, test, d2 FROM ({TESTS}) WHERE d2 IS NOT NULL")
def j20(spark, sf):
    return P.check_coverage(tests(spark, sf).withColumnRenamed("test", "check"))


REPORT = "SELECT 'r' || CAST(user_id % 5 AS STRING) AS scope, 'run-' || CAST(user_id AS STRING) AS run_id, 'c' || CAST(event_id % 11 AS STRING) AS \"check\", CASE WHEN event_id % 19 <> 0 THEN 'n' || CAST(event_id % 17 AS STRING) END AS node, CASE event_type WHEN 'signup' THEN 'passed' WHEN 'view' THEN 'warned' WHEN 'purchase' THEN 'failed' WHEN 'click' THEN 'skipped' ELSE 'unknown' END AS status FROM events"


@query("a18_checks_from_report", f"SELECT scope, run_id, \"check\", arg_max(status, CASE status WHEN 'failed' THEN 4 WHEN 'skipped' THEN 3 WHEN 'unknown' THEN 2 WHEN 'warned' THEN 1 ELSE 0 END) AS status, coalesce(string_agg(DISTINCT node, ',' ORDER BY node), '') AS nodes FROM ({REPORT}) GROUP BY ALL")
def a18(spark, sf):
    return P.checks_from_report(view(spark, sf, spark_sql(REPORT)))


ENTRIES = f"SELECT {SCOPE} AS scope, 'n' || CAST(p_partkey AS STRING) AS node, CASE p_size % 4 WHEN 0 THEN 'model' WHEN 1 THEN 'seed' WHEN 2 THEN 'snapshot' ELSE 'source' END AS kind FROM part"
EXCL = "SELECT 'r' || CAST(l_partkey % 5 AS STRING) AS scope, 'n' || CAST(l_partkey AS STRING) AS node FROM lineitem WHERE l_quantity > 49"


@query("p7_narrow", f"SELECT * FROM ({ENTRIES}) WHERE kind IN ('model', 'seed') AND (scope, node) NOT IN (SELECT (scope, node) FROM ({EXCL}))")
def p7(spark, sf):
    return P.narrow(view(spark, sf, ENTRIES), ["model", "seed"], view(spark, sf, EXCL))[0]


@query("p7_left_out", f"SELECT scope, node, CASE WHEN (scope, node) IN (SELECT (scope, node) FROM ({EXCL})) THEN 'excluded' ELSE 'other type' END AS reason FROM ({ENTRIES}) WHERE kind NOT IN ('model', 'seed') OR (scope, node) IN (SELECT (scope, node) FROM ({EXCL}))")
def p7l(spark, sf):
    return P.narrow(view(spark, sf, ENTRIES), ["model", "seed"], view(spark, sf, EXCL))[1]


FACTS = f"SELECT {SCOPE} AS scope, 'n' || CAST(p_partkey AS STRING) AS node, p_partkey % 3 <> 0 AS described, p_partkey % 4 AS tests, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 8 < 4 THEN 'unique' ELSE 'unique,not_null' END AS test_types, p_size % 2 AS constraints, lower(p_brand) AS tags FROM part"


@query("p8_requirements", f"SELECT scope, node, array_to_string(list_filter([CASE WHEN NOT described THEN 'description' END, CASE WHEN tests = 0 THEN 'tests' END, CASE WHEN NOT list_contains(string_split(test_types, ','), 'not_null') THEN 'test:not_null' END, CASE WHEN constraints = 0 THEN 'constraints' END, CASE WHEN tags <> 'brand#12' THEN 'tag:brand#12' END], lambda x: x IS NOT NULL), ',') AS lacking FROM ({FACTS})")
def p8(spark, sf):
    return P.requirements(listed(view(spark, sf, FACTS), "test_types", "tags"), ["description", "tests", "test:not_null", "constraints", "tag:brand#12"])


OBS = "SELECT 'r' || CAST(l_suppkey % 5 AS STRING) AS scope, CASE WHEN l_linenumber % 2 = 0 THEN 'SRC' || CAST(l_partkey AS STRING) ELSE 'src' || CAST(l_partkey AS STRING) END AS source_relation, CASE WHEN l_returnflag = 'A' THEN 'Amount' ELSE 'amount' END AS source_column, 'T' || CAST(l_suppkey AS STRING) AS target_relation, l_returnflag AS target_column FROM lineitem"


@query("p9_normalize_identifiers", f"SELECT DISTINCT scope, lower(source_relation) AS source_relation, lower(source_column) AS source_column, lower(target_relation) AS target_relation, lower(target_column) AS target_column FROM ({OBS})")
def p9(spark, sf):
    return P.normalize_identifiers(view(spark, sf, OBS))


KINDS = "SELECT scope, node, CASE node % 4 WHEN 0 THEN 'seed' WHEN 1 THEN 'snapshot' ELSE 'model' END AS kind, CASE WHEN node % 5 < 3 THEN 'analysed' WHEN node % 5 = 3 THEN 'unanalysed' END AS lineage, node % 3 = 0 AS cached FROM dag_nodes"
OPAQUE = f"(SELECT scope, node, CASE WHEN lineage IS NOT NULL THEN lineage = 'unanalysed' ELSE kind = 'model' OR (scope, node) IN (SELECT (scope, child) FROM dag_edges) END AS opaque FROM ({KINDS}))"


def opaque(spark, sf):
    return P.node_opaque(view(spark, sf, KINDS, "dag_nodes"), bind(spark, sf, "dag_edges"))


@query("p11_node_opaque", oracle(f"SELECT * FROM {OPAQUE}", "dag_nodes", "dag_edges"))
def p11(spark, sf):
    return opaque(spark, sf)


POLICY = f"SELECT {SCOPE} AS scope, 'n' || CAST(p_partkey AS STRING) AS node, CASE WHEN p_partkey % 6 = 0 THEN 'x' ELSE '' END AS unknown, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '0,1' ELSE '0,0' END AS blocking, CASE p_size % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'inferred' WHEN 2 THEN 'proxy' WHEN 3 THEN 'semantic' ELSE 'exact' END AS exactness FROM part"


@query("p12_allows_reuse", f"SELECT scope, node, unknown = '' AND blocking NOT LIKE '%1%' AND exactness IN ('semantic', 'exact') AS allows_reuse FROM ({POLICY})")
def p12(spark, sf):
    p = listed(view(spark, sf, POLICY), "unknown", "blocking")
    return p.select("scope", "node", P.allows_reuse(F.col("unknown"), F.transform("blocking", lambda x: x == "1"), F.col("exactness")).alias("allows_reuse"))


@query("a23_project_summary", oracle(f"SELECT scope, nodes, opaque, coalesce(edges, 0) AS edges FROM (SELECT scope, count(*) AS nodes, count(*) FILTER (opaque) AS opaque FROM {OPAQUE} GROUP BY scope) LEFT JOIN (SELECT scope, count(*) AS edges FROM dag_edges GROUP BY scope) USING (scope)", "dag_nodes", "dag_edges"))
def a23(spark, sf):
    return P.project_summary(opaque(spark, sf), bind(spark, sf, "dag_edges"))


@query("a23_list_opaque", oracle(f"SELECT scope, node, (SELECT count(DISTINCT child) FROM dag_edges e WHERE e.scope = o.scope AND e.parent = o.node) AS readers FROM {OPAQUE} o WHERE opaque", "dag_nodes", "dag_edges"))
def a23l(spark, sf):
    return P.list_opaque(opaque(spark, sf), bind(spark, sf, "dag_edges"))


@query("a24_build_stats", oracle(f", r AS (SELECT scope, node, 1 AS depth FROM dag_nodes WHERE (scope, node) NOT IN (SELECT (e.scope, e.child) FROM dag_edges e JOIN dag_nodes n ON n.scope = e.scope AND n.node = e.parent) UNION SELECT e.scope, e.child, r.depth + 1 FROM r JOIN dag_edges e ON e.scope = r.scope AND e.parent = r.node JOIN dag_nodes n ON n.scope = e.scope AND n.node = e.child) SELECT s.*, waves, coalesce(missing, 0) AS missing FROM (SELECT scope, count(*) FILTER (lineage IS NOT NULL) AS analysed, count(*) FILTER (cached) AS cached, count(*) FILTER (opaque) AS opaque FROM ({KINDS}) JOIN {OPAQUE} USING (scope, node) GROUP BY scope) s LEFT JOIN (SELECT scope, CAST(max(depth) AS BIGINT) AS waves FROM r GROUP BY scope) USING (scope) LEFT JOIN (SELECT scope, count(DISTINCT parent) AS missing FROM dag_edges WHERE (scope, parent) NOT IN (SELECT (scope, node) FROM dag_nodes) GROUP BY scope) USING (scope)", "dag_nodes", "dag_edges"))
def a24(spark, sf):
    n = view(spark, sf, KINDS, "dag_nodes").withColumn("analysed", F.col("lineage").isNotNull()).join(opaque(spark, sf), ["scope", "node"])
    return P.build_stats(n, bind(spark, sf, "dag_edges"))


# the sources are what edges read and no edge builds; versions come with the node number
SOURCES = "SELECT DISTINCT scope, parent AS source, CASE WHEN parent % 3 <> 2 THEN 'v' || CAST(parent AS STRING) END AS version, CASE WHEN parent % 2 = 0 THEN 'exact' ELSE 'proxy' END AS exactness FROM dag_edges"
PLANNED = "SELECT scope, node, CASE WHEN node % 3 = 0 THEN 'BUILD' ELSE 'REUSE' END AS action FROM dag_nodes WHERE node % 7 <> 0"


@query("a27_freshness_view", oracle(f", c AS (SELECT scope, source, source AS node FROM ({SOURCES}) UNION SELECT c.scope, c.source, e.child FROM c JOIN dag_edges e ON e.scope = c.scope AND e.parent = c.node) SELECT s.scope, s.source, s.version, s.exactness, s.exactness = 'exact' AND s.version IS NOT NULL AS allows_reuse, coalesce(readers, 0) AS readers, coalesce(readers_built, 0) AS readers_built, coalesce(readers_undecided, 0) AS readers_undecided, coalesce(downstream, 0) AS downstream FROM ({SOURCES}) s LEFT JOIN (SELECT scope, source, count(*) AS downstream FROM c WHERE node <> source GROUP BY ALL) d USING (scope, source) LEFT JOIN (SELECT e.scope, parent AS source, count(*) AS readers, count(*) FILTER (action = 'BUILD') AS readers_built, count(*) FILTER (action IS NULL) AS readers_undecided FROM dag_edges e LEFT JOIN ({PLANNED}) p ON p.scope = e.scope AND p.node = e.child GROUP BY ALL) r USING (scope, source)", "dag_nodes", "dag_edges"))
def a27(spark, sf):
    return P.freshness_view(view(spark, sf, SOURCES, "dag_edges"), bind(spark, sf, "dag_edges"), view(spark, sf, PLANNED, "dag_nodes"))


CODE = f"""SELECT {SCOPE} AS scope, p_partkey AS node, CASE p_size % 4 WHEN 0 THEN 'model' WHEN 1 THEN 'seed' WHEN 2 THEN 'snapshot' ELSE 'model' END AS resource_type, CASE WHEN p_size % 4 = 3 THEN 'python' ELSE 'sql' END AS language,
 CASE WHEN p_partkey % 9 <> 0 THEN 'select ' || p_type END AS compiled, CASE WHEN p_partkey % 10 <> 0 THEN p_name END AS checksum, p_partkey % 2 = 0 AS pure, CASE WHEN p_partkey % 23 <> 0 THEN p_type END AS conf, substr(p_brand, 1, 7) AS contract, 'db.t' || CAST(p_partkey AS STRING) AS relation, 'engine 1' AS engine,
 CASE WHEN p_partkey % 31 = 0 THEN 'select env_var(1)' WHEN p_partkey % 37 = 0 THEN 'grant select' END AS hook FROM part"""
CSQL = "(resource_type IN ('model', 'snapshot') AND language <> 'python')"
CFILE = f"(NOT {CSQL} OR NOT pure)"
CWHY = f"CASE WHEN conf IS NULL THEN 'no config' WHEN contains(hook, 'env_var') THEN 'hooks read what is known at run time' WHEN resource_type IN ('model', 'snapshot') AND compiled IS NULL THEN 'no compiled code' WHEN {CFILE} AND checksum IS NULL THEN 'no checksum' END"
# a node uses the macro of its brand; brand macros call the macro of their maker, and that the base macro
USES = f"SELECT {SCOPE} AS scope, p_partkey AS node, p_brand AS macro FROM part"
CALLS = f"SELECT DISTINCT {SCOPE} AS scope, p_brand AS macro, substr(p_brand, 1, 7) AS calls FROM part UNION SELECT DISTINCT {SCOPE}, substr(p_brand, 1, 7), 'base' FROM part"
MACROS = f"SELECT DISTINCT {SCOPE} AS scope, p_brand AS macro, 'm ' || p_brand AS sql FROM part WHERE p_brand <> 'Brand#13' UNION SELECT DISTINCT {SCOPE}, 'base', 'b' FROM part"
REACH = f"r AS (SELECT scope, node, macro FROM ({USES}) UNION SELECT r.scope, r.node, c.calls FROM r JOIN ({CALLS}) c USING (scope, macro)), lines AS (SELECT r.scope, r.node, string_agg(macro || ' ' || sha256(m.sql), chr(10) ORDER BY macro || ' ' || sha256(m.sql)) AS content, string_agg(macro, ', ' ORDER BY macro) FILTER (m.sql IS NULL) AS lacks FROM (SELECT DISTINCT * FROM r) r LEFT JOIN ({MACROS}) m USING (scope, macro) GROUP BY ALL)"
PARTS = " UNION ALL ".join(f"SELECT scope, node, '{n}' AS component, coalesce({c}, '') AS content FROM code WHERE why IS NULL AND {w}" for n, c, w in [("scheme", "'code/2'", "true"), ("config", "'materialized=' || conf || CASE WHEN hook IS NOT NULL THEN chr(10) || 'post-hook=' || hook ELSE '' END", "true"), ("contract", "contract", "true"), ("relation", "relation", "true"), ("engine", "engine", "true"), ("sql", "compiled", CSQL), ("file", "checksum", CFILE), ("compiled_code", "compiled", f"resource_type IN ('model', 'snapshot') AND NOT {CSQL}")])
A20 = f"WITH RECURSIVE {REACH}, code0 AS (SELECT *, {CWHY} AS why0 FROM ({CODE})), code AS (SELECT code0.*, coalesce(why0, 'macros that the artifacts don''t include: ' || lacks) AS why FROM code0 LEFT JOIN lines USING (scope, node)), parts AS ({PARTS} UNION ALL SELECT scope, node, 'macros', coalesce(content, '') FROM code LEFT JOIN lines USING (scope, node) WHERE why IS NULL) SELECT scope, node, sha256(string_agg(component || chr(0) || sha256(content) || chr(10), '' ORDER BY component)) AS digest, CAST(NULL AS VARCHAR) AS reason FROM parts GROUP BY scope, node UNION ALL SELECT scope, node, NULL, why FROM code WHERE why IS NOT NULL"


@query("a20_code_fingerprint", A20)
def a20(spark, sf):
    n = view(spark, sf, CODE)
    n = n.withColumn("config", F.when(F.col("conf").isNotNull(), F.create_map(F.lit("materialized"), F.col("conf"), F.lit("tags"), F.col("checksum"), F.lit("meta"), F.lit("x"))))
    n = n.withColumn("config", F.when(F.col("hook").isNotNull(), F.map_concat("config", F.create_map(F.lit("post-hook"), F.col("hook")))).otherwise(F.col("config")))
    return P.code_fingerprint(n, view(spark, sf, USES), view(spark, sf, CALLS), view(spark, sf, MACROS), F.col("compiled"))


@query("a21_checks_digest", f"WITH t AS (SELECT scope, d1 AS node, 'check ' || test AS component, name AS content FROM ({TESTS}) UNION SELECT scope, d2, 'check ' || test, name FROM ({TESTS}) WHERE d2 IS NOT NULL), a AS (SELECT * FROM t UNION ALL SELECT DISTINCT scope, node, 'engine', 'engine 1' FROM t) SELECT scope, node, sha256(string_agg(component || chr(0) || sha256(content) || chr(10), '' ORDER BY component)) AS digest FROM a GROUP BY ALL")
def a21(spark, sf):
    return P.checks_digest(tests(spark, sf).select("scope", F.col("test").alias("check"), "depends_on", F.col("name").alias("content")), "engine 1")


RUNS = "SELECT 'r' || CAST(o_custkey % 5 AS STRING) AS scope, 'run-' || CAST(o_custkey AS STRING) AS run_id, 'n' || CAST(o_orderkey AS STRING) AS node FROM orders"
WAS = "SELECT 'r' || CAST(o_custkey % 5 AS STRING) AS scope, 'run-' || CAST(o_custkey AS STRING) AS run_id, 'n' || CAST(o_orderkey AS STRING) AS node, c AS component, CASE WHEN c = 'sql' THEN o_orderstatus ELSE o_orderpriority END AS digest FROM orders CROSS JOIN (SELECT 'sql' AS c UNION ALL SELECT 'config' AS c) x WHERE o_orderkey % 5 <> 0 AND NOT (c = 'config' AND o_orderkey % 7 = 0)"
IS = "SELECT 'r' || CAST(o_custkey % 5 AS STRING) AS scope, 'run-' || CAST(o_custkey AS STRING) AS run_id, 'n' || CAST(o_orderkey AS STRING) AS node, c AS component, CASE WHEN c = 'sql' THEN CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus || '!' ELSE o_orderstatus END ELSE o_orderpriority END AS digest FROM orders CROSS JOIN (SELECT 'sql' AS c UNION ALL SELECT 'config' AS c) x WHERE o_orderkey % 11 <> 0"


@query("g24_plan_from_states", f"WITH d AS (SELECT scope, run_id, node, string_agg(component, ',' ORDER BY component) AS changed FROM ({WAS}) b FULL JOIN ({IS}) a USING (scope, run_id, node, component) WHERE b.digest IS DISTINCT FROM a.digest AND (scope, run_id, node) IN (SELECT (scope, run_id, node) FROM ({WAS})) AND (scope, run_id, node) IN (SELECT (scope, run_id, node) FROM ({IS})) GROUP BY ALL) SELECT scope, run_id, node, 'BUILD' AS action, CASE WHEN changed IS NOT NULL THEN 'code_changed' END AS reason, changed FROM (SELECT DISTINCT * FROM ({RUNS})) LEFT JOIN d USING (scope, run_id, node)")
def g24(spark, sf):
    return P.plan_from_states(view(spark, sf, RUNS), view(spark, sf, WAS), view(spark, sf, IS))


@query("d1_register_check", oracle("SELECT node, 'few_tests' AS \"check\", CASE WHEN node % 5 = 0 THEN 'skipped' WHEN tests > 1 THEN 'pass' ELSE 'fail' END AS status, 'warn' AS severity FROM node_facts UNION ALL SELECT node, 'half_answered', CASE WHEN node % 5 = 0 THEN 'skipped' WHEN node % 2 = 0 THEN 'pass' ELSE 'unknown' END, 'error' FROM node_facts", "node_facts"))
def d1(spark, sf):
    n = bind(spark, sf, "node_facts")
    r = Registry()
    r.register_check("few_tests", "warn", lambda asked: asked.select("node", F.when(F.col("tests") > 1, "pass").otherwise("fail").alias("status")))
    r.register_check("half_answered", "error", lambda asked: asked.where("node % 2 = 0").select("node", F.lit("pass").alias("status")))
    return r.findings(n.where("node % 5 <> 0"), n)


@query("d2_register_catalogue", oracle("SELECT doc_id, CASE WHEN contains(lower(message), 'permission denied') THEN 'access' WHEN kind = 'Binder Error' THEN 'binder' WHEN contains(lower(message), 'not') THEN 'missing' END AS pattern FROM error_messages", "error_messages"))
def d2(spark, sf):
    rows = "ordinal int, pattern string, kind string, phrases array<string>, symptom string, category string"
    r = Registry()
    r.register_catalogue("ours", "1", spark.createDataFrame([(0, "access", None, ["permission denied"], "denied", "access")], rows))
    r.register_catalogue("builtin", "1", spark.createDataFrame([(0, "binder", "Binder Error", [], "column", "code"), (1, "missing", None, ["not"], "missing", "code")], rows))
    return r.classify(bind(spark, sf, "error_messages")).select("doc_id", "pattern")


@query("d3_register_lineage_source", oracle("SELECT node, source, output FROM predicted_edges UNION SELECT node, source, output FROM observed_edges", "predicted_edges", "observed_edges"))
def d3(spark, sf):
    r = Registry()
    r.register_lineage_source("log", lambda s: bind(s, sf, "predicted_edges").select("node", "source", "output"))
    r.register_lineage_source("audit", lambda s: bind(s, sf, "observed_edges"))
    return r.observed(spark)


@query("d4_register_reading", oracle("SELECT source, CAST(coalesce(recorded_version, now_version) AS VARCHAR) AS version, CASE WHEN recorded_version IS NOT NULL THEN 'table_version' WHEN now_version IS NOT NULL THEN 'freshness' ELSE 'none' END AS strategy FROM source_versions", "source_versions"))
def d4(spark, sf):
    v = bind(spark, sf, "source_versions")
    r = Registry()
    r.register_reading("table_version", v.select("source", F.col("recorded_version").cast("string").alias("version")))
    r.register_reading("freshness", v.select("source", F.col("now_version").cast("string").alias("version")))
    return r.versions().select("source", "version", "strategy")


@query("d5_register_probe", "SELECT 'rows' AS probe, 'orders' AS node, CASE WHEN count(*) > 10 THEN 'pass' ELSE 'fail' END AS status FROM orders UNION ALL SELECT 'rows', 'lineitem', CASE WHEN count(*) > 10 THEN 'pass' ELSE 'fail' END FROM lineitem UNION ALL SELECT 'price', 'orders', CASE WHEN min(o_totalprice) < 0 THEN 'fail' ELSE 'pass' END FROM orders")
def d5(spark, sf):
    r = Registry()
    r.register_probe("rows", {"n": F.count(F.lit(1))}, F.col("n") > 10)
    r.register_probe("price", {"least": F.min("o_totalprice")} , F.col("least") >= 0, lambda name: name == "orders")
    return r.probe_findings({"orders": bind(spark, sf, "orders"), "lineitem": bind(spark, sf, "lineitem")})


LOG = "SELECT CASE WHEN l_partkey % 17 <> 0 THEN 'db.s.t' || CAST(l_partkey AS STRING) END AS source_table_full_name, 'c' || CAST(l_linenumber AS STRING) AS source_column_name, 'db.s.u' || CAST(l_suppkey AS STRING) AS target_table_full_name, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'o' || CAST(l_linenumber AS STRING) END AS target_column_name, CAST(l_shipdate AS STRING) AS event_time FROM lineitem"


@query("s8_observed_edges", f"SELECT DISTINCT source_table_full_name AS source, source_column_name AS source_column, target_table_full_name AS target, target_column_name AS target_column FROM ({LOG}) WHERE source_table_full_name IS NOT NULL AND target_column_name <> ''")
def s8(spark, sf):
    return observed_lineage(view(spark, sf, LOG))["edges"]


@query("s8_row_inputs", f"SELECT DISTINCT source_table_full_name AS source, source_column_name AS source_column, target_table_full_name AS target FROM ({LOG}) WHERE source_table_full_name IS NOT NULL AND target_column_name = ''")
def s8r(spark, sf):
    return observed_lineage(view(spark, sf, LOG))["row_inputs"]
