"""Health over the parts as nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from fleetlens.bindings import bind, oracle
from fleetlens.operators import health as H

QUERIES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def nodes(spark, sf):
    return bind(spark, sf, "node_facts")


STATE = "SELECT node, timestamp '2024-01-02 00:00:00' AS built_at FROM node_facts WHERE node % 4 <> 0"
RES = "SELECT node, CASE WHEN node % 10 = 1 THEN 'failed' WHEN node % 10 = 2 THEN 'skipped' ELSE 'built' END AS action, CASE WHEN node % 3 = 0 THEN timestamp '2024-01-01 00:00:00' ELSE timestamp '2024-01-02 00:00:00' END AS started_at FROM node_facts WHERE node % 6 <> 5"


def sql(spark, sf, text):
    nodes(spark, sf).createOrReplaceTempView("node_facts")
    return spark.sql(text)


HB = f"SELECT node, 'built' AS \"check\", 'warn' AS severity, CASE WHEN built_at IS NOT NULL THEN 'pass' ELSE 'unknown' END AS status FROM node_facts LEFT JOIN ({STATE}) USING (node)"
HL = lambda a: f"SELECT node, 'last_run_{a}' AS \"check\", 'error' AS severity, CASE WHEN action IS NULL THEN 'unknown' WHEN action = '{a}' AND NOT coalesce(built_at > started_at, false) THEN 'fail' ELSE 'pass' END AS status FROM node_facts LEFT JOIN ({RES}) USING (node) LEFT JOIN ({STATE}) USING (node)"
HT = "SELECT node, 'tests_required' AS \"check\", 'warn' AS severity, CASE WHEN tests = 0 THEN 'fail' ELSE 'pass' END AS status FROM node_facts"
HD = "SELECT node, 'described' AS \"check\", 'warn' AS severity, CASE WHEN described THEN 'pass' ELSE 'fail' END AS status FROM node_facts"


@query("h1_built", oracle(HB, "node_facts"))
def h1(spark, sf):
    return H.built(nodes(spark, sf), sql(spark, sf, STATE))


@query("h2_last_run_failed", oracle(HL("failed"), "node_facts"))
def h2(spark, sf):
    return H.last_run(nodes(spark, sf), sql(spark, sf, RES), sql(spark, sf, STATE), "failed")


@query("h3_last_run_skipped", oracle(HL("skipped"), "node_facts"))
def h3(spark, sf):
    return H.last_run(nodes(spark, sf), sql(spark, sf, RES), sql(spark, sf, STATE), "skipped")


@query("h4_tests_required", oracle(HT, "node_facts"))
def h4(spark, sf):
    return H.tests_required(nodes(spark, sf))


@query("h5_tests_passed", oracle("SELECT node, 'tests_passed' AS \"check\", 'error' AS severity, CASE WHEN tests = 0 OR node % 4 = 0 THEN 'skipped' WHEN node % 5 = 0 THEN 'fail' WHEN node % 7 = 0 THEN 'fail' ELSE 'pass' END AS status FROM node_facts", "node_facts"))
def h5(spark, sf):
    return H.tests_passed(nodes(spark, sf).withColumns({"was_built": F.expr("node % 4 <> 0"), "checks": F.lit("a"), "tested_checks": F.expr("CASE WHEN node % 5 = 0 THEN NULL WHEN node % 7 = 0 THEN 'b' ELSE 'a' END")}))


@query("h6_declared_checks", oracle(HD, "node_facts"))
def h6(spark, sf):
    return H.declared(nodes(spark, sf), "described", "warn", F.col("described"))


@query("h7_probe_checks", oracle("SELECT node, 'small' AS \"check\", 'error' AS severity, CASE WHEN node % 3 = 0 THEN 'unknown' WHEN node % 5 = 0 THEN 'unknown' WHEN layer < 25 THEN 'pass' ELSE 'fail' END AS status FROM node_facts", "node_facts"))
def h7(spark, sf):
    return H.probe_check(nodes(spark, sf), "small", "error", F.expr("CASE WHEN node % 5 <> 0 THEN layer END") < 25, F.expr("CASE WHEN node % 3 <> 0 THEN true END"))


ANS = "SELECT 'c1' AS check, node, 'pass' AS status FROM node_facts WHERE node % 2 = 0 UNION ALL SELECT 'c1', node, 'fail' FROM node_facts WHERE node % 6 = 0 UNION ALL SELECT 'c2', node, 'pass' FROM node_facts UNION ALL SELECT 'c2', CAST(-1 AS BIGINT), 'pass'"


@query("h8_reconcile_registered", oracle("SELECT node, \"check\", CASE WHEN node % 5 = 0 THEN 'skipped' WHEN \"check\" = 'c2' THEN 'unknown' WHEN node % 2 <> 0 OR node % 6 = 0 THEN 'unknown' ELSE 'pass' END AS status FROM node_facts, (SELECT unnest(['c1', 'c2']) AS \"check\")", "node_facts"))
def h8(spark, sf):
    n = nodes(spark, sf)
    return H.reconcile(n.where("node % 5 <> 0"), sql(spark, sf, ANS), n, ["c1", "c2"])


SCOPED = "SELECT 'p' || CAST(node % 3 AS STRING) AS scope, CAST(floor(node / 3) AS BIGINT) AS node, node AS id, tests FROM node_facts"


@query("h8_silent_checks_by_scope", oracle(f"""SELECT scope, node, "check", CASE WHEN id % 5 = 0 THEN 'skipped' WHEN "check" = 'silent' THEN 'unknown' WHEN scope = 'p1' THEN 'unknown' WHEN tests > 1 THEN 'pass' ELSE 'fail' END AS status
 FROM ({SCOPED}), (SELECT unnest(['tests', 'silent']) AS "check")""", "node_facts"))
def h8_silent(spark, sf):
    """Three projects that share node numbers; one check answers nothing, the other names a stranger in project p1."""
    n = sql(spark, sf, SCOPED)
    answers = n.where("id % 5 <> 0").select("scope", "node", F.lit("tests").alias("check"), F.when(F.col("tests") > 1, "pass").otherwise("fail").alias("status"))
    stranger = answers.where("scope = 'p1'").limit(1).select("scope", F.lit(-1).cast("long").alias("node"), "check", "status")
    return H.reconcile(n.where("id % 5 <> 0"), answers.unionByName(stranger), n, ["tests", "silent"])


@query("h9_merge_recorded", oracle(f"SELECT * FROM ({HT}) WHERE node % 2 = 0 UNION ALL SELECT node, \"check\", severity, 'unknown' FROM ({HT}) WHERE node % 2 = 1", "node_facts"))
def h9(spark, sf):
    f = h4(spark, sf)
    return H.merge_recorded(f.where("node % 2 = 0"), f.withColumn("status", F.lit("unknown")))


def findings(spark, sf):
    return reduce(lambda a, b: a.unionByName(b), [h1(spark, sf), h2(spark, sf), h4(spark, sf), h6(spark, sf)])


ALL = f"({HB} UNION ALL {HL('failed')} UNION ALL {HT} UNION ALL {HD})"
BADGE = f"SELECT node, CASE WHEN bool_or(status = 'fail' AND severity = 'error') THEN 'failing' WHEN bool_or(status = 'unknown' AND severity = 'error') THEN 'unknown' WHEN bool_or(status = 'fail' AND severity = 'warn') THEN 'warning' WHEN bool_or(status = 'pass') THEN 'healthy' ELSE 'unknown' END AS health, coalesce(string_agg(DISTINCT \"check\", ',' ORDER BY \"check\") FILTER (status = 'fail'), '') AS reasons FROM {ALL} GROUP BY node"


@query("a6_badge", oracle(BADGE, "node_facts"))
def a6(spark, sf):
    return H.badge(findings(spark, sf))


@query("a7_health_counts", oracle(f"SELECT h AS health, count(node) AS n FROM (SELECT unnest(['failing', 'warning', 'unknown', 'healthy']) AS h) LEFT JOIN ({BADGE}) ON health = h GROUP BY h", "node_facts"))
def a7(spark, sf):
    return H.health_counts(a6(spark, sf))


@query("h10_report_fails", oracle(f"SELECT coalesce(bool_or(severity = 'error' AND status IN ('fail', 'unknown')), false) AS fails, count(*) FILTER (severity = 'error' AND status IN ('fail', 'unknown')) AS n FROM {ALL}", "node_facts"))
def h10(spark, sf):
    return H.report_fails(findings(spark, sf), strict=True)


@query("h11_unmatched_probes", oracle("SELECT DISTINCT 'probe-' || tag AS probe FROM node_facts WHERE tag NOT IN (SELECT tag FROM node_facts WHERE layer > 48 AND tests > 2)", "node_facts"))
def h11(spark, sf):
    n = nodes(spark, sf).withColumn("probe", F.concat(F.lit("probe-"), "tag"))
    return H.unmatched_probes(n.select("probe").distinct(), n.where("layer > 48 and tests > 2"))


COV = "SELECT resource_type, count(*) FILTER (tests > 0) AS tested, count(*) FILTER (described) AS described, count(*) AS total FROM node_facts GROUP BY resource_type"


@query("a8_coverage", oracle(COV, "node_facts"))
def a8(spark, sf):
    return H.coverage(nodes(spark, sf), "resource_type")


@query("a9_coverage_verdict", oracle(f"SELECT *, tested * 1000 // total AS share, CASE WHEN tested * 1000 >= total * 755 THEN 'pass' ELSE 'fail' END AS verdict FROM ({COV})", "node_facts"))
def a9(spark, sf):
    return H.coverage_verdict(a8(spark, sf), 755)


@query("a11_catalog_facets", oracle("SELECT facet, value, count(*) AS n FROM (SELECT resource_type, tag, CAST(tests AS VARCHAR) AS tests, CAST(described AS VARCHAR) AS described FROM node_facts) UNPIVOT INCLUDE NULLS (value FOR facet IN (resource_type, tag, tests, described)) GROUP BY ALL", "node_facts"))
def a11(spark, sf):
    return H.facets(nodes(spark, sf), ["resource_type", "tag", "tests", "described"])


RF = "SELECT run_id, action, scope, CAST(month(finished_at) AS STRING) AS bucket FROM ledger_nodes"


@query("a12_run_facets", oracle(f", r AS ({RF}) SELECT 'action' AS facet, action AS value, count(*) FILTER (scope = 'r1' AND bucket = '3') AS n FROM r GROUP BY action UNION ALL SELECT 'scope', scope, count(*) FILTER (action = 'built' AND bucket = '3') FROM r GROUP BY scope UNION ALL SELECT 'bucket', bucket, count(*) FILTER (action = 'built' AND scope = 'r1') FROM r GROUP BY bucket", "ledger_nodes"))
def a12(spark, sf):
    bind(spark, sf, "ledger_nodes").createOrReplaceTempView("ledger_nodes")
    return H.run_facets(spark.sql(RF), {"action": "built", "scope": "r1", "bucket": "3"})


@query("p1_select_nodes", "SELECT p_partkey AS node FROM part WHERE p_size BETWEEN 1 AND 30 AND p_name LIKE '%r%' AND p_partkey % 10 <> 1")
def p1(spark, sf):
    p = bind(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"), F.lit("model").alias("resource_type"), F.when(F.col("p_size").between(1, 30), "keep").otherwise("other").alias("tag"))
    return H.select_nodes(p, ["model"], ["keep"], "*r*", F.col("node") % 10 == 1).select("node")


@query("p5_catalog_filter", "SELECT p_partkey AS node FROM part WHERE p_size <= 40 AND p_brand IN (SELECT min(p_brand) FROM part UNION ALL SELECT max(p_brand) FROM part) AND contains(lower(p_name), 'ri')")
def p5(spark, sf):
    p = bind(spark, sf, "part")
    ends = p.agg(F.min("p_brand"), F.max("p_brand")).first()
    return H.catalog_filter(p.select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"), "p_size", "p_brand"), {"p_size": list(range(41)), "p_brand": list(ends)}, "RI").select("node")


@query("t2_catalog_sort", "SELECT node, CAST(row_number() OVER (PARTITION BY part ORDER BY v DESC NULLS LAST, node) AS INTEGER) AS place, part FROM (SELECT p_partkey AS node, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS v, p_type AS part FROM part)")
def t2(spark, sf):
    p = bind(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.expr("CASE WHEN p_partkey % 7 <> 0 THEN p_size END").alias("v"), F.col("p_type").alias("part"))
    return H.catalog_sort(p, "v", True, "part")


@query("a25_layer_order", oracle("SELECT layer, min(tests) AS position FROM node_facts GROUP BY layer", "node_facts"))
def a25(spark, sf):
    return H.layer_order(nodes(spark, sf).withColumn("depth", F.col("tests")))


REC = "SELECT scope, run_id AS id, max(finished_at) AS at FROM ledger_nodes GROUP BY scope, run_id"


@query("s16_latest_health_records", oracle(f"SELECT scope, id, CAST(age AS INTEGER) AS age FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY \"at\" DESC, id DESC) AS age FROM ({REC})) WHERE age <= 3", "ledger_nodes"))
def s16(spark, sf):
    bind(spark, sf, "ledger_nodes").createOrReplaceTempView("ledger_nodes")
    return H.latest_records(spark.sql(REC), 3).select("scope", "id", "age")


GR = "SELECT l_partkey AS relation, l_suppkey AS login, CASE l_returnflag WHEN 'A' THEN 'MODIFY' ELSE 'SELECT' END AS privilege FROM lineitem"


@query("j22_privilege_audit", f"WITH g AS ({GR}), m AS (SELECT * FROM g UNION ALL SELECT DISTINCT relation, login, 'OWNERSHIP' FROM g WHERE relation % 20 = login % 20), b AS (SELECT relation, login, coalesce(string_agg(DISTINCT privilege, ',' ORDER BY privilege) FILTER (privilege <> 'SELECT'), '') AS beyond FROM m GROUP BY ALL) SELECT relation, login, CASE WHEN relation % 9 = 0 THEN 'unknown' WHEN beyond = '' THEN 'read_only' ELSE 'elevated' END AS verdict, beyond FROM b")
def j22(spark, sf):
    bind(spark, sf, "node_facts")
    g = spark.sql(GR)
    rel = bind(spark, sf, "part").select(F.col("p_partkey").alias("relation"), F.expr("p_partkey % 9 = 0").alias("external"))
    return H.privilege_audit(g, g.where("relation % 20 = login % 20").select("relation", "login").distinct(), rel)


@query("j23_expected_relation", "SELECT p_partkey AS node, CASE WHEN p_partkey % 4 = 0 THEN 'unknown' ELSE 'match' END AS verdict FROM part")
def j23(spark, sf):
    p = bind(spark, sf, "part")
    return H.expected_relation(p.select(F.col("p_partkey").alias("node"), F.upper("p_name").alias("expected"), F.expr("CASE WHEN p_partkey % 4 = 0 THEN 'x' || p_name ELSE p_name END").alias("found")))


CV = "SELECT DISTINCT l_suppkey AS node, 'C' || CAST(l_partkey % 60 AS STRING) AS column FROM lineitem WHERE l_linenumber <= 2"
WV = "SELECT DISTINCT l_suppkey AS node, 'c' || CAST(l_partkey % 60 AS STRING) AS column, 'int' AS type FROM lineitem WHERE l_linenumber > 2"
TV = "SELECT l_suppkey AS node, 'c' || CAST(l_partkey % 60 AS STRING) AS column, CASE WHEN l_linenumber = 1 THEN 'unique' ELSE 'not_null' END AS test FROM lineitem WHERE l_partkey % 3 = 0"
_d = lambda s: s.replace("AS column", "AS col")


@query("j25_column_views", f"SELECT node, col AS \"column\", type, coalesce(tests, '') AS tests, c IS NULL AS possibly_stale FROM (SELECT node, lower(col) AS col, true AS c FROM ({_d(CV)})) FULL JOIN ({_d(WV)}) USING (node, col) LEFT JOIN (SELECT node, col, string_agg(DISTINCT test, ',' ORDER BY test) AS tests FROM ({_d(TV)}) GROUP BY ALL) USING (node, col)")
def j25(spark, sf):
    bind(spark, sf, "node_facts")
    return H.column_views(spark.sql(CV), spark.sql(WV), spark.sql(TV))




RELS = """SELECT p_partkey AS relation, p_brand AS "schema", substr(p_brand, 1, 7) AS "catalog", 'm' AS metastore, CASE p_size % 5 WHEN 0 THEN 'EXTERNAL' WHEN 1 THEN 'view' ELSE 'MANAGED' END AS kind FROM part WHERE p_partkey % 17 <> 0"""
ASKED = "SELECT p_partkey AS relation, 'u' || CAST(u AS STRING) AS login FROM part CROSS JOIN (SELECT 0 AS u UNION ALL SELECT 1 AS u UNION ALL SELECT 2 AS u UNION ALL SELECT 3 AS u) us"
GRANTS = """SELECT 'relation' AS level, CAST(p_partkey AS STRING) AS securable, 'g' || CAST(p_partkey % 4 AS STRING) AS principal, CASE p_size % 3 WHEN 0 THEN 'MODIFY' WHEN 1 THEN 'SELECT' ELSE 'browse' END AS privilege, p_partkey % 29 = 0 AS grantable FROM part
 UNION SELECT 'schema', p_brand, 'u1', 'USE_SCHEMA', false FROM part UNION SELECT 'schema', p_brand, 'g4', 'CREATE_TABLE', false FROM part WHERE p_brand LIKE '%1'
 UNION SELECT 'catalog', substr(p_brand, 1, 7), 'u2', 'USE CATALOG', p_brand LIKE 'Brand#3%' FROM part UNION SELECT 'metastore', 'm', 'u3', 'USE MARKETPLACE ASSETS', false FROM part"""
OWN = "SELECT 'catalog' AS level, substr(p_brand, 1, 7) AS securable, 'g5' AS principal FROM part WHERE p_brand LIKE 'Brand#2%' UNION SELECT 'relation', CAST(p_partkey AS STRING), 'u0' FROM part WHERE p_partkey % 31 = 0"
# g3 is in g4, g4 in g5 and g5 in g3 again
MEMBERS = "SELECT 'u' || CAST(n_nationkey AS STRING) AS member, 'g' || CAST(n_nationkey % 3 AS STRING) AS \"group\" FROM nation UNION SELECT 'u3', 'g3' FROM nation UNION SELECT 'g3', 'g4' FROM nation UNION SELECT 'g4', 'g5' FROM nation UNION SELECT 'g5', 'g3' FROM nation"
J22 = f"""WITH RECURSIVE a AS ({ASKED}), mem AS ({MEMBERS}), act AS (SELECT DISTINCT login, login AS principal FROM a UNION SELECT act.login, mem."group" FROM act JOIN mem ON mem.member = act.principal),
 g AS (SELECT level, securable, principal, replace(upper(privilege), '_', ' ') AS privilege, grantable FROM ({GRANTS})),
 held AS (SELECT level, securable, principal, privilege AS what FROM g WHERE grantable OR NOT (CASE level WHEN 'relation' THEN privilege IN ('SELECT', 'BROWSE') WHEN 'schema' THEN privilege IN ('SELECT', 'BROWSE', 'USE SCHEMA')
  WHEN 'catalog' THEN privilege IN ('SELECT', 'BROWSE', 'USE CATALOG', 'USE SCHEMA') ELSE privilege = 'USE MARKETPLACE ASSETS' END) UNION SELECT level, securable, principal, 'OWNERSHIP' FROM ({OWN})),
 pl AS (SELECT a.relation, a.login, CAST(a.relation AS STRING) AS s0, r."schema" AS s1, r."catalog" AS s2, r.metastore AS s3, r.kind FROM a LEFT JOIN ({RELS}) r USING (relation)),
 l AS (SELECT relation, login, n, string_agg(DISTINCT what, ', ' ORDER BY what) || ' on the ' || lev AS line FROM (
  SELECT pl.relation, pl.login, n, lev, what FROM pl JOIN act USING (login) JOIN (SELECT *, CASE level WHEN 'relation' THEN 0 WHEN 'schema' THEN 1 WHEN 'catalog' THEN 2 ELSE 3 END AS n, level AS lev FROM held) h
   ON h.principal = act.principal AND h.securable = CASE n WHEN 0 THEN s0 WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END) GROUP BY relation, login, n, lev)
SELECT relation, login, CASE WHEN kind IS NULL OR upper(kind) NOT IN ('MANAGED', 'VIEW', 'MATERIALIZED_VIEW') THEN 'unknown' WHEN b IS NULL THEN 'read_only' ELSE 'elevated' END AS verdict,
 CASE WHEN upper(kind) IN ('MANAGED', 'VIEW', 'MATERIALIZED_VIEW') THEN coalesce(b, '') END AS beyond FROM pl LEFT JOIN (SELECT relation, login, string_agg(line, '; ' ORDER BY n) AS b FROM l GROUP BY ALL) USING (relation, login)"""


@query("j22_privilege_hierarchy", J22)
def j22_hierarchy(spark, sf):
    """Grants and owners of relations, schemas, catalogs and the metastore, held through nested groups."""
    t = lambda q: sql(spark, sf, q.replace('"', "`"))
    asked = t(ASKED)
    held = H.effective_privileges(t(GRANTS), t(OWN), t(MEMBERS), asked.select("login").distinct())
    as_text = lambda df: df.withColumn("relation", F.col("relation").cast("string"))
    return H.privilege_report(as_text(asked), as_text(t(RELS)), held).withColumn("relation", F.col("relation").cast("long"))


@query("h10_report_strict", oracle(f"""SELECT coalesce(bool_or(bad), false) AS fails, count(*) FILTER (bad) AS n FROM (SELECT severity = 'error' AND status IN ('fail', 'unknown') AS bad FROM (SELECT severity, status FROM {ALL}
 UNION ALL SELECT 'error', CASE WHEN tested * 1000 >= total * 755 THEN 'pass' ELSE 'fail' END FROM ({COV})
 UNION ALL SELECT CASE WHEN probe LIKE '%1' THEN 'error' ELSE 'warn' END, 'unknown' FROM (SELECT DISTINCT 'probe-' || tag AS probe FROM node_facts WHERE tag NOT IN (SELECT tag FROM node_facts WHERE layer > 48 AND tests > 2))))""", "node_facts"))
def h10_strict(spark, sf):
    covered = a9(spark, sf).select(F.lit("error").alias("severity"), F.col("verdict").alias("status"))
    unmatched = h11(spark, sf).select(F.when(F.col("probe").endswith("1"), "error").otherwise("warn").alias("severity"))
    return H.report_fails(findings(spark, sf), True, covered, unmatched)


@query("a11_catalog_facets_listed", oracle(f"""SELECT scope, facet, value, CAST(sum(one) AS BIGINT) AS n FROM (SELECT scope, 'few' AS facet, CASE WHEN tests < 2 THEN 'few' ELSE 'many' END AS value, 1 AS one FROM ({SCOPED}) UNION ALL SELECT scope, 'tests', CAST(tests AS VARCHAR), 1 FROM ({SCOPED})
 UNION ALL SELECT scope, f, v, 0 FROM (SELECT DISTINCT scope FROM ({SCOPED})), (SELECT unnest(['few', 'few', 'few', 'tests', 'tests']) AS f, unnest(['few', 'many', 'none', '2', '77']) AS v)) GROUP BY ALL""", "node_facts"))
def a11_listed(spark, sf):
    n = sql(spark, sf, SCOPED).withColumn("few", F.when(F.col("tests") < 2, "few").otherwise("many"))
    return H.facets(n, ["few", "tests"], {"few": ["few", "many", "none"]}, {"tests": [2, 77]})


@query("p5_catalog_filter_ids", "SELECT p_partkey AS node FROM part WHERE contains(lower(p_name), '17') OR contains(CAST(p_partkey AS VARCHAR), '17')")
def p5_ids(spark, sf):
    return H.catalog_filter(bind(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name")), {}, "17").select("node")
