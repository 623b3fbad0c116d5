"""Histories and diffs of nodes over yearly snapshots of the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.bindings import bind, oracle
from fleetlens.operators import history as O

QUERIES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


STATES = """SELECT scope, snapshot, node, 'run-' || CAST(k % 2 AS STRING) AS run_id, CASE WHEN k % 4 > 0 THEN 't' || CAST(k % 3 AS STRING) END AS tested, 'a' || CAST(k % 2 AS STRING) AS c_sql,
 CASE WHEN k % 5 > 0 THEN 'c' || CAST(k % 3 AS STRING) END AS c_config, CASE WHEN k % 7 > 0 THEN 'v' || CAST(k % 2 AS STRING) END AS i_s1, k % 3 > 0 AS has_s2, CASE WHEN k % 4 > 0 THEN 'w' || CAST(k % 2 AS STRING) END AS i_s2,
 'r' || CAST(k % 2 AS STRING) AS p_p1, CASE WHEN k % 4 <> 1 THEN 'r' || CAST(k % 3 AS STRING) END AS p_p2, CASE WHEN snapshot % 5 > 0 THEN CASE WHEN snapshot % 3 = 0 THEN 'prod' ELSE 'dev' END END AS target
FROM (SELECT scope, year(finished_at) AS snapshot, 'n' || CAST(CAST(substr(node, 2) AS BIGINT) % 400 AS STRING) AS node, max(CAST(floor(CAST(substr(node, 2) AS BIGINT) / 400) AS BIGINT) + CAST(substr(node, 2) AS BIGINT)) AS k
 FROM ledger_nodes GROUP BY scope, year(finished_at), 'n' || CAST(CAST(substr(node, 2) AS BIGINT) % 400 AS STRING)) x"""


def line(what: str, name: str, b: str, a: str, when: str = "true") -> str:
    return f"CASE WHEN {when} AND {b} IS DISTINCT FROM {a} THEN '{what}:{name}:' || coalesce({b}, '-') || '>' || coalesce({a}, '-') END"


#: What differs between the states b and a; s2 may be read or not.
CHANGES = "concat_ws(';', " + ", ".join([
    line("code", "config", "b.c_config", "a.c_config"), line("code", "sql", "b.c_sql", "a.c_sql"), line("data", "s1", "b.i_s1", "a.i_s1"), line("data", "s2", "b.i_s2", "a.i_s2", "b.has_s2 AND a.has_s2"),
    "CASE WHEN a.has_s2 AND NOT b.has_s2 THEN 'data:s2:->' || coalesce(a.i_s2, '-') END", line("upstream", "p1", "b.p_p1", "a.p_p1"), line("upstream", "p2", "b.p_p2", "a.p_p2"), line("target", "", "b.target", "a.target"),
]) + ")"


def states(spark, sf):
    bind(spark, sf, "ledger_nodes").createOrReplaceTempView("ledger_nodes")
    s = spark.sql(STATES)
    some = lambda *pairs: F.map_from_entries(F.array_compact(F.array(*[F.when(when, F.struct(F.lit(k).alias("k"), F.col(v).alias("v"))) for k, v, when in pairs])))
    given = lambda c: F.col(c).isNotNull()
    return s.select(
        "scope", "snapshot", "node", "run_id", "tested", some(("sql", "c_sql", given("c_sql")), ("config", "c_config", given("c_config"))).alias("components"),
        some(("s1", "i_s1", F.lit(True)), ("s2", "i_s2", F.col("has_s2"))).alias("inputs"), some(("p1", "p_p1", given("p_p1")), ("p2", "p_p2", given("p_p2"))).alias("parents"), "target",
    )


def told(df):
    """The changes as text."""
    text = F.transform("changes", lambda c: F.concat(c["what"], F.lit(":"), c["name"], F.lit(":"), F.coalesce(c["before"], F.lit("-")), F.lit(">"), F.coalesce(c["after"], F.lit("-"))))
    return df.withColumn("changes", F.array_join(text, ";"))


E1 = f""", h AS ({STATES}), s AS (SELECT scope, snapshot, row_number() OVER (PARTITION BY scope ORDER BY snapshot) AS n FROM (SELECT DISTINCT scope, snapshot FROM h)), l AS (SELECT scope, max(n) AS last FROM s GROUP BY scope),
 o AS (SELECT h.*, n FROM h JOIN s USING (scope, snapshot)), j AS (SELECT a.scope, a.node, a.snapshot, a.run_id, a.tested, a.n, b.run_id IS NOT NULL AS had, b.run_id AS old_run, b.tested AS old_tested, {CHANGES} AS changes
  FROM o a LEFT JOIN o b ON a.scope = b.scope AND a.node = b.node AND b.n = a.n - 1)
SELECT scope, node, CAST(snapshot AS INTEGER) AS snapshot, CASE WHEN had AND old_run = run_id THEN 'tested' ELSE 'built' END AS event, CASE WHEN had AND old_run = run_id THEN tested ELSE run_id END AS run_id,
 NOT had AS first, CASE WHEN had AND old_run <> run_id THEN changes ELSE '' END AS changes FROM j WHERE NOT had OR old_run <> run_id OR (tested IS NOT NULL AND tested IS DISTINCT FROM old_tested)
UNION ALL SELECT o.scope, o.node, CAST(s.snapshot AS INTEGER), 'dropped', NULL, false, '' FROM o JOIN s ON s.scope = o.scope AND s.n = o.n + 1 ANTI JOIN o x ON x.scope = o.scope AND x.node = o.node AND x.n = o.n + 1"""


@query("e1_node_events", oracle(E1, "ledger_nodes"))
def e1_events(spark, sf):
    s = states(spark, sf)
    return told(O.node_events(s.select("scope", "snapshot", "target"), s.drop("target")))


@query("j7_diff_nodes", oracle(f""", h AS ({STATES}), b AS (SELECT * FROM h WHERE snapshot = 1994), a AS (SELECT * FROM h WHERE snapshot = 1996)
SELECT * FROM (SELECT scope, node, CASE WHEN b.run_id IS NULL THEN 'added' WHEN a.run_id IS NULL THEN 'removed' WHEN b.run_id <> a.run_id THEN 'rebuilt' WHEN {CHANGES} <> '' THEN 'changed' END AS verdict,
 CASE WHEN b.run_id IS NOT NULL AND a.run_id IS NOT NULL THEN {CHANGES} ELSE '' END AS changes FROM b FULL JOIN a USING (scope, node)) WHERE verdict IS NOT NULL""", "ledger_nodes"))
def j7_nodes(spark, sf):
    s = states(spark, sf)
    return told(O.diff_nodes(s.where("snapshot = 1994"), s.where("snapshot = 1996")))
