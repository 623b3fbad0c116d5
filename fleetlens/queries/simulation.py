"""Simulated changes of columns over the column graph of the parts, with one node of unknown columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import simulation as S
from fleetlens.queries.lineage import COLS, EDGES, duck, graph

QUERIES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


# Fifty changed nodes: a rename adds c3, which nodes in four take from elsewhere too. Node 7 has no known columns, node -1 isn't there.
PROPOSED = """SELECT CAST(p_partkey AS STRING) AS node, 'c' || CAST(p_partkey % 3 AS STRING) AS column, CASE CAST(floor(p_partkey / 3) AS BIGINT) % 3 WHEN 0 THEN 'rename' WHEN 1 THEN 'drop' ELSE 'retype' END AS change,
 CASE WHEN CAST(floor(p_partkey / 3) AS BIGINT) % 3 = 0 THEN 'c3' END AS to_name FROM part WHERE p_partkey BETWEEN 5 AND 9 OR p_partkey % 40 = 21 UNION ALL SELECT '-1', 'c0', 'drop', NULL"""
OUTPUTS = f"SELECT relation AS node, column FROM ({COLS}) c WHERE relation <> '7'"
USES = f"""SELECT from_relation AS relation, from_column AS column, node, to_column FROM ({EDGES}) e
 UNION SELECT CAST(CAST(floor(p_partkey / 5) AS BIGINT) AS STRING), 'c3', CAST(p_partkey AS STRING), 'c2' FROM part WHERE p_partkey % 4 = 2"""
DECLARED = "SELECT CAST(CAST(floor(p_partkey / 7) AS BIGINT) AS STRING) AS relation, CAST(p_partkey AS STRING) AS node FROM part WHERE p_partkey % 17 = 3"
TESTS = "SELECT CAST(p_partkey AS STRING) AS node, 'not_null' AS test, 'c' || CAST(p_partkey % 3 AS STRING) AS column FROM part WHERE p_partkey % 2 = 0"


def sql(text: str) -> str:
    return duck(text).replace(", column", ', "column"')


SIM = f"""WITH RECURSIVE n AS (SELECT CAST(p_partkey AS STRING) AS node FROM part), outs AS ({sql(OUTPUTS)}), p AS (SELECT p.*, node IN (SELECT node FROM outs) AS listed FROM ({sql(PROPOSED)}) p SEMI JOIN n USING (node)),
 u AS (SELECT DISTINCT relation AS rel, "column" AS col, node, to_column FROM ({sql(USES)})), op AS (SELECT node FROM n WHERE CAST(node AS BIGINT) % 13 = 11), r0 AS (SELECT DISTINCT rel, node FROM u),
 rd AS (SELECT rel, node, bool_and(declared) OR CAST(node AS BIGINT) % 13 = 11 AS blind FROM (SELECT *, false AS declared FROM r0 UNION ALL SELECT relation, node, true FROM ({DECLARED})) GROUP BY rel, node),
 w AS (SELECT * FROM r0 WHERE CAST(node AS BIGINT) % 4 = 1),
 st AS (SELECT rel, 'any' AS k, NULL AS col, node, '' AS ncol, 'rows' AS nk, 'opaque' AS why FROM rd WHERE blind
  UNION ALL SELECT rel, 'rows', NULL, node, '', 'rows', 'rows' FROM rd WHERE NOT blind
  UNION ALL SELECT rel, 'added', NULL, node, '=', 'added', 'wildcard' FROM rd SEMI JOIN w USING (rel, node) WHERE NOT blind
  UNION ALL SELECT rel, 'added', NULL, node, '', 'rows', 'wildcard' FROM rd SEMI JOIN w USING (rel, node) SEMI JOIN (SELECT rel, node FROM u WHERE to_column IS NULL) s USING (rel, node) WHERE NOT blind
  UNION ALL SELECT DISTINCT rd.rel, 'added', o.col, rd.node, '', 'rows', 'name_capture' FROM rd JOIN u o ON o.node = rd.node AND o.rel <> rd.rel WHERE NOT blind
  UNION ALL SELECT rel, k, u.col, node, coalesce(to_column, ''), CASE WHEN to_column IS NULL THEN 'rows' ELSE 'modified' END, 'column' FROM u JOIN rd USING (rel, node) CROSS JOIN (SELECT unnest(['removed', 'modified']) AS k) ks WHERE NOT blind),
 ch AS (SELECT node AS rel, "column" AS col, CASE WHEN change = 'retype' THEN 'modified' ELSE 'removed' END AS k FROM p WHERE listed UNION SELECT node, to_name, 'added' FROM p WHERE listed AND change = 'rename' UNION SELECT node, '', 'rows' FROM p WHERE NOT listed
  UNION SELECT st.node, CASE WHEN ncol = '=' THEN ch.col ELSE ncol END, nk FROM ch JOIN st ON st.rel = ch.rel AND (st.k = 'any' OR st.k = ch.k) AND (st.col IS NULL OR st.col = ch.col)),
 rs AS (SELECT DISTINCT st.node, CASE WHEN ncol = '=' THEN ch.col ELSE ncol END AS col, nk, why, ch.rel AS up FROM ch JOIN st ON st.rel = ch.rel AND (st.k = 'any' OR st.k = ch.k) AND (st.col IS NULL OR st.col = ch.col)),
 dk AS (SELECT DISTINCT node AS up, true AS dark FROM rs SEMI JOIN op USING (node)),
 v AS (SELECT node, bool_or(nk = 'rows') AS rows_changed, bool_and(why = 'rows' AND dark IS NOT NULL) AS inferred, string_agg(DISTINCT CASE WHEN why = 'rows' AND dark THEN 'via_opaque' ELSE why END, ',' ORDER BY CASE WHEN why = 'rows' AND dark THEN 'via_opaque' ELSE why END) AS how,
  coalesce(string_agg(DISTINCT col, ',' ORDER BY col) FILTER (nk <> 'rows'), '') AS cols FROM rs LEFT JOIN dk USING (up) GROUP BY node),
 rm AS (SELECT DISTINCT node AS rel, "column" AS col FROM p WHERE change <> 'retype'), cp AS (SELECT u.rel, u.col, u.node FROM u SEMI JOIN w USING (rel, node) WHERE to_column = u.col),
 g AS (SELECT rel, col FROM rm UNION SELECT cp.node, g.col FROM g JOIN cp USING (rel, col)), br AS (SELECT DISTINCT u.node FROM g JOIN u USING (rel, col) ANTI JOIN cp ON cp.rel = u.rel AND cp.col = u.col AND cp.node = u.node WHERE u.node NOT IN (SELECT node FROM op)),
 dr AS (SELECT DISTINCT cp.node FROM g JOIN cp USING (rel, col) WHERE cp.node NOT IN (SELECT node FROM br)),
 ps AS (SELECT rel, node FROM rd SEMI JOIN op USING (node) UNION SELECT rel, node FROM w), un AS (SELECT DISTINCT node FROM g JOIN rd USING (rel) SEMI JOIN op USING (node) UNION SELECT ps.node FROM un JOIN ps ON ps.rel = un.node),
 own AS (SELECT node, string_agg(DISTINCT "column", ',' ORDER BY "column") AS cols FROM p GROUP BY node), al AS (SELECT node, string_agg(DISTINCT "column", ',' ORDER BY "column") AS cols FROM outs GROUP BY node),
 must AS (SELECT node, CASE WHEN v.how IS NULL THEN 'changed' WHEN node IN (SELECT node FROM br) THEN 'breaks' WHEN node IN (SELECT node FROM op) THEN 'unknown' WHEN node IN (SELECT node FROM dr) THEN 'loses_column' WHEN node IN (SELECT node FROM un) THEN 'unknown' ELSE 'affected' END AS verdict,
  own.cols IS NOT NULL AS changed_here, CASE WHEN node IN (SELECT node FROM op) THEN 'opaque' WHEN v.inferred THEN 'inferred' ELSE 'parsed' END AS lineage, coalesce(v.rows_changed, false) AS rows_changed,
  CASE WHEN v.how IS NULL THEN own.cols WHEN node IN (SELECT node FROM op) THEN NULL WHEN v.rows_changed THEN coalesce(al.cols, '') ELSE v.cols END AS columns, coalesce(v.how, '') AS how FROM own FULL JOIN v USING (node) LEFT JOIN al USING (node)),
 alone AS (SELECT rd.node, rel AS upstream, coalesce(cols, '') AS columns FROM (SELECT rel, string_agg(DISTINCT col, ',' ORDER BY col) FILTER (col <> '') AS cols FROM ch GROUP BY rel) c JOIN rd USING (rel) WHERE rd.node NOT IN (SELECT node FROM must))
"""


def simulated(spark, sf):
    graph(spark, sf)
    cols = spark.sql(COLS)
    uses = spark.sql(USES)
    reads = uses.select("relation", "node").distinct()
    proposed = spark.sql(PROPOSED).withColumnRenamed("to_name", "to")
    nodes = cols.select(F.col("relation").alias("node")).distinct()
    must, alone = S.simulate_changes(
        proposed, nodes, spark.sql(OUTPUTS), uses, reads, spark.sql(DECLARED), reads.where("cast(node as bigint) % 4 = 1"), nodes.where("cast(node as bigint) % 13 = 11")
    )
    return nodes, must, alone


flat = lambda c: F.array_join(c, ",").alias(c)


@query("g11_simulate_verdicts", SIM + "SELECT * FROM must")
def g11_verdicts(spark, sf):
    must = simulated(spark, sf)[1]
    return must.select("node", "verdict", "changed_here", "lineage", "rows_changed", flat("columns"), flat("how"))


@query("g11_left_alone", SIM + "SELECT * FROM alone")
def g11_alone(spark, sf):
    return simulated(spark, sf)[2].select("node", "upstream", flat("columns"))


@query("g11_simulation_totals", SIM + "SELECT (SELECT count(*) FROM must) AS must_run, (SELECT count(DISTINCT node) FROM alone) AS left_alone, (SELECT count(*) FROM n) - (SELECT count(*) FROM must) - (SELECT count(DISTINCT node) FROM alone) AS not_downstream")
def g11_totals(spark, sf):
    return S.simulation_totals(*simulated(spark, sf))


@query("g11_tests_to_run", SIM + f"SELECT t.* FROM ({sql(TESTS)}) t SEMI JOIN must USING (node)")
def g11_tests(spark, sf):
    _, must, _ = simulated(spark, sf)
    return S.tests_to_run(spark.sql(TESTS), must)
