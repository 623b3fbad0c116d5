"""Column lineage over a layered graph of relations made from the parts' numbers, and over shipments as edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.bindings import bind, oracle
from fleetlens.operators import lineage as L

QUERIES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


P = ("predicted_edges", "observed_edges")
J13 = """, p AS (SELECT node, source, output, bool_or(edge_type = 'DIRECT') AS direct FROM predicted_edges GROUP BY ALL), o AS (SELECT *, true AS seen FROM observed_edges), i AS (SELECT DISTINCT node, source, true AS ind FROM p WHERE NOT direct),
 j AS (SELECT node, coalesce(direct, false) AS has, coalesce(seen, false) AS seen, coalesce(ind, false) AS ind FROM p FULL JOIN o USING (node, source, output) LEFT JOIN i USING (node, source)),
 c AS (SELECT node, count(*) FILTER (has AND seen) AS matched, count(*) FILTER (NOT has AND seen AND ind) AS matched_indirect, count(*) FILTER (NOT has AND seen AND NOT ind) AS missing, count(*) FILTER (has AND NOT seen) AS unobserved FROM j GROUP BY node)
"""
RATIOS = "round(matched / nullif(matched + unobserved, 0)::DOUBLE, 6) AS precision, round((matched + matched_indirect) / nullif(matched + matched_indirect + missing, 0)::DOUBLE, 6) AS recall"


@query("j13_compare_observed", oracle(J13 + f"SELECT *, {RATIOS} FROM c", *P))
def j13(spark, sf):
    return L.compare_observed(bind(spark, sf, P[0]), bind(spark, sf, P[1]))


@query("a10_comparison_totals", oracle(J13 + f", t AS (SELECT CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(matched_indirect) AS BIGINT) AS matched_indirect, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(unobserved) AS BIGINT) AS unobserved FROM c) SELECT *, {RATIOS} FROM t", *P))
def a10(spark, sf):
    return L.comparison_totals(j13(spark, sf))


@query("g20_with_observed", oracle("SELECT * FROM predicted_edges UNION ALL SELECT node, source, output, 'DIRECT' FROM observed_edges WHERE node % 7 = 3", *P))
def g20(spark, sf):
    p, o = bind(spark, sf, P[0]), bind(spark, sf, P[1])
    return L.with_observed(p, o, p.where("node % 7 = 3").select("node").distinct(), trust=True)[0]


@query("u3_outside_project", oracle("SELECT DISTINCT node FROM observed_edges WHERE node NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20)", *P))
def u3(spark, sf):
    inside = bind(spark, sf, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("node"))
    return bind(spark, sf, P[1]).select("node").subtract(inside)


@query("j1_consumer_index", oracle("SELECT source % 50 AS relation, source AS \"column\", count(*) AS uses, count(DISTINCT node) AS nodes FROM predicted_edges GROUP BY ALL", *P))
def j1(spark, sf):
    e = bind(spark, sf, P[0]).withColumns({"relation": F.col("source") % 50, "column": F.col("source")})
    return L.consumer_index(e, e, e)[0]


@query("j1_readers", oracle("SELECT DISTINCT node, source % 50 AS relation FROM predicted_edges UNION SELECT DISTINCT node, output + 100 FROM observed_edges", *P))
def j1r(spark, sf):
    e = bind(spark, sf, P[0]).withColumns({"relation": F.col("source") % 50, "column": F.col("source")})
    return L.consumer_index(e, e, bind(spark, sf, P[1]).select("node", (F.col("output") + 100).alias("relation")))[1]


@query("j2_inputs_of", oracle("SELECT node, output, source FROM predicted_edges WHERE edge_type = 'DIRECT' UNION SELECT d.node, d.output, i.source FROM (SELECT DISTINCT node, output FROM predicted_edges WHERE edge_type = 'DIRECT') d JOIN (SELECT DISTINCT node, source FROM predicted_edges WHERE edge_type = 'INDIRECT' AND source % 40 = 1) i USING (node)", *P))
def j2(spark, sf):
    e = bind(spark, sf, P[0])
    return L.inputs_of(e.where("edge_type = 'DIRECT'").select("node", "output", "source"), e.where("edge_type = 'INDIRECT' and source % 40 = 1").select("node", "source").distinct())


@query("j3_unresolved_readers", oracle("SELECT DISTINCT node FROM predicted_edges WHERE source % 300 = 7", *P))
def j3(spark, sf):
    e = bind(spark, sf, P[0]).select("node", (F.col("source") % 50).alias("relation"), F.col("source").alias("column"))
    return L.unresolved_readers(e, e.where("column % 300 = 7").select("relation", "column").distinct())


# A column graph: node n (a part) has columns c0..c2 and reads node n // 3 and n // 2; roots are below 2.
COLS = "SELECT CAST(p_partkey AS STRING) AS relation, 'c' || CAST(i AS STRING) AS column, i AS ordinal FROM part CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) x"
EDGES = """SELECT CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING) AS from_relation, 'c' || CAST((p_partkey + i) % 3 AS STRING) AS from_column, CAST(p_partkey AS STRING) AS node, 'c' || CAST(i AS STRING) AS to_column FROM part CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1) x WHERE p_partkey > 1
 UNION SELECT CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS STRING), 'c2', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'c2' END FROM part WHERE p_partkey > 1"""
SEEDS = "SELECT CAST(p_partkey AS STRING) AS relation, 'c' || CAST(p_partkey % 3 AS STRING) AS column FROM part WHERE p_partkey BETWEEN 5 AND 9"


def duck(sql: str) -> str:
    return sql.replace("AS column", 'AS "column"')


def graph(spark, sf):
    bind(spark, sf, "dag_nodes")  # registers the tables
    return spark.sql(COLS), spark.sql(EDGES), spark.sql(SEEDS)


BASE = f"WITH RECURSIVE cols AS ({duck(COLS)}), e AS ({EDGES}), seeds AS ({duck(SEEDS)})"
ALLE = ', ex AS (SELECT from_relation, from_column, node AS relation, to_column AS col FROM e WHERE to_column IS NOT NULL UNION SELECT from_relation, from_column, node, c."column" FROM e JOIN cols c ON c.relation = e.node WHERE to_column IS NULL)'


@query("g5_reaches", BASE + ALLE + ', r AS (SELECT relation, "column" AS col FROM seeds UNION SELECT ex.relation, ex.col FROM r JOIN ex ON ex.from_relation = r.relation AND ex.from_column = r.col) SELECT relation, col AS "column" FROM r')
def g5(spark, sf):
    cols, e, s = graph(spark, sf)
    return L.reaches(s, e, cols)


UPS = "SELECT CAST(p_partkey AS STRING) AS relation, 'c0' AS column FROM part WHERE p_partkey % 50 = 17"


@query("g6_value_sources", BASE + f""", d AS (SELECT * FROM e WHERE to_column IS NOT NULL), u AS (SELECT relation || '.' || "column" AS seed, relation, "column" AS col FROM ({duck(UPS)}) UNION SELECT seed, d.from_relation, d.from_column FROM u JOIN d ON d.node = u.relation AND d.to_column = u.col)
 SELECT seed, relation, col AS "column" FROM u ANTI JOIN (SELECT node AS relation, to_column AS col FROM d) USING (relation, col) WHERE seed <> relation || '.' || col""")
def g6(spark, sf):
    _, e, _ = graph(spark, sf)
    return L.value_sources(spark.sql(UPS), e)


OUT_B = "SELECT relation AS node, column, 'd' || column AS digest, ordinal FROM cols WHERE CAST(relation AS BIGINT) % 7 <> 1 OR column <> 'c1'"
OUT_A = "SELECT relation AS node, column, CASE WHEN CAST(relation AS BIGINT) % 9 = 2 THEN 'x' ELSE 'd' || column END AS digest, CASE WHEN CAST(relation AS BIGINT) % 11 = 3 THEN 2 - ordinal ELSE ordinal END AS ordinal FROM cols WHERE CAST(relation AS BIGINT) % 8 <> 1 OR column <> 'c2'"
q = lambda s: s.replace("column,", '"column",').replace("|| column", '|| "column"').replace("OR column", 'OR "column"')


@query("g8_lineage_diff", BASE + f""" SELECT * FROM (SELECT node, "column", CASE WHEN b.digest IS NULL THEN 'added' WHEN a.digest IS NULL THEN 'removed' WHEN b.digest <> a.digest OR b.ordinal <> a.ordinal THEN 'modified' END AS change FROM ({q(OUT_B)}) b FULL JOIN ({q(OUT_A)}) a USING (node, "column")) WHERE change IS NOT NULL""")
def g8(spark, sf):
    graph(spark, sf)[0].createOrReplaceTempView("cols")
    return L.lineage_diff(spark.sql(OUT_B), spark.sql(OUT_A))


CHG = "SELECT relation, column, CASE CAST(relation AS BIGINT) % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'modified' END AS kind FROM ({s})"
NODE = "CAST({c} AS BIGINT)"


def impact_parts(spark, sf):
    cols, e, s = graph(spark, sf)
    uses = e.select(F.col("from_relation").alias("relation"), F.col("from_column").alias("column"), "node", "to_column")
    readers = e.select(F.col("from_relation").alias("relation"), "node").distinct()
    wild = readers.where("cast(node as bigint) % 4 = 1")
    opaque = cols.where("cast(relation as bigint) % 13 = 11").select(F.col("relation").alias("node")).distinct()
    changes = s.withColumn("kind", F.expr("CASE CAST(relation AS BIGINT) % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'modified' END"))
    return changes, uses, readers, wild, opaque


IMP = BASE + """, u AS (SELECT from_relation AS rel, from_column AS col, node, to_column FROM e), rd AS (SELECT DISTINCT from_relation AS rel, node FROM e), w AS (SELECT * FROM rd WHERE CAST(node AS BIGINT) % 4 = 1), op AS (SELECT DISTINCT relation AS node FROM cols WHERE CAST(relation AS BIGINT) % 13 = 11),
 st AS (SELECT DISTINCT rd.rel, 'any' AS k, NULL AS col, rd.node AS nrel, '' AS ncol, 'rows' AS nk, true AS blind FROM rd JOIN op USING (node)
  UNION ALL SELECT rd.rel, 'rows', NULL, rd.node, '', 'rows', false FROM rd ANTI JOIN op USING (node)
  UNION ALL SELECT w.rel, 'added', NULL, w.node, '=', 'added', false FROM w ANTI JOIN op USING (node)
  UNION ALL SELECT rd.rel, 'added', o.col, rd.node, '', 'rows', false FROM rd JOIN u o ON o.node = rd.node AND o.rel <> rd.rel ANTI JOIN op ON op.node = rd.node
  UNION ALL SELECT u.rel, k, u.col, u.node, coalesce(to_column, ''), CASE WHEN to_column IS NULL THEN 'rows' ELSE 'modified' END, false FROM u, (SELECT unnest(['removed', 'modified']) AS k) ANTI JOIN op ON op.node = u.node),
 ch AS (SELECT relation AS rel, "column" AS col, CASE CAST(relation AS BIGINT) % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'modified' END AS k FROM seeds UNION SELECT st.nrel, CASE WHEN st.ncol = '=' THEN ch.col ELSE st.ncol END, st.nk FROM ch JOIN st ON st.rel = ch.rel AND (st.k = 'any' OR st.k = ch.k) AND (st.col IS NULL OR st.col = ch.col))
"""


@query("g9_impact", IMP + ' SELECT rel AS relation, col AS "column", k AS kind FROM ch')
def g9(spark, sf):
    return L.impact(*impact_parts(spark, sf)).drop("reason")


@query("u2_pruned_readers", IMP + ", s AS (SELECT relation, \"column\" AS col FROM seeds), im AS (SELECT DISTINCT rel FROM ch EXCEPT SELECT relation FROM s WHERE relation NOT IN (SELECT nrel FROM st JOIN ch ON st.rel = ch.rel AND (st.k = 'any' OR st.k = ch.k) AND (st.col IS NULL OR st.col = ch.col))) SELECT node, count(*) AS unused FROM s JOIN rd ON rd.rel = s.relation WHERE node NOT IN (SELECT rel FROM im) GROUP BY node")
def u2(spark, sf):
    p = impact_parts(spark, sf)
    return L.pruned_readers(p[0], p[2], L.impact(*p))


BRK = IMP.split(", st AS")[0] + """, cp AS (SELECT u.rel, u.col, u.node FROM u JOIN w ON w.rel = u.rel AND w.node = u.node WHERE to_column = u.col), g AS (SELECT relation AS rel, "column" AS col FROM seeds UNION SELECT cp.node, g.col FROM g JOIN cp ON cp.rel = g.rel AND cp.col = g.col),
 br AS (SELECT DISTINCT u.node FROM g JOIN u ON u.rel = g.rel AND u.col = g.col ANTI JOIN cp ON cp.rel = u.rel AND cp.col = u.col AND cp.node = u.node WHERE u.node NOT IN (SELECT node FROM op)), dr AS (SELECT DISTINCT cp.node FROM g JOIN cp ON cp.rel = g.rel AND cp.col = g.col WHERE cp.node NOT IN (SELECT node FROM br)),
 ps AS (SELECT rel, node FROM rd WHERE node IN (SELECT node FROM op) UNION SELECT rel, node FROM w), un AS (SELECT DISTINCT rd.node FROM g JOIN rd ON rd.rel = g.rel WHERE rd.node IN (SELECT node FROM op) UNION SELECT ps.node FROM un JOIN ps ON ps.rel = un.node)
 SELECT node, 'broken' AS verdict FROM br UNION ALL SELECT node, 'dropped' FROM dr UNION ALL SELECT node, 'unknown' FROM un WHERE node NOT IN (SELECT node FROM br UNION ALL SELECT node FROM dr)"""


def break_parts(spark, sf):
    _, uses, readers, wild, opaque = impact_parts(spark, sf)
    copies = uses.where("to_column = column").join(wild, ["relation", "node"], "left_semi").select("relation", "column", "node")
    return graph(spark, sf)[2], uses, readers, copies, wild, opaque


@query("g10_breaks", BRK)
def g10(spark, sf):
    return L.breaks(*break_parts(spark, sf))


VERDICTS = IMP + BRK[len(IMP.split(", st AS")[0]) :].replace("\n SELECT node, 'broken'", ", vd AS (SELECT node, 'broken'") + """),
 im AS (SELECT rel AS node, bool_or(k = 'rows') AS rows_change, bool_or(k = 'modified') AS values_change FROM (SELECT * FROM ch EXCEPT SELECT relation, "column", CASE CAST(relation AS BIGINT) % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'modified' END FROM seeds) GROUP BY rel)
 SELECT node, CASE WHEN verdict IS NOT NULL THEN verdict WHEN rows_change THEN 'rows_change' WHEN values_change THEN 'values_change' ELSE 'gains_columns' END AS verdict FROM im FULL JOIN vd USING (node)"""


@query("g11_simulate", VERDICTS)
def g11(spark, sf):
    p = impact_parts(spark, sf)
    return L.simulate(p[0], L.impact(*p), L.breaks(*break_parts(spark, sf)))


ONE = "SELECT '40' AS relation, 'c1' AS column"


@query("g27_downstream_uses", BASE + """, n AS (SELECT DISTINCT from_relation || '.' || from_column AS at_, CASE WHEN to_column IS NULL THEN node || '.*' ELSE node || '.' || to_column END AS nx, to_column IS NULL AS ends FROM e),
 p AS (SELECT '40.c1' AS at_, ['40.c1'] AS path, false AS ends UNION ALL SELECT n.nx, list_append(path, n.nx), n.ends FROM p JOIN n USING (at_) WHERE NOT p.ends AND NOT list_contains(path, n.nx)) SELECT array_to_string(path, '>') AS path, CAST(len(path) AS INTEGER) AS steps FROM p WHERE len(path) > 1""")
def g27(spark, sf):
    _, e, _ = graph(spark, sf)
    return L.downstream_uses(spark.sql(ONE), e)


@query("j4_missing_columns", BASE + """, rd AS (SELECT node, from_relation AS relation, CASE WHEN CAST(node AS BIGINT) % 10 = 3 THEN 'old_' || from_column ELSE upper(from_column) END AS "column" FROM e WHERE to_column IS NOT NULL), kn AS (SELECT DISTINCT relation FROM cols WHERE CAST(relation AS BIGINT) % 6 <> 1)
 SELECT node, relation, "column", CASE WHEN CAST(relation AS BIGINT) % 2 = 0 THEN replace("column", 'old_', '') ELSE '' END AS candidates FROM (SELECT DISTINCT * FROM rd) WHERE relation IN (SELECT relation FROM kn) AND starts_with("column", 'old_')""")
def j4(spark, sf):
    cols, e, _ = graph(spark, sf)
    reads = e.where("to_column is not null").select("node", F.col("from_relation").alias("relation"), F.expr("CASE WHEN CAST(node AS BIGINT) % 10 = 3 THEN 'old_' || from_column ELSE upper(from_column) END").alias("column"))
    identity = cols.where("cast(relation as bigint) % 2 = 0").select("relation", "column", F.concat(F.lit("OLD_"), "column").alias("from_column"))
    return L.missing_columns(reads, cols, cols.where("cast(relation as bigint) % 6 <> 1").select("relation").distinct(), identity)


@query("s14_openlineage_events")
def s14(spark, sf):
    e = bind(spark, sf, P[0])
    return L.openlineage_events(e.select("node", (F.col("source") % 50).alias("relation")), e, e.where("node % 7 = 3").select("node").distinct())
