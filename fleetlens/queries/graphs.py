"""Node graphs and the planner."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.bindings import bind, oracle
from fleetlens.operators import graphs as G
from fleetlens.plans.fixpoint import layers

QUERIES = {}
NOW = "timestamp '2024-06-30 00:00:00'"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def dag(spark, sf):
    return bind(spark, sf, "dag_nodes"), bind(spark, sf, "dag_edges")


LAYERS = """, lay AS (SELECT scope, node, 0 AS depth FROM dag_nodes WHERE node = 0 UNION SELECT e.scope, e.child, depth + 1 FROM lay JOIN dag_edges e ON e.scope = lay.scope AND e.parent = lay.node),
 lays AS (SELECT scope, node, max(depth) AS depth FROM lay GROUP BY ALL)
"""


@query("g1_layers", oracle(LAYERS + "SELECT * FROM lays", "dag_nodes", "dag_edges"))
def g1(spark, sf):
    return layers(*dag(spark, sf))


DOWN = """, reach AS (SELECT scope, node, 0 AS h FROM dag_nodes WHERE node % 97 = 5 UNION SELECT e.scope, e.child, h + 1 FROM reach r JOIN dag_edges e ON e.scope = r.scope AND e.parent = r.node {limit})
"""


@query("g2_closure_down", oracle(DOWN.format(limit="") + "SELECT scope, node, min(h) AS hops FROM reach GROUP BY ALL", "dag_nodes", "dag_edges"))
def g2(spark, sf):
    n, e = dag(spark, sf)
    return G.closure(n.where("node % 97 = 5"), e)


@query("g2_closure_up_limited", oracle(""", reach AS (SELECT scope, node, 0 AS h FROM dag_nodes WHERE node % 97 = 5 UNION SELECT e.scope, e.parent, h + 1 FROM reach r JOIN dag_edges e ON e.scope = r.scope AND e.child = r.node WHERE h < 3)
 SELECT scope, node, min(h) AS hops FROM reach GROUP BY ALL""", "dag_nodes", "dag_edges"))
def g2u(spark, sf):
    n, e = dag(spark, sf)
    return G.closure(n.where("node % 97 = 5"), e, "up", 3)


@query("g3_find_cycles")
def g3(spark, sf):
    n, e = dag(spark, sf)
    back = e.where("parent > 0 and child % 50 = 7").select("scope", F.col("child").alias("parent"), F.col("parent").alias("child"))
    return G.find_cycles(n, e.unionByName(back)).select("scope", F.array_join(F.transform("cycle", lambda x: x.cast("string")), ">").alias("cycle"))


@query("g4_duplicate_ids", "SELECT 'all' AS scope, l_orderkey AS node, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def g4(spark, sf):
    return G.duplicate_ids(bind(spark, sf, "lineitem").select(F.lit("all").alias("scope"), F.col("l_orderkey").alias("node")))


SPECS = "SELECT scope, CASE node % 4 WHEN 0 THEN CAST(node AS STRING) WHEN 1 THEN '+' || CAST(node AS STRING) WHEN 2 THEN CAST(node AS STRING) || '+' ELSE '+' || CAST(node + 10000000 AS STRING) || '+' END AS spec FROM dag_nodes WHERE node % 211 IN (1, 2, 3, 4)"


@query("p3_select", oracle(f""", specs AS ({SPECS}), s AS (SELECT scope, CAST(trim(spec, '+') AS BIGINT) AS node, starts_with(spec, '+') AS up, suffix(spec, '+') AS down FROM specs), hit AS (SELECT s.* FROM s JOIN dag_nodes USING (scope, node)),
 u AS (SELECT scope, node FROM hit WHERE up UNION SELECT e.scope, e.parent FROM u JOIN dag_edges e ON e.scope = u.scope AND e.child = u.node), d AS (SELECT scope, node FROM hit WHERE down UNION SELECT e.scope, e.child FROM d JOIN dag_edges e ON e.scope = d.scope AND e.parent = d.node)
 SELECT scope, node FROM hit UNION SELECT * FROM u UNION SELECT * FROM d""", "dag_nodes", "dag_edges"))
def p3(spark, sf):
    n, e = dag(spark, sf)
    n.createOrReplaceTempView("dag_nodes")
    return G.select(n, e, spark.sql(SPECS))[0]


@query("p3_unmatched_specs", oracle(f", specs AS ({SPECS}) SELECT scope, spec FROM specs WHERE CAST(trim(spec, '+') AS BIGINT) >= 10000000", "dag_nodes", "dag_edges"))
def p3u(spark, sf):
    n, e = dag(spark, sf)
    n.createOrReplaceTempView("dag_nodes")
    return G.select(n, e, spark.sql(SPECS))[1]


@query("p4_select_sources", oracle(f""", specs AS ({SPECS}), u AS (SELECT scope, CAST(trim(spec, '+') AS BIGINT) AS node FROM specs JOIN dag_nodes USING (scope) WHERE starts_with(spec, '+') AND dag_nodes.node = CAST(trim(spec, '+') AS BIGINT) UNION SELECT e.scope, e.parent FROM u JOIN dag_edges e ON e.scope = u.scope AND e.child = u.node)
 SELECT scope, node FROM u WHERE node < 3""", "dag_nodes", "dag_edges"))
def p4(spark, sf):
    n, e = dag(spark, sf)
    n.createOrReplaceTempView("dag_nodes")
    return G.select_sources(n, e, n.where("node < 3"), spark.sql(SPECS))


@query("g7_sources_read", oracle(""", r AS (SELECT scope, node AS source, node AS at_ FROM dag_nodes WHERE node BETWEEN 1 AND 4 UNION SELECT e.scope, source, e.child FROM r JOIN dag_edges e ON e.scope = r.scope AND e.parent = r.at_)
 SELECT scope, at_ AS node, source FROM r WHERE at_ <> source""", "dag_nodes", "dag_edges"))
def g7(spark, sf):
    n, e = dag(spark, sf)
    return G.sources_read(e, n.where("node between 1 and 4"))


@query("r9_focus", oracle(""", r AS (SELECT scope, node, 0 AS h FROM dag_nodes WHERE node % 499 = 17 UNION SELECT e.scope, e.b, h + 1 FROM r JOIN (SELECT scope, parent AS a, child AS b FROM dag_edges UNION SELECT scope, child, parent FROM dag_edges) e ON e.scope = r.scope AND e.a = r.node WHERE h < 2)
 SELECT scope, node, min(h) AS hops FROM r GROUP BY ALL""", "dag_nodes", "dag_edges"))
def r9(spark, sf):
    n, e = dag(spark, sf)
    return G.neighbourhood(n.where("node % 499 = 17"), e, 2)


@query("g23_built_lanes", oracle(""", b AS (SELECT scope, node FROM dag_nodes WHERE node % 3 <> 1), e AS (SELECT d.* FROM dag_edges d JOIN b p ON p.scope = d.scope AND p.node = d.parent JOIN b c ON c.scope = d.scope AND c.node = d.child),
 l AS (SELECT scope, node, 0 AS lane FROM b ANTI JOIN (SELECT scope, child AS node FROM e) USING (scope, node) UNION SELECT e.scope, e.child, lane + 1 FROM l JOIN e ON e.scope = l.scope AND e.parent = l.node) SELECT scope, node, max(lane) AS lane FROM l GROUP BY ALL""", "dag_nodes", "dag_edges"))
def g23(spark, sf):
    n, e = dag(spark, sf)
    return G.lanes(n.where("node % 3 <> 1"), e)


@query("g26_lineage_waves", oracle(LAYERS + "SELECT scope, depth AS wave, count(*) AS nodes FROM lays GROUP BY ALL", "dag_nodes", "dag_edges"))
def g26(spark, sf):
    return layers(*dag(spark, sf)).groupBy("scope", F.col("depth").alias("wave")).agg(F.count(F.lit(1)).alias("nodes"))


@query("t1_plan_order", oracle(LAYERS + "SELECT scope, node, CAST(row_number() OVER (PARTITION BY scope ORDER BY depth, node) AS INTEGER) AS place FROM lays", "dag_nodes", "dag_edges"))
def t1(spark, sf):
    from pyspark.sql import Window

    return layers(*dag(spark, sf)).select("scope", "node", F.row_number().over(Window.partitionBy("scope").orderBy("depth", "node")).alias("place"))


TRAIL = DOWN.format(limit="") + """, near AS (SELECT scope, node, min(h) AS hops FROM reach GROUP BY ALL), steps AS (SELECT n.scope, hops, e.parent, e.child FROM near n JOIN dag_edges e ON e.scope = n.scope AND e.parent = n.node)
"""


@query("t4_trail", oracle(TRAIL + "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY scope ORDER BY hops, parent, child) AS INTEGER) AS step FROM steps) WHERE step <= 200", "dag_nodes", "dag_edges"))
def t4(spark, sf):
    n, e = dag(spark, sf)
    return G.trail(n.where("node % 97 = 5"), e)[0]


# What can be said of each node alone, as expressions of its number that both engines know.
NODES = """SELECT scope, node, node % 401 = 7 AS full_refresh, node % 29 <> 1 AS recorded, node % 83 <> 2 AS same_target, node % 61 = 3 AS fp_error, node % 37 = 4 AS fp_changed, node % 53 = 5 AS policy_blocked,
 node % 2 = 0 AS self_contained, timestamp '2024-06-29 00:00:00' AS built_at, CASE WHEN node % 11 = 0 THEN 172800 ELSE 0 END AS lag_s, CASE WHEN node % 7 = 0 THEN 'all' ELSE 'any' END AS quorum,
 CASE node % 13 WHEN 1 THEN 'missing' WHEN 2 THEN 'unverified' WHEN 3 THEN 'unchecked' ELSE 'present' END AS relation, node % 26 = 3 AS checks_required, CASE WHEN node % 5 = 0 THEN 2 ELSE 0 END AS source_inputs,
 CASE WHEN node % 15 = 0 THEN 1 ELSE 0 END AS source_new, CASE WHEN node % 35 = 10 THEN 1 ELSE 0 END AS source_bad FROM dag_nodes WHERE node % 199 <> 150"""
EDGES = "SELECT scope, parent, child, (parent + child) % 17 <> 0 AS recorded FROM dag_edges WHERE child % 199 <> 150"


def planner(spark, sf):
    n, e = dag(spark, sf)
    n.createOrReplaceTempView("dag_nodes")
    e.createOrReplaceTempView("dag_edges")
    return spark.sql(NODES), spark.sql(EDGES)


# Depth of the planner's graph, then one row for each level, as lists of decisions that the next level reads.
PLAN = f""", n AS ({NODES}), e AS ({EDGES}), known AS (SELECT e.* FROM e SEMI JOIN n ON n.scope = e.scope AND n.node = e.parent),
 l0 AS (SELECT scope, node, 0 AS depth FROM n ANTI JOIN (SELECT scope, child AS node FROM known) USING (scope, node) UNION SELECT k.scope, k.child, depth + 1 FROM l0 JOIN known k ON k.scope = l0.scope AND k.parent = l0.node),
 lay AS (SELECT scope, node, max(depth) AS depth FROM l0 GROUP BY ALL),
 inp AS (SELECT n.*, depth, (SELECT count(*) FROM e WHERE e.scope = n.scope AND e.child = n.node) AS parents,
   EXISTS (SELECT 1 FROM e ANTI JOIN n m ON m.scope = e.scope AND m.node = e.parent WHERE e.scope = n.scope AND e.child = n.node) AS unknown_parent,
   (SELECT list({{'p': parent, 'r': recorded}}) FROM known k WHERE k.scope = n.scope AND k.child = n.node) AS ps FROM n JOIN lay USING (scope, node)),
 walk AS (SELECT scope, -1 AS depth, MAP {{CAST(-1 AS BIGINT): {{'a': '', 'r': ''}}}} AS done, CAST(NULL AS STRUCT(node BIGINT, action VARCHAR, reason VARCHAR, depth INTEGER)[]) AS rows FROM (SELECT DISTINCT scope FROM n)
  UNION ALL
  SELECT scope, d, map_concat(done, map_from_entries(list_transform(out, lambda x: {{'k': x.node, 'v': {{'a': x.action, 'r': x.reason}}}}))), out FROM (
   SELECT scope, any_value(d) AS d, any_value(done) AS done, list({{'node': node, 'action': CASE WHEN r0 IN ('quorum_not_met', 'within_lag_tolerance', 'unchanged') AND NOT (relation = 'missing' OR relation = 'unverified' OR (relation = 'unchecked' AND checks_required)) THEN 'REUSE' WHEN r0 IN ('quorum_not_met', 'within_lag_tolerance', 'unchanged') THEN 'BUILD' ELSE 'BUILD' END,
    'reason': CASE WHEN r0 IN ('quorum_not_met', 'within_lag_tolerance', 'unchanged') AND relation = 'missing' THEN 'relation_missing' WHEN r0 IN ('quorum_not_met', 'within_lag_tolerance', 'unchanged') AND (relation = 'unverified' OR (relation = 'unchecked' AND checks_required)) THEN 'relation_unverified' ELSE r0 END, 'depth': depth}}) AS out
   FROM (SELECT *, CASE WHEN full_refresh THEN 'full_refresh_requested' WHEN NOT recorded THEN 'never_built' WHEN NOT same_target THEN 'target_changed' WHEN fp_error THEN 'code_evidence_incomplete' WHEN fp_changed THEN 'code_changed'
     WHEN code_parent THEN 'upstream_code_changed' WHEN fresh_parent THEN 'upstream_full_refresh' WHEN unknown_parent THEN 'unknown_dependency' WHEN policy_blocked THEN 'policy_blocks_reuse'
     WHEN parents + source_inputs = 0 AND NOT self_contained THEN 'missing_data_evidence' WHEN source_bad > 0 OR bad_parent THEN 'missing_data_evidence'
     WHEN new > 0 AND quorum = 'all' AND new < parents + source_inputs THEN 'quorum_not_met' WHEN new > 0 AND lag_s > 0 AND epoch({NOW}) < epoch(built_at) + lag_s THEN 'within_lag_tolerance' WHEN new > 0 THEN 'new_upstream_data' ELSE 'unchanged' END AS r0
    FROM (SELECT i.*, w.done, w.depth + 1 AS d, source_new + len(list_filter(coalesce(ps, []), lambda x: done[x.p].a = 'BUILD')) AS new,
      len(list_filter(coalesce(ps, []), lambda x: done[x.p].a = 'BUILD' AND done[x.p].r IN ('never_built', 'code_evidence_incomplete', 'code_changed', 'upstream_code_changed', 'unknown_dependency'))) > 0 AS code_parent,
      len(list_filter(coalesce(ps, []), lambda x: done[x.p].r = 'full_refresh_requested')) > 0 AS fresh_parent, len(list_filter(coalesce(ps, []), lambda x: done[x.p].a = 'REUSE' AND NOT x.r)) > 0 AS bad_parent
     FROM walk w JOIN inp i ON i.scope = w.scope AND i.depth = w.depth + 1)) GROUP BY scope)),
 planned AS (SELECT scope, x.node AS node, x.action AS action, x.reason AS reason, x.depth AS depth FROM (SELECT scope, unnest(rows) AS x FROM walk))
"""


@query("g12_plan", oracle(PLAN + "SELECT * FROM planned", "dag_nodes", "dag_edges"))
def g12(spark, sf):
    n, e = planner(spark, sf)
    return G.plan(n, e, F.expr(NOW))


@query("a14_plan_counts", oracle(PLAN + "SELECT scope, action, reason, count(*) AS n FROM planned GROUP BY ALL", "dag_nodes", "dag_edges"))
def a14(spark, sf):
    return G.plan_counts(g12(spark, sf))


# The same nodes, with relations that aren't looked at and nothing refreshed in full.
FREE = f"SELECT * REPLACE (false AS full_refresh, 'present' AS relation) FROM ({NODES})"


@query("g13_reuse_candidates", oracle(PLAN.replace(NODES, FREE) + "SELECT scope, node FROM planned WHERE action = 'REUSE'", "dag_nodes", "dag_edges"))
def g13(spark, sf):
    n, e = planner(spark, sf)
    return G.reuse_candidates(n, e, F.expr(NOW))


ROOTS = PLAN + """, b AS (SELECT scope, node, reason FROM planned WHERE action = 'BUILD'),
 ca AS (SELECT DISTINCT e.scope, e.child AS node, e.parent AS cause FROM e JOIN b c ON c.scope = e.scope AND c.node = e.child JOIN b p ON p.scope = e.scope AND p.node = e.parent WHERE (c.reason = 'upstream_full_refresh' AND p.reason = 'full_refresh_requested') OR c.reason = 'new_upstream_data'
  OR (c.reason = 'upstream_code_changed' AND p.reason IN ('never_built', 'code_evidence_incomplete', 'code_changed', 'upstream_code_changed', 'unknown_dependency'))),
 wk AS (SELECT scope, node, node AS at_ FROM b UNION SELECT wk.scope, wk.node, ca.cause FROM wk JOIN ca ON ca.scope = wk.scope AND ca.node = wk.at_)
 SELECT wk.scope, wk.node, at_ AS root, b.reason AS root_reason FROM wk JOIN b ON b.scope = wk.scope AND b.node = at_ WHERE NOT EXISTS (SELECT 1 FROM ca WHERE ca.scope = wk.scope AND ca.node = wk.at_)"""


@query("g14_explain", oracle(ROOTS, "dag_nodes", "dag_edges"))
def g14(spark, sf):
    _, e = planner(spark, sf)
    return G.explain(g12(spark, sf), e)


# A plan that is an expression of the node's number, for the operators that read plans.
SIMPLE = "SELECT scope, node, CASE WHEN node % 3 = 0 OR node % 7 = 0 THEN 'BUILD' ELSE 'REUSE' END AS action FROM dag_nodes"
RETRY = "SELECT scope, CASE WHEN node % 100 = 0 THEN node + 10000000 ELSE node END AS node FROM dag_nodes WHERE node % 7 = 0 OR node % 10 = 0"


def simple(spark, sf):
    n, e = dag(spark, sf)
    n.createOrReplaceTempView("dag_nodes")
    return spark.sql(SIMPLE), e, spark.sql(RETRY), n.where("node % 2 = 0")


@query("g16_split_retry", oracle(f""", p AS ({SIMPLE}), r AS (SELECT DISTINCT * FROM ({RETRY})), want AS (SELECT p.scope, p.node FROM p JOIN r USING (scope, node) WHERE action = 'BUILD'), blk AS (SELECT p.scope, p.node FROM p ANTI JOIN r USING (scope, node) WHERE action = 'BUILD'),
 held AS (SELECT w.scope, w.node FROM blk b JOIN dag_edges e ON e.scope = b.scope AND e.parent = b.node JOIN want w ON w.scope = e.scope AND w.node = e.child UNION SELECT w.scope, w.node FROM held h JOIN dag_edges e ON e.scope = h.scope AND e.parent = h.node JOIN want w ON w.scope = e.scope AND w.node = e.child)
 SELECT *, 'retried' AS verdict FROM want ANTI JOIN held USING (scope, node) UNION ALL SELECT *, 'held_back' FROM held UNION ALL SELECT p.scope, p.node, 'reused' FROM p JOIN r USING (scope, node) WHERE action = 'REUSE'
 UNION ALL SELECT scope, node, 'changed_since' FROM blk WHERE node % 2 = 0 UNION ALL SELECT scope, node, 'not_planned' FROM r ANTI JOIN p USING (scope, node)""", "dag_nodes", "dag_edges"))
def g16(spark, sf):
    p, e, r, b = simple(spark, sf)
    return G.split_retry(p, e, r, b)


@query("j27_unbuilt_parents", oracle(f""", p AS ({SIMPLE}), r AS (SELECT scope, node FROM dag_nodes WHERE node % 5 = 0) SELECT e.scope, e.parent, count(*) AS readers FROM dag_edges e JOIN p ON p.scope = e.scope AND p.node = e.parent JOIN r ON r.scope = e.scope AND r.node = e.child
 WHERE p.action = 'BUILD' AND e.parent % 5 <> 0 GROUP BY ALL""", "dag_nodes", "dag_edges"))
def j27(spark, sf):
    p, e, _, _ = simple(spark, sf)
    return G.unbuilt_parents(p, e, p.where("node % 5 = 0"))


@query("g21_blocked_by_failure", oracle(""", o AS (SELECT scope, node, CASE WHEN node % 41 = 3 THEN 'failed' WHEN node % 3 = 0 THEN 'skipped' ELSE 'built' END AS status, node % 4 <> 0 AS has_build FROM dag_nodes),
 d AS (SELECT scope, node FROM o WHERE status = 'failed' UNION SELECT e.scope, e.child FROM d JOIN dag_edges e ON e.scope = d.scope AND e.parent = d.node) SELECT scope, node, has_build FROM o SEMI JOIN d USING (scope, node) WHERE status = 'skipped'""", "dag_nodes", "dag_edges"))
def g21(spark, sf):
    n, e = dag(spark, sf)
    o = n.select("scope", "node", F.expr("CASE WHEN node % 41 = 3 THEN 'failed' WHEN node % 3 = 0 THEN 'skipped' ELSE 'built' END").alias("status"), F.expr("node % 4 <> 0").alias("has_build"))
    return G.blocked_by_failure(o, e)


@query("s15_graph_document", oracle(LAYERS + """, decl AS (SELECT scope, parent, child, CASE WHEN (parent + child) % 2 = 0 THEN 'sql' ELSE 'declared' END AS via FROM dag_edges UNION ALL SELECT scope, parent, child, 'declared' FROM dag_edges)
 SELECT scope, parent, child, max(via) AS via, any_value(depth) AS child_layer FROM decl JOIN lays ON lays.scope = decl.scope AND lays.node = decl.child GROUP BY scope, parent, child""".replace("GROUP BY scope", "GROUP BY decl.scope").replace("SELECT scope, parent, child, max", "SELECT decl.scope, parent, child, max"), "dag_nodes", "dag_edges"))
def s15(spark, sf):
    n, e = dag(spark, sf)
    sql = e.withColumn("via", F.expr("CASE WHEN (parent + child) % 2 = 0 THEN 'sql' ELSE 'declared' END"))
    both = sql.unionByName(e.withColumn("via", F.lit("declared")))
    # An edge that SQL and the declaration both have is an edge of the SQL
    merged = both.groupBy("scope", "parent", "child").agg(F.max("via").alias("via"))
    return merged.join(layers(n, e).select("scope", F.col("node").alias("child"), F.col("depth").alias("child_layer")), ["scope", "child"])
