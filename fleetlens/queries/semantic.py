"""Events of the column graph, the semantic layer and past plans, over parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.bindings import bind
from fleetlens.operators import openlineage as O
from fleetlens.operators import records as R
from fleetlens.operators import semantic as S
from fleetlens.queries.lineage import COLS, EDGES, duck
from fleetlens.queries.project import IS, RUNS, WAS

QUERIES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


NODES = """SELECT CAST(p_partkey AS STRING) AS node, 'db.' || CAST(p_partkey AS STRING) AS relation, CASE WHEN p_partkey % 23 = 5 THEN 'seed' WHEN p_partkey % 10 = 4 THEN 'snapshot' ELSE 'model' END AS resource_type,
 p_partkey % 19 <> 4 AND p_partkey % 23 <> 5 AS analysed, p_partkey % 13 = 11 AS opaque, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS cache_key FROM part"""
READS = f"SELECT DISTINCT node, 'db.' || from_relation AS relation FROM ({EDGES}) e"
DEPENDS = "SELECT CAST(p_partkey AS STRING) AS node, 'db.' || CAST(p_partkey % 7 AS STRING) AS relation FROM part WHERE p_partkey % 2 = 0"
INPUTS = f"""SELECT node, to_column AS column, 'db.' || from_relation AS from_relation, from_column, 'DIRECT' AS type, CASE CAST(node AS BIGINT) % 3 WHEN 0 THEN 'IDENTITY' WHEN 1 THEN 'TRANSFORMATION' ELSE 'AGGREGATION' END AS subtype FROM ({EDGES}) e WHERE to_column IS NOT NULL
 UNION ALL SELECT node, to_column, 'db.' || from_relation, from_column, 'INDIRECT', 'CONDITIONAL' FROM ({EDGES}) e WHERE to_column IS NOT NULL AND CAST(node AS BIGINT) % 4 = 0"""
SHAPES = f"""SELECT node, 'db.' || from_relation AS from_relation, from_column, 'FILTER' AS subtype FROM ({EDGES}) e WHERE to_column IS NULL
 UNION ALL SELECT node, 'db.' || from_relation, from_column, 'JOIN' FROM ({EDGES}) e WHERE to_column IS NULL AND CAST(node AS BIGINT) % 2 = 0"""
SPACE, JOBS, BY, WHEN = "warehouse://one", "fleet", "https://example.org/fleet", "2024-06-30T00:00:00Z"


def events_sql(kind: str, everywhere: bool) -> str:
    """The events as DuckDB writes them: structs in the same order, with facets where a node has them."""
    way = "CASE subtype WHEN 'IDENTITY' THEN 0 WHEN 'TRANSFORMATION' THEN 1 WHEN 'AGGREGATION' THEN 2 WHEN 'JOIN' THEN 3 WHEN 'FILTER' THEN 4 ELSE 8 END"
    ways = f"list({{'type': type, 'subtype': subtype, 'description': '', 'masking': false}} ORDER BY {way})"
    entry = f"{{'namespace': '{SPACE}', 'name': from_relation, 'field': from_column, 'transformations': w}}"
    facet = f"{{'columnLineage': {{'_producer': '{BY}', '_schemaURL': '{O.FACET_SCHEMA}', 'fields': fields, 'dataset': coalesce(ds, [])}}}}"
    run = ""
    if kind == "run":
        h = f"sha256('{JOBS}/' || node || '/' || coalesce(cache_key, ''))"
        run = f", 'eventType': 'COMPLETE', 'run': {{'runId': substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)}}"
    event = lambda facets: f"CAST(to_json({{'eventTime': '{WHEN}', 'producer': '{BY}', 'job': {{'namespace': '{JOBS}', 'name': node}}, 'inputs': list_transform(coalesce(tabs, []), lambda tab: {{'namespace': '{SPACE}', 'name': tab}}), 'outputs': [{{'namespace': '{SPACE}', 'name': relation{facets}}}], 'schemaURL': '{O.EVENT_SCHEMA}#/$defs/{kind.title()}Event'{run}}}) AS VARCHAR)"
    more = " UNION SELECT s.node, c.\"column\", from_relation, from_column, 'INDIRECT', subtype FROM sh s JOIN cols c ON c.relation = s.node" if everywhere else ""
    return f"""WITH cols AS ({duck(COLS)}), n AS ({NODES}), sh AS (SELECT DISTINCT * FROM ({SHAPES})), i AS (SELECT DISTINCT * FROM ({duck(INPUTS)}){more}),
 f0 AS (SELECT node, "column", from_relation, from_column, {ways} AS w FROM i GROUP BY ALL), f1 AS (SELECT c.relation AS node, c."column" AS k, coalesce(list({entry} ORDER BY from_relation, from_column) FILTER (from_relation IS NOT NULL), []) AS l FROM cols c LEFT JOIN f0 ON f0.node = c.relation AND f0."column" = c."column" GROUP BY ALL),
 f AS (SELECT node, map_from_entries(list({{'k': k, 'v': {{'inputFields': l}}}} ORDER BY k)) AS fields FROM f1 GROUP BY node),
 d0 AS (SELECT node, from_relation, from_column, list({{'type': 'INDIRECT', 'subtype': subtype, 'description': '', 'masking': false}} ORDER BY {way}) AS w FROM sh GROUP BY ALL), d AS (SELECT node, list({entry} ORDER BY from_relation, from_column) AS ds FROM d0 GROUP BY node),
 t AS (SELECT node, list(relation ORDER BY relation) AS tabs FROM (SELECT n.node, r.relation FROM n JOIN ({READS}) r USING (node) WHERE analysed UNION SELECT n.node, r.relation FROM n JOIN ({DEPENDS}) r USING (node) WHERE NOT analysed) GROUP BY node)
SELECT node, CASE WHEN analysed AND NOT opaque THEN {event(", 'facets': " + facet)} ELSE {event("")} END AS event FROM n LEFT JOIN f USING (node) LEFT JOIN d USING (node) LEFT JOIN t USING (node) WHERE analysed OR resource_type IN ('model', 'snapshot')"""


def events(spark, sf, kind: str, placement: str):
    bind(spark, sf, "dag_nodes")  # registers the tables
    outputs = spark.sql(COLS).select(F.col("relation").alias("node"), "column")
    return O.lineage_events(
        *[spark.sql(s) for s in (NODES, READS, DEPENDS)], outputs, spark.sql(INPUTS), spark.sql(SHAPES),
        dataset_namespace=SPACE, job_namespace=JOBS, producer=BY, event_time=WHEN, kind=kind, placement=placement,
    )


@query("s14_job_events", events_sql("job", False))
def s14_job(spark, sf):
    return events(spark, sf, "job", "dataset")


@query("s14_run_events", events_sql("run", True))
def s14_run(spark, sf):
    return events(spark, sf, "run", "dataset_and_fields")


# Metrics of two projects that share names; a semantic model for every third part, and metrics in cycles (m1, m2).
METRICS = "SELECT 's' || CAST(p_partkey % 2 AS STRING) AS scope, 'm' || CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING) AS metric, p_name AS name FROM part"
METRIC_READS = """SELECT 's' || CAST(p_partkey % 2 AS STRING) AS scope, 'm' || CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING) AS metric,
 CASE p_partkey % 5 WHEN 0 THEN 'm' || CAST(CAST(floor(p_partkey / 5) AS BIGINT) AS STRING) WHEN 1 THEN 'm' || CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS STRING) WHEN 2 THEN 'none' ELSE 'sm' || CAST(p_partkey % 30 AS STRING) END AS reads FROM part
 UNION ALL SELECT 's' || CAST(p_partkey % 2 AS STRING), 'm' || CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING), 'm' || CAST(CAST(floor(p_partkey / 4) AS BIGINT) AS STRING) FROM part WHERE p_partkey % 3 = 0
 UNION ALL SELECT 's1', 'm1', 'm2' FROM region WHERE r_regionkey = 0 UNION ALL SELECT 's1', 'm2', 'm1' FROM region WHERE r_regionkey = 0"""
MODELS = "SELECT DISTINCT 's' || CAST(p_partkey % 2 AS STRING) AS scope, 'sm' || CAST(p_partkey % 30 AS STRING) AS model, 'model ' || CAST(p_partkey % 6 AS STRING) AS name FROM part WHERE p_partkey % 3 > 0"
DIMENSIONS = "SELECT 's' || CAST(p_partkey % 2 AS STRING) AS scope, 'sm' || CAST(p_partkey % 30 AS STRING) AS model, p_brand AS dimension FROM part WHERE p_partkey % 30 <> 4"
DEFINED_ON = "SELECT 's' || CAST(p_partkey % 2 AS STRING) AS scope, 'sm' || CAST(p_partkey % 30 AS STRING) AS model, 'n' || CAST(p_size AS STRING) AS node FROM part"
VIEWS = f"""WITH RECURSIVE r AS ({METRIC_READS}), c AS (SELECT scope, metric, reads FROM r UNION SELECT c.scope, c.metric, r.reads FROM c JOIN r ON r.scope = c.scope AND r.metric = c.reads),
 u AS (SELECT c.scope, c.metric, m.model, m.name AS mname FROM c JOIN ({MODELS}) m ON m.scope = c.scope AND m.model = c.reads),
 v AS (SELECT k.scope, k.metric, k.name, coalesce((SELECT string_agg(mname, ',' ORDER BY model) FROM u WHERE u.scope = k.scope AND u.metric = k.metric), '') AS semantic_models,
  coalesce((SELECT string_agg(DISTINCT dimension, ',' ORDER BY dimension) FROM u JOIN ({DIMENSIONS}) d USING (scope, model) WHERE u.scope = k.scope AND u.metric = k.metric), '') AS dimensions,
  coalesce((SELECT string_agg(DISTINCT node, ',' ORDER BY node) FROM u JOIN ({DEFINED_ON}) d USING (scope, model) WHERE u.scope = k.scope AND u.metric = k.metric), '') AS depends_on FROM ({METRICS}) k)
"""


def views(spark, sf):
    bind(spark, sf, "dag_nodes")  # registers the tables
    return S.metric_views(*[spark.sql(s) for s in (METRICS, METRIC_READS, MODELS, DIMENSIONS, DEFINED_ON)])


@query("g22_metric_views", VIEWS + "SELECT * FROM v")
def g22_views(spark, sf):
    return views(spark, sf).select("scope", "metric", "name", *[F.array_join(c, ",").alias(c) for c in ("semantic_models", "dimensions", "depends_on")])


@query("g22_metrics_reached", VIEWS + ", x AS (SELECT DISTINCT scope, metric, unnest(string_split(depends_on, ',')) AS node FROM v) SELECT scope, node, metric FROM x WHERE node IN ('n1', 'n7')")
def g22_reached(spark, sf):
    v = views(spark, sf).dropDuplicates(["scope", "metric"])
    changed = spark.sql("SELECT DISTINCT 's' || CAST(p_partkey % 2 AS STRING) AS scope, 'n' || CAST(p_size AS STRING) AS node FROM part WHERE p_size IN (1, 7)")
    return S.metrics_reached(v, changed)


PARENTS = """SELECT 'r' || CAST(o_custkey % 5 AS STRING) AS scope, 'n' || CAST(o_orderkey AS STRING) AS node, 'n' || CAST(CAST(floor(o_orderkey / 2) AS BIGINT) AS STRING) AS parent FROM orders WHERE o_orderkey % 4 > 0
 UNION ALL SELECT 'r' || CAST(o_custkey % 5 AS STRING), 'n' || CAST(o_orderkey AS STRING), 'n' || CAST(CAST(floor(o_orderkey / 3) AS BIGINT) AS STRING) FROM orders WHERE o_orderkey % 4 > 1"""
TEXT = "string_agg(component || '=' || digest, ';' ORDER BY component)"
PAST = f"""WITH b AS (SELECT scope, run_id, node, sha256({TEXT}) AS was FROM ({WAS}) GROUP BY ALL), a AS (SELECT scope, run_id, node, sha256({TEXT}) AS now_ FROM ({IS}) GROUP BY ALL HAVING CAST(substr(node, 2) AS BIGINT) % 7 <> 2),
 d AS (SELECT scope, run_id, node, string_agg(component, ',' ORDER BY component) AS changed FROM ({WAS}) b FULL JOIN ({IS}) a USING (scope, run_id, node, component) WHERE b.digest IS DISTINCT FROM a.digest GROUP BY ALL),
 p AS (SELECT scope, node, string_agg(DISTINCT parent, ',' ORDER BY parent) AS depends_on FROM ({PARENTS}) GROUP BY ALL)
SELECT scope, run_id, node, coalesce(depends_on, '') AS depends_on, 'BUILD' AS action, CASE WHEN was <> now_ THEN 'code_changed' END AS reason, CASE WHEN was <> now_ THEN changed END AS changed, CASE WHEN was <> now_ THEN was END AS was, CASE WHEN was <> now_ THEN now_ END AS now
 FROM (SELECT DISTINCT * FROM ({RUNS})) LEFT JOIN b USING (scope, run_id, node) LEFT JOIN a USING (scope, run_id, node) LEFT JOIN d USING (scope, run_id, node) LEFT JOIN p USING (scope, node)"""


@query("g24_past_plan", PAST)
def g24_past(spark, sf):
    bind(spark, sf, "dag_nodes")  # registers the tables

    def state(sql: str):
        part = F.array_sort(F.collect_list(F.struct("component", "digest")))
        text = F.array_join(F.transform("parts", lambda p: F.concat(p["component"], F.lit("="), p["digest"])), ";")
        return spark.sql(sql).groupBy("scope", "run_id", "node").agg(part.alias("parts")).select("scope", "run_id", "node", F.sha2(text, 256).alias("digest"), F.map_from_entries("parts").alias("components"))

    after = state(IS).withColumn("recorded_by", F.when(F.expr("cast(substr(node, 2) as bigint) % 7 <> 2"), F.col("run_id")).otherwise("another"))
    p = R.past_plan(spark.sql(RUNS), state(WAS), after, spark.sql(PARENTS))
    return p.withColumns({c: F.array_join(c, ",") for c in ("depends_on", "changed")})
