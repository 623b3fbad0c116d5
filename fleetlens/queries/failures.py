"""Errors made from the documents' sources, and suggestions over part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.bindings import bind, oracle
from fleetlens.operators import failures as X

QUERIES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


# Error patterns, in order.
PATTERNS = [
    (0, 0, "own_src1", None, ["src1 "], "own", "custom"),
    (1, 0, "missing_column", "Binder Error", ["referenced column", "not found"], "column_missing", "model"),
    (1, 1, "missing_table", "Catalog Error", ["does not exist"], "relation_missing", "missing_relation"),
    (1, 2, "denied", None, ["permission denied"], "access_denied", "access"),
    (2, 0, "spark_missing_table", None, ["[table_or_view_not_found]"], "relation_missing", "missing_relation"),
    (2, 1, "bad_cast", "Runtime Error", ["[cast_invalid_input]"], "bad_value", "data"),
]
CASES = "CASE WHEN contains(lower(message), 'src1 ') THEN 0 WHEN kind = 'Binder Error' AND contains(lower(message), 'referenced column') AND contains(lower(message), 'not found') THEN 1 WHEN kind = 'Catalog Error' AND contains(lower(message), 'does not exist') THEN 2 WHEN contains(lower(message), 'permission denied') THEN 3 WHEN contains(lower(message), '[table_or_view_not_found]') THEN 4 WHEN kind = 'Runtime Error' AND contains(lower(message), '[cast_invalid_input]') THEN 5 END"
PICK = lambda i, last: f"CASE {CASES} " + " ".join(f"WHEN {k} THEN '{p[i]}'" for k, p in enumerate(PATTERNS)) + f" ELSE {last} END"
KIND = "CASE kind WHEN 'Binder Error' THEN 'model' WHEN 'Catalog Error' THEN 'missing_relation' WHEN 'Database Error' THEN 'warehouse' WHEN 'Runtime Error' THEN 'runtime' ELSE 'unknown' END"


@query("j15_classify_errors", oracle(f"SELECT doc_id, {PICK(2, 'NULL')} AS pattern, {PICK(5, chr(39) + 'unrecognised' + chr(39))} AS symptom, {PICK(6, KIND)} AS category FROM error_messages", "error_messages"))
def j15(spark, sf):
    p = spark.createDataFrame(PATTERNS, "catalogue_rank int, ordinal int, pattern string, kind string, phrases array<string>, symptom string, category string")
    return X.classify_errors(bind(spark, sf, "error_messages"), p).select("doc_id", "pattern", "symptom", "category")


NAMES = "SELECT 'all' AS scope, p_name || CASE WHEN p_partkey % 2 = 0 THEN 's' ELSE '' END AS name FROM part"


@query("j16_did_you_mean", f"SELECT scope, name, candidate, CAST(distance AS INTEGER) AS distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY scope, name ORDER BY distance, candidate) AS rank FROM (SELECT DISTINCT n.scope, n.name, c.p_name AS candidate, levenshtein(lower(n.name), lower(c.p_name)) AS distance FROM ({NAMES}) n JOIN (SELECT DISTINCT p_name FROM part) c ON levenshtein(lower(n.name), lower(c.p_name)) <= 2 AND n.name <> c.p_name)) WHERE rank <= 3")
def j16(spark, sf):
    bind(spark, sf, "node_facts")
    return X.did_you_mean(spark.sql(NAMES).distinct(), spark.sql("SELECT DISTINCT 'all' AS scope, p_name AS candidate FROM part"))


@query("p14_failed_nodes", oracle("SELECT scope, run_id, node FROM (SELECT DISTINCT scope, run_id, node FROM run_events WHERE status = 'error') ANTI JOIN (SELECT scope, run_id, node FROM run_events WHERE status = 'failed') USING (scope, run_id, node)", "run_events"))
def p14(spark, sf):
    e = bind(spark, sf, "run_events")
    return X.failed_nodes(e.where("status = 'error'").select("scope", "run_id", "node", "status").distinct(), e.where("kind = 'check_finished'"))[0]


@query("p10_search", "SELECT p_partkey AS id, p_name AS name, CAST(CASE WHEN lower(p_name) = 'red gear' THEN 3 WHEN starts_with(lower(p_name), 'red gear') THEN 2 ELSE 1 END AS INTEGER) AS score FROM part WHERE contains(lower(p_name), 'red gear') ORDER BY score DESC, length(p_name), p_name, p_partkey LIMIT 25")
def p10(spark, sf):
    return X.search(bind(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "Red Gear", 25)


ASKED = [(1, "Red gear"), (2, "gear .size red"), (3, "model.1 s"), (4, "  "), (5, "model.77"), (6, "x.price"), (7, "zzzz"), (8, "E"), (9, "blue.size")]
ITEMS = """SELECT 'n' || CAST(p_partkey AS STRING) AS item, p_name AS label, p_name || ' model.' || CAST(p_partkey AS STRING) AS haystack, 'model' AS kind FROM part
 UNION ALL SELECT 'n' || CAST(p_partkey AS STRING) || '.' || c, p_name || '.' || c, p_name || '.' || c, 'column' FROM part CROSS JOIN (SELECT 'size' AS c UNION ALL SELECT 'price' AS c) cs"""
P10 = f"""WITH q AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{t}')" for i, t in ASKED)}) v(query, text)), i AS ({ITEMS}),
 m AS (SELECT query, item, label, kind, row_number() OVER (PARTITION BY query ORDER BY starts_with(lower(haystack), lower(trim(text))) DESC, length(label), label, item) AS rank
  FROM q, i WHERE trim(text) <> '' AND list_bool_and([contains(lower(haystack), t) FOR t IN string_split(lower(trim(text)), ' ')]))
SELECT query, CAST(rank AS INTEGER) AS rank, item, label, kind FROM m WHERE rank <= 20"""


@query("p10_search_terms", P10)
def p10_terms(spark, sf):
    bind(spark, sf, "node_facts")
    return X.SearchIndex(spark.sql(ITEMS)).search(spark.createDataFrame(ASKED, "query int, text string"), 20)


MET = "SELECT 'm' || CAST(p_partkey AS STRING) AS metric, CASE WHEN p_partkey % 2 = 0 THEN 'm' || CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS STRING) ELSE 't' || CAST(p_partkey % 20 AS STRING) END AS reads FROM part WHERE p_partkey > 0"


@query("g22_metric_closure", f"WITH RECURSIVE r AS ({MET}), c AS (SELECT metric, reads FROM r UNION SELECT c.metric, r.reads FROM c JOIN r ON r.metric = c.reads) SELECT * FROM c")
def g22(spark, sf):
    bind(spark, sf, "node_facts")
    return X.metric_closure(spark.sql(MET))


@query("g25_failure_explanations")
def g25(spark, sf):
    e = bind(spark, sf, "error_messages")
    failed = e.select("doc_id", F.lit("r0").alias("scope"), F.concat(F.lit("n"), F.col("doc_id") % 50).alias("node"))
    led = bind(spark, sf, "ledger_nodes").withColumn("node", F.expr("'n' || cast(cast(substr(node, 2) as bigint) % 50 as string)"))
    history = led.groupBy("scope", "node").agg(F.count_if(F.col("action") == "failed").alias("failed"))
    blocked = led.where("action = 'skipped'").groupBy("scope", "node").agg(F.count(F.lit(1)).alias("n_blocked"))
    return X.explanations(failed.withColumnRenamed("doc_id", "error_id"), j15(spark, sf).withColumnRenamed("doc_id", "error_id"), history, blocked)


MET2 = f"SELECT 's' || CAST(p_partkey % 3 AS STRING) AS scope, 'm' || CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS STRING) AS metric, CASE WHEN p_partkey % 4 > 0 THEN 'm' || CAST(CAST(floor(p_partkey / 7) AS BIGINT) AS STRING) ELSE 't' || CAST(p_partkey % 20 AS STRING) END AS reads FROM part WHERE p_partkey > 0"


@query("g22_metrics_by_scope", f"WITH RECURSIVE r AS ({MET2}), c AS (SELECT scope, metric, reads FROM r UNION SELECT c.scope, c.metric, r.reads FROM c JOIN r ON r.scope = c.scope AND r.metric = c.reads) SELECT * FROM c")
def g22_scoped(spark, sf):
    """Three projects that share the names of their metrics."""
    bind(spark, sf, "node_facts")
    return X.metric_closure(spark.sql(MET2))
