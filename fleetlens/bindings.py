"""The test tables as the relations of the data model: one SELECT each, for Spark and DuckDB alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()

BINDINGS: dict[str, str] = {
    "run_events": """
SELECT 'r' || CAST(user_id % 5 AS STRING) AS scope, 'run-' || CAST(user_id AS STRING) AS run_id, event_id AS seq, ts AS at,
 'n' || CAST(event_id % 17 AS STRING) AS node,
 CASE event_type WHEN 'signup' THEN 'node_queued' WHEN 'view' THEN 'node_started' WHEN 'purchase' THEN 'check_finished' ELSE 'node_finished' END AS kind,
 CASE event_type WHEN 'click' THEN 'success' WHEN 'error' THEN 'error' WHEN 'purchase' THEN CASE WHEN value > 40 THEN 'failed' ELSE 'passed' END END AS status,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS rows_affected,
 'T' || CAST(event_id % 4 AS STRING) AS thread FROM events
""",
    "run_journal": """
SELECT scope, run_id, seq, ts AS at, kind, CASE WHEN kind LIKE 'node%' THEN 'n' || CAST(seq % 7 AS STRING) END AS node,
 CASE WHEN kind = 'node_finished' THEN CASE WHEN event_type = 'error' THEN CASE WHEN seq % 2 = 0 THEN 'error' ELSE 'skipped' END WHEN seq % 4 = 3 THEN 'unknown' ELSE 'success' END
  WHEN kind = 'check_finished' THEN CASE seq % 5 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' WHEN 2 THEN 'warned' WHEN 3 THEN 'skipped' ELSE 'unknown' END END AS status,
 CASE WHEN kind = 'node_started' AND seq % 3 > 0 OR kind = 'node_finished' AND seq % 5 = 0 THEN 'T' || CAST(seq % 4 AS STRING) END AS thread,
 CASE WHEN kind = 'node_finished' AND seq % 4 = 1 THEN ts - INTERVAL 60 SECOND END AS started_at, CASE WHEN kind = 'node_finished' AND seq % 5 > 0 THEN ts END AS finished_at,
 CASE WHEN kind = 'node_finished' AND seq % 3 > 0 THEN CAST(floor(value * 100) AS BIGINT) END AS duration_ms, CASE WHEN kind = 'node_finished' AND seq % 3 > 1 THEN CAST(floor(value * 10) AS BIGINT) END AS compile_ms,
 CASE WHEN kind = 'node_finished' AND seq % 6 > 2 THEN CAST(floor(value * 90) AS BIGINT) END AS execute_ms, CASE WHEN kind = 'node_finished' AND seq % 5 > 1 THEN CAST(floor(value) AS BIGINT) END AS rows_affected,
 CASE WHEN kind = 'node_finished' AND seq % 6 = 0 THEN 'q-' || CAST(seq AS STRING) END AS query_id, CASE WHEN kind = 'node_finished' AND seq % 3 = 0 THEN 'E' || CAST(seq AS STRING) END AS error,
 CASE WHEN kind = 'node_finished' AND seq % 5 = 0 THEN 'n' || CAST(seq % 2 AS STRING) || ',n' || CAST(2 + seq % 3 AS STRING) END AS blockers,
 CASE WHEN kind = 'node_finished' AND seq % 8 < 3 THEN seq % 4 END AS passed, CASE WHEN kind = 'node_finished' AND seq % 8 < 3 THEN seq % 3 END AS failed,
 CASE WHEN kind = 'node_finished' AND seq % 8 < 3 THEN seq % 2 END AS warned, CASE WHEN kind = 'node_finished' AND seq % 8 < 3 THEN seq % 5 END AS skipped,
 CASE WHEN kind = 'check_finished' THEN 'c' || CAST(seq % 3 AS STRING) END AS check_id, CASE WHEN kind = 'check_finished' THEN 'n' || CAST(seq % 7 AS STRING) || ',n' || CAST(seq % 4 AS STRING) END AS covered,
 CASE WHEN kind = 'run_started' THEN 'n0,n' || CAST(seq % 8 AS STRING) END AS listed, CASE WHEN kind = 'run_started' THEN CASE WHEN seq % 2 = 0 THEN 'build' ELSE 'test' END END AS mode,
 CASE WHEN kind = 'run_started' THEN seq % 3 > 0 END AS live, CASE WHEN kind = 'run_finished' THEN CASE WHEN seq % 2 = 0 THEN 'succeeded' ELSE 'failed' END END AS outcome
FROM (SELECT 'r' || CAST(user_id % 5 AS STRING) AS scope, 'run-' || CAST(user_id AS STRING) AS run_id, event_id AS seq, ts, event_type, value,
  CASE WHEN event_id % 41 = 0 THEN 'run_started' WHEN event_id % 43 = 0 THEN 'run_finished' WHEN event_type = 'signup' THEN 'node_queued' WHEN event_type = 'view' THEN 'node_started'
   WHEN event_type = 'purchase' THEN 'check_finished' ELSE 'node_finished' END AS kind FROM events) e
""",
    "dag_nodes": """
SELECT 'r' || CAST(r_regionkey AS STRING) AS scope, p_partkey AS node FROM part CROSS JOIN region CROSS JOIN (SELECT count(*) AS n FROM part) c WHERE p_partkey * 5 < (r_regionkey + 1) * n
""",
    "dag_edges": """
SELECT DISTINCT 'r' || CAST(r_regionkey AS STRING) AS scope, CAST(floor(p_partkey / k) AS BIGINT) AS parent, p_partkey AS child FROM part CROSS JOIN region CROSS JOIN (SELECT count(*) AS n FROM part) c CROSS JOIN (SELECT 2 AS k UNION ALL SELECT 3 AS k) ks WHERE p_partkey > 0 AND p_partkey * 5 < (r_regionkey + 1) * n
""",
    "fp_before": """
SELECT p_partkey AS node, c AS component, CASE WHEN c = 'sql' THEN p_type WHEN c = 'config' THEN p_brand ELSE CAST(p_size AS STRING) END AS content FROM part CROSS JOIN (SELECT 'sql' AS c UNION ALL SELECT 'config' AS c UNION ALL SELECT 'relation' AS c) cs WHERE p_partkey % 29 <> 0
""",
    "fp_after": """
SELECT p_partkey AS node, c AS component, CASE WHEN c = 'sql' THEN CASE WHEN p_partkey % 13 = 0 THEN p_type || '!' ELSE p_type END WHEN c = 'config' THEN p_brand ELSE CAST(p_size AS STRING) END AS content FROM part CROSS JOIN (SELECT 'sql' AS c UNION ALL SELECT 'config' AS c UNION ALL SELECT 'relation' AS c) cs WHERE NOT (c = 'relation' AND p_partkey % 31 = 0)
""",
    "ledger_nodes": """
SELECT 'r' || CAST(o_custkey % 5 AS STRING) AS scope, 'run-' || CAST(o_custkey AS STRING) AS run_id, 'n' || CAST(o_orderkey AS STRING) AS node,
 CASE o_orderstatus WHEN 'O' THEN 'reused' WHEN 'F' THEN 'built' ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 'failed' ELSE 'skipped' END END AS action,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS build_ms, 'run-' || CAST(o_orderkey % 50 AS STRING) AS timed_by, o_orderdate AS finished_at FROM orders
""",
    "predicted_edges": """
SELECT DISTINCT l_suppkey AS node, l_partkey AS source, CASE WHEN l_linenumber <= 5 THEN l_linenumber ELSE l_linenumber + 10 END AS output, CASE WHEN l_linenumber % 3 = 0 THEN 'INDIRECT' ELSE 'DIRECT' END AS edge_type FROM lineitem
""",
    "observed_edges": """
SELECT DISTINCT l_suppkey AS node, l_partkey AS source, l_linenumber AS output FROM lineitem WHERE l_returnflag IN ('A', 'N')
""",
    "source_versions": """
SELECT l_suppkey AS source, max(l_shipdate) AS now_version, max(CASE WHEN l_quantity < 40 THEN l_shipdate END) AS recorded_version FROM lineitem GROUP BY l_suppkey
""",
    "thread_bars": """
SELECT 'run-' || CAST(l_orderkey % 200 AS STRING) AS run_id, 'T' || CAST(l_linenumber % 3 AS STRING) AS thread, l_orderkey AS node, l_linenumber AS part_no, l_partkey AS tiebreak, l_shipdate AS start_at, CAST(floor(l_quantity) AS BIGINT) AS took_days FROM lineitem
""",
    "error_messages": """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Binder Error' WHEN 1 THEN 'Catalog Error' WHEN 2 THEN 'Database Error' ELSE 'Runtime Error' END AS kind,
 CASE doc_id % 6 WHEN 0 THEN 'Referenced column "' || source || '" not found' WHEN 1 THEN 'Table with name ' || source || ' does not exist' WHEN 2 THEN 'permission denied for table ' || source WHEN 3 THEN '[TABLE_OR_VIEW_NOT_FOUND] ' || source WHEN 4 THEN '[CAST_INVALID_INPUT] value ''' || lang || '''' ELSE source || ' failed' END AS message FROM documents
""",
    "node_facts": """
SELECT p_partkey AS node, p_type AS resource_type, p_brand AS tag, p_size AS layer, coalesce(t.n, 0) % 4 AS tests, p_partkey % 3 <> 0 AS described FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) t ON l_partkey = p_partkey
""",
}


def tables(spark: SparkSession, sf_dir: str) -> None:
    """Register the given tables as temporary views."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A binding's relation, or a given table."""
    if name not in BINDINGS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tables(spark, sf_dir)
    return spark.sql(BINDINGS[name])


def oracle(sql: str, *names: str) -> str:
    """SQL over the named bindings; text that begins with "," adds further (recursive) relations."""
    if "run_events" in names or "run_journal" in names:  # "at" is a keyword of DuckDB
        sql = re.sub(r"(?<![\w.\"])at(?=[\s,)])", '"at"', sql)
    with_ = "WITH RECURSIVE " + ", ".join(f"{n} AS ({BINDINGS[n].strip()})" for n in names)
    return f"{with_}{sql}" if sql.lstrip().startswith(",") else f"{with_} {sql}"
