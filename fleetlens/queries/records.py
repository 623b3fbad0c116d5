"""The state that runs leave, and the check of the stored snapshots."""

from __future__ import annotations

from fleetlens.bindings import bind, oracle
from fleetlens.operators import records as R

QUERIES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


K = "CAST(substr(node, 2) AS BIGINT)"
PARENT = f"'n' || CAST(CAST(floor({K} / 2) AS BIGINT) AS STRING)"
# One project a scope: nodes that the run built, failed, skipped or that it doesn't have any more.
RESULTS = f"SELECT scope, node, 'new' AS run_id, finished_at AS at_time, CASE WHEN action = 'built' OR action = 'reused' AND {K} % 2 = 0 THEN 'success' WHEN action = 'failed' THEN 'failed' ELSE 'skipped' END AS outcome, {K} % 5 < 3 AS tested, build_ms FROM ledger_nodes WHERE {K} % 3 <> 0"
NODES = f"SELECT scope, node, CASE WHEN {K} % 7 > 0 THEN 'fp' || node END AS fp, CASE WHEN {K} % 4 < 3 THEN 'c' || node END AS checks FROM ledger_nodes WHERE {K} % 11 <> 0"
PARENTS = f"SELECT scope, node, {PARENT} AS parent FROM ledger_nodes UNION ALL SELECT scope, node, 's' || CAST({K} % 20 AS STRING) AS parent FROM ledger_nodes"
VERSIONS = f"SELECT scope, 's' || CAST({K} % 20 AS STRING) AS source, CAST(max({K}) AS STRING) AS version, max({K}) % 3 > 0 AS predates FROM ledger_nodes GROUP BY 1, 2"
PREVIOUS = f"SELECT scope, node, run_id, finished_at AS built_at, 'old' || node AS fp, build_ms, run_id AS tested FROM ledger_nodes WHERE {K} % 4 <> 0"
READS = f"SELECT scope, node, 'parent' AS kind, {PARENT} AS name, timed_by AS value FROM ledger_nodes WHERE {K} % 4 <> 0"

FATE = f"""results AS ({RESULTS}), nodes AS ({NODES}), parents AS ({PARENTS}), versions AS ({VERSIONS}), previous AS ({PREVIOUS}), old_reads AS ({READS}),
 fate AS (SELECT r.*, n.fp, n.checks, CASE WHEN n.node IS NULL THEN 'ignored' WHEN outcome = 'success' THEN CASE WHEN n.fp IS NULL THEN 'kept_no_fingerprint' ELSE 'advanced' END ELSE 'kept_' || outcome END AS became
  FROM results r LEFT JOIN nodes n USING (scope, node)),
 states AS (SELECT scope, node, run_id, at_time AS built_at, fp, build_ms, CASE WHEN tested AND checks IS NOT NULL THEN run_id END AS tested FROM fate WHERE became = 'advanced'
  UNION ALL SELECT p.scope, p.node, p.run_id, p.built_at, p.fp, p.build_ms, CASE WHEN became IN ('kept_failed', 'kept_no_fingerprint') THEN NULL ELSE p.tested END
  FROM previous p LEFT JOIN fate f USING (scope, node) WHERE became IS DISTINCT FROM 'advanced'),
 made AS (SELECT scope, node, parent AS name FROM parents JOIN fate USING (scope, node) WHERE became = 'advanced')"""


def recorded(spark, sf):
    bind(spark, sf, "ledger_nodes").createOrReplaceTempView("ledger_nodes")
    results = spark.sql(RESULTS).withColumnRenamed("at_time", "at")
    return R.record_run(results, *[spark.sql(s) for s in (NODES, PARENTS, VERSIONS, PREVIOUS, READS)])


@query("g17_recorded_states", oracle(f", {FATE} SELECT * FROM states", "ledger_nodes"))
def g17_states(spark, sf):
    return recorded(spark, sf)[0]


@query("g17_recorded_reads", oracle(f""", {FATE} SELECT m.scope, m.node, 'parent' AS kind, name, s.run_id AS value FROM made m JOIN states s ON s.scope = m.scope AND s.node = name WHERE (m.scope, name) IN (SELECT (scope, node) FROM nodes)
 UNION ALL SELECT m.scope, m.node, 'input', name, CASE WHEN predates THEN version END FROM made m JOIN versions v ON v.scope = m.scope AND source = name
 UNION ALL SELECT scope, node, kind, name, value FROM old_reads WHERE (scope, node) NOT IN (SELECT (scope, node) FROM fate WHERE became = 'advanced')""", "ledger_nodes"))
def g17_reads(spark, sf):
    return recorded(spark, sf)[1]


@query("g17_recorded_report", oracle(f", {FATE} SELECT scope, node, became FROM fate", "ledger_nodes"))
def g17_report(spark, sf):
    return recorded(spark, sf)[2]


# Every ledger row leaves a snapshot; documents are cut short, name another run, count otherwise or follow another parent.
BASE = f"SELECT scope, {K} AS id, run_id, CASE WHEN {K} % 40 = 0 THEN CAST(-1 AS BIGINT) WHEN {K} % 9 = 0 THEN {K} END AS parent, {K} % 30 AS nodes FROM ledger_nodes"
DOC = """CASE WHEN id % 17 = 0 THEN '{"run_id": "' || run_id WHEN id % 19 = 0 THEN '{"nodes": 1}'
 ELSE '{"run_id": "' || CASE WHEN id % 13 = 0 THEN 'other' ELSE run_id END || '", "parent": ' || CASE WHEN id % 23 = 0 THEN '7' ELSE coalesce(CAST(parent AS STRING), 'null') END || ', "nodes": ' || CAST(CASE WHEN id % 5 = 0 THEN nodes + 1 ELSE nodes END AS STRING) || '}' END"""
STORED = f"SELECT scope, id AS snapshot_id, parent, run_id, nodes, {DOC} AS document FROM ({BASE}) b"
HEAD = "SELECT scope, max(snapshot_id) AS head FROM stored WHERE scope <> 'r3' GROUP BY scope UNION ALL SELECT 'r9' AS scope, CAST(5 AS BIGINT) AS head"


@query("j24_check_records", oracle(f""", stored AS ({STORED}), heads AS ({HEAD}),
 d AS (SELECT *, json_valid(document) AND snapshot_id % 19 <> 0 AS readable FROM stored),
 t AS (SELECT *, CASE WHEN readable THEN json_extract_string(document, '$.run_id') END AS dr, CASE WHEN readable THEN CAST(json_extract_string(document, '$.parent') AS BIGINT) END AS dp, CASE WHEN readable THEN CAST(json_extract_string(document, '$.nodes') AS BIGINT) END AS dn FROM d)
 SELECT scope, snapshot_id AS id, 'unreadable' AS problem, NULL::VARCHAR AS field FROM t WHERE NOT readable
 UNION ALL SELECT scope, snapshot_id, 'inconsistent', CASE WHEN dp IS DISTINCT FROM parent THEN 'parent' WHEN dr <> run_id THEN 'run_id' ELSE 'nodes' END FROM t WHERE readable AND (dp IS DISTINCT FROM parent OR dr <> run_id OR dn <> nodes)
 UNION ALL SELECT scope, snapshot_id, 'broken_chain', NULL FROM stored WHERE parent IS NOT NULL AND (scope, parent) NOT IN (SELECT (scope, snapshot_id) FROM stored)
 UNION ALL SELECT scope, head, 'head_missing', NULL FROM heads WHERE (scope, head) NOT IN (SELECT (scope, snapshot_id) FROM stored)
 UNION ALL SELECT scope, max(snapshot_id), 'no_head', NULL FROM stored WHERE scope NOT IN (SELECT scope FROM heads) GROUP BY scope""", "ledger_nodes"))
def j24_records(spark, sf):
    bind(spark, sf, "ledger_nodes").createOrReplaceTempView("ledger_nodes")
    stored = spark.sql(STORED)
    stored.createOrReplaceTempView("stored")
    return R.check_records(stored, spark.sql(HEAD))
