"""Fingerprints, versions, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.bindings import bind, oracle
from fleetlens.operators import state as S

QUERIES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def view(spark, sf, sql: str, *names: str):
    """A SELECT over bindings, which Spark and DuckDB both run."""
    for n in names:
        bind(spark, sf, n).createOrReplaceTempView(n)
    return spark.sql(sql)


@query("a19_fingerprint", oracle("SELECT node, sha256(string_agg(component || chr(0) || sha256(content) || chr(10), '' ORDER BY component)) AS digest FROM fp_before GROUP BY node", "fp_before"))
def a19(spark, sf):
    return S.fingerprint(bind(spark, sf, "fp_before"))


DIFF = "SELECT node, component, CASE WHEN b.content IS NULL THEN 'added' WHEN a.content IS NULL THEN 'removed' ELSE 'changed' END AS change FROM fp_before b FULL JOIN fp_after a USING (node, component) WHERE b.content IS DISTINCT FROM a.content"


@query("j5_fingerprint_diff", oracle(DIFF, "fp_before", "fp_after"))
def j5(spark, sf):
    return S.fingerprint_diff(bind(spark, sf, "fp_before"), bind(spark, sf, "fp_after"))


@query("j6_cosmetic_changes", oracle("SELECT node, component FROM fp_before b JOIN fp_after a USING (node, component) WHERE b.content <> a.content AND rtrim(b.content, '!') = rtrim(a.content, '!')", "fp_before", "fp_after"))
def j6(spark, sf):
    return S.cosmetic_changes(bind(spark, sf, "fp_before"), bind(spark, sf, "fp_after"), F.expr("rtrim('!', content)"))


@query("u1_added_removed", oracle("SELECT node, 'added' AS verdict FROM (SELECT node FROM fp_after EXCEPT SELECT node FROM fp_before) UNION ALL SELECT node, 'removed' FROM (SELECT node FROM fp_before EXCEPT SELECT node FROM fp_after)", "fp_before", "fp_after"))
def u1(spark, sf):
    b, a = bind(spark, sf, "fp_before").select("node").distinct(), bind(spark, sf, "fp_after").select("node").distinct()
    return a.join(b, "node", "left_anti").withColumn("verdict", F.lit("added")).unionByName(b.join(a, "node", "left_anti").withColumn("verdict", F.lit("removed")))


OLD = "SELECT scope, node, run_id FROM ledger_nodes WHERE CAST(substr(node, 2) AS BIGINT) % 4 <> 1"
NEW = "SELECT scope, node, CASE WHEN CAST(substr(node, 2) AS BIGINT) % 3 = 0 THEN run_id || 'b' ELSE run_id END AS run_id FROM ledger_nodes WHERE CAST(substr(node, 2) AS BIGINT) % 5 <> 2"


@query("j7_diff_states", oracle(f"SELECT * FROM (SELECT scope, node, CASE WHEN o.run_id IS NULL THEN 'added' WHEN n.run_id IS NULL THEN 'removed' WHEN o.run_id <> n.run_id THEN 'rebuilt' END AS verdict FROM ({OLD}) o FULL JOIN ({NEW}) n USING (scope, node)) WHERE verdict IS NOT NULL", "ledger_nodes"))
def j7(spark, sf):
    return S.diff_states(view(spark, sf, OLD, "ledger_nodes"), view(spark, sf, NEW, "ledger_nodes"))


@query("j8_diff_project", oracle(f"SELECT DISTINCT node AS id, 'code' AS what FROM ({DIFF}) UNION ALL SELECT source, 'source' FROM source_versions WHERE recorded_version IS DISTINCT FROM now_version AND source IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 10)", "fp_before", "fp_after", "source_versions"))
def j8(spark, sf):
    reads = bind(spark, sf, "supplier").where("s_nationkey < 10").select(F.col("s_suppkey").alias("source"))
    return S.diff_project(bind(spark, sf, "fp_before"), bind(spark, sf, "fp_after"), bind(spark, sf, "source_versions"), reads)


HIST = "SELECT DISTINCT scope, year(finished_at) AS snapshot, 'n' || CAST(CAST(substr(node, 2) AS BIGINT) % 500 AS STRING) AS node FROM ledger_nodes"


@query("e1_node_history", oracle(f""", h AS ({HIST}), s AS (SELECT scope, snapshot, row_number() OVER (PARTITION BY scope ORDER BY snapshot) AS n FROM (SELECT DISTINCT scope, snapshot FROM h)), l AS (SELECT scope, max(n) AS last FROM s GROUP BY scope),
 o AS (SELECT h.scope, h.node, n, lag(n) OVER w AS b, lead(n) OVER w AS a FROM h JOIN s USING (scope, snapshot) WINDOW w AS (PARTITION BY h.scope, h.node ORDER BY n)), ev AS (SELECT scope, node, n, CASE WHEN b IS NULL THEN 'first' ELSE 'built' END AS event FROM o
 UNION ALL SELECT o.scope, node, n + 1, 'dropped' FROM o JOIN l USING (scope) WHERE n < last AND (a IS NULL OR a > n + 1)) SELECT ev.scope, node, CAST(snapshot AS INTEGER) AS snapshot, event FROM ev JOIN s USING (scope, n)""", "ledger_nodes"))
def e1(spark, sf):
    return S.node_history(view(spark, sf, HIST, "ledger_nodes"))


READ = "SELECT source, 0 AS rank, 'relation' AS strategy, CASE WHEN source % 3 = 0 THEN CAST(now_version AS STRING) END AS version FROM source_versions UNION ALL SELECT source, 1, 'freshness', CASE WHEN source % 5 <> 1 THEN 'f' || CAST(source AS STRING) END FROM source_versions"


@query("j9_choose_source_versions", oracle(f", r AS ({READ}) SELECT source, arg_min(version, rank) FILTER (version IS NOT NULL) AS version, coalesce(arg_min(strategy, rank) FILTER (version IS NOT NULL), 'none') AS strategy, coalesce(string_agg(strategy, ',' ORDER BY strategy) FILTER (version IS NULL), '') AS without FROM r GROUP BY source", "source_versions"))
def j9(spark, sf):
    return S.choose_source_versions(view(spark, sf, READ, "source_versions"))


RA = "SELECT source, recorded_version AS version, CAST(source % 3 AS BIGINT) AS taken_at FROM source_versions WHERE source % 7 <> 0"
RB = "SELECT source, now_version AS version, CAST(source % 2 AS BIGINT) AS taken_at FROM source_versions WHERE source % 11 <> 0"


@query("j10_merge_readings", oracle(f"SELECT source, CASE WHEN b.taken_at IS NULL OR a.taken_at > b.taken_at THEN a.version WHEN a.taken_at IS NULL OR b.taken_at > a.taken_at THEN b.version WHEN a.version IS NOT DISTINCT FROM b.version THEN a.version END AS version, greatest(a.taken_at, b.taken_at) AS taken_at FROM ({RA}) a FULL JOIN ({RB}) b USING (source)", "source_versions"))
def j10(spark, sf):
    return S.merge_readings(view(spark, sf, RA, "source_versions"), view(spark, sf, RB, "source_versions"))


CHK = "SELECT source, source % 9 <> 0 AS tested, source % 8 = 0 AS checks_changed, CASE WHEN source % 6 = 5 THEN now_version + INTERVAL '1' DAY ELSE recorded_version END AS recorded_version, now_version FROM source_versions"


@query("g15_source_checks", oracle(f", c AS ({CHK}), r AS (SELECT source, CASE WHEN NOT tested THEN 'not_tested' WHEN checks_changed THEN 'checks_changed' WHEN now_version IS NULL OR recorded_version IS NULL THEN 'version_unknown' WHEN now_version < recorded_version THEN 'version_stale' WHEN now_version > recorded_version THEN 'version_moved' ELSE 'unchanged' END AS reason FROM c) SELECT source, CASE reason WHEN 'unchanged' THEN 'SKIP' ELSE 'TEST' END AS action, reason FROM r", "source_versions"))
def g15(spark, sf):
    return S.source_checks(view(spark, sf, CHK, "source_versions"))


RES = "SELECT scope, node, 'new' AS run_id, timestamp '2024-01-01 00:00:00' AS at, action, 'fp' || node AS fp FROM ledger_nodes WHERE CAST(substr(node, 2) AS BIGINT) % 3 <> 0"
PREV = "SELECT scope, node, run_id, finished_at AS built_at, 'old' || node AS fp, run_id AS tested FROM ledger_nodes WHERE CAST(substr(node, 2) AS BIGINT) % 4 <> 0"


@query("g17_record", oracle(f"SELECT scope, node, CASE WHEN action = 'built' THEN r.run_id ELSE p.run_id END AS run_id, CASE WHEN action = 'built' THEN \"at\" ELSE built_at END AS built_at, CASE WHEN action = 'built' THEN r.fp ELSE p.fp END AS fp, CASE WHEN action IN ('built', 'failed') THEN NULL ELSE tested END AS tested FROM ({PREV}) p FULL JOIN ({RES}) r USING (scope, node) WHERE action = 'built' OR p.run_id IS NOT NULL", "ledger_nodes"))
def g17(spark, sf):
    return S.record(view(spark, sf, RES, "ledger_nodes"), view(spark, sf, PREV, "ledger_nodes"))


# Every check that finished, in a scope for each run: some of its nodes have none, some only passed ones, some a failed one.
ST_ALL = "SELECT DISTINCT scope || '/' || run_id AS scope, node, 'old' AS tested FROM run_events"
TE_ALL = "SELECT scope || '/' || run_id AS scope, node, status, run_id FROM run_events WHERE kind = 'check_finished'"
RECORDED = "SELECT s.scope, s.node AS {key}, CASE WHEN fine IS NULL THEN tested WHEN fine THEN b END AS tested FROM ({st}) s LEFT JOIN (SELECT scope, node, bool_and(status = 'passed') AS fine, max(run_id) AS b FROM ({te}) GROUP BY ALL) t USING (scope, node)"


@query("g18_record_tests", oracle(RECORDED.format(key="node", st=ST_ALL, te=TE_ALL), "run_events"))
def g18(spark, sf):
    return S.record_tests(view(spark, sf, ST_ALL, "run_events"), view(spark, sf, TE_ALL, "run_events"))


@query("g19_record_source_checks", oracle(RECORDED.format(key="source", st=ST_ALL, te=TE_ALL), "run_events"))
def g19(spark, sf):
    return S.record_tests(view(spark, sf, ST_ALL, "run_events").withColumnRenamed("node", "source"), view(spark, sf, TE_ALL, "run_events").withColumnRenamed("node", "source"), "source")


SNAP = "SELECT scope, finished_at AS created_at, CAST(substr(node, 2) AS BIGINT) AS snapshot_id, run_id AS by_run, CASE WHEN CAST(substr(node, 2) AS BIGINT) % 40 = 0 THEN -1 WHEN CAST(substr(node, 2) AS BIGINT) % 10 = 0 THEN CAST(substr(node, 2) AS BIGINT) END AS parent FROM ledger_nodes"
RUNS = "SELECT scope, run_id, min(finished_at) AS started_at FROM ledger_nodes GROUP BY scope, run_id"


@query("j21_states_around", oracle(f", s AS ({SNAP}), r AS ({RUNS}), b AS (SELECT r.scope, r.run_id, arg_max(snapshot_id, {{'t': created_at, 'i': snapshot_id}}) AS before FROM r LEFT JOIN s ON s.scope = r.scope AND s.created_at < r.started_at GROUP BY ALL) SELECT b.scope, b.run_id, before, s.snapshot_id AS committed FROM b LEFT JOIN s ON s.scope = b.scope AND s.by_run = b.run_id", "ledger_nodes"))
def j21(spark, sf):
    return S.states_around(view(spark, sf, RUNS, "ledger_nodes"), view(spark, sf, SNAP, "ledger_nodes"))


HEADS = "SELECT scope, max(snapshot_id) AS head, 'run-x' AS run_id FROM snap WHERE scope <> 'r3' GROUP BY scope UNION ALL SELECT 'r9', CAST(5 AS BIGINT), 'run-y'"


def snaps(spark, sf):
    s = view(spark, sf, SNAP, "ledger_nodes")
    s.createOrReplaceTempView("snap")
    return s, spark.sql(HEADS)


@query("j24_check_snapshots", oracle(f", snap AS ({SNAP}), heads AS ({HEADS}) SELECT scope, snapshot_id AS id, 'parent_missing' AS problem FROM snap WHERE parent IS NOT NULL AND (scope, parent) NOT IN (SELECT (scope, snapshot_id) FROM snap) UNION ALL SELECT scope, head, 'head_missing' FROM heads ANTI JOIN (SELECT scope, snapshot_id AS head FROM snap) USING (scope, head) UNION ALL SELECT scope, snapshot_id, 'no_head' FROM snap ANTI JOIN heads USING (scope)", "ledger_nodes"))
def j24(spark, sf):
    return S.check_snapshots(*snaps(spark, sf))


CAND = "SELECT s.scope, snapshot_id + 1 AS snapshot_id, CASE WHEN snapshot_id % 20 = 0 THEN h.head ELSE snapshot_id END AS parent, CASE WHEN snapshot_id % 70 = 0 THEN 'run-x' ELSE by_run END AS run_id FROM snap s LEFT JOIN heads h ON h.scope = s.scope"


@query("s12_append_snapshots", oracle(f", snap AS ({SNAP}), heads AS ({HEADS}), cand AS ({CAND}) SELECT c.scope, c.snapshot_id, c.parent, CASE WHEN c.run_id IS NOT DISTINCT FROM h.run_id THEN 'already_there' WHEN c.parent IS NOT DISTINCT FROM h.head THEN 'accepted' ELSE 'conflict' END AS verdict FROM cand c LEFT JOIN heads h USING (scope)", "ledger_nodes"))
def s12(spark, sf):
    _, heads = snaps(spark, sf)
    heads.createOrReplaceTempView("heads")
    return S.append_snapshots(spark.sql(CAND), heads)


TGT = "SELECT scope, node, run_id, CASE action WHEN 'built' THEN 'prod' WHEN 'reused' THEN 'dev' END AS target FROM ledger_nodes"


@query("j28_in_target", oracle(f"SELECT scope, node, CASE WHEN target = 'prod' THEN run_id END AS run_id FROM ({TGT})", "ledger_nodes"))
def j28(spark, sf):
    return S.in_target(view(spark, sf, TGT, "ledger_nodes"), F.lit("prod"))


INP = "SELECT l_suppkey AS source, year(l_shipdate) AS version, l_shipdate AS built_at, 'run-' || CAST(l_orderkey AS STRING) AS run_id FROM lineitem"


@query("a13_recorded_versions", f"WITH i AS ({INP}) SELECT source, CAST(version AS INTEGER) AS version, count(*) AS readers, max(built_at) AS newest, arg_max(run_id, {{'a': built_at, 'b': run_id}}) AS run_id FROM i GROUP BY ALL")
def a13(spark, sf):
    return S.recorded_versions(view(spark, sf, INP, "lineitem"))


PTR = "SELECT p_partkey AS node, p_partkey % 17 = 0 AS selected, p_partkey % 13 <> 0 AS in_upstream, p_partkey % 5 <> 0 AS built_here, p_partkey % 7 <> 0 AS same_code, CASE p_partkey % 9 WHEN 1 THEN 'missing' WHEN 2 THEN 'unverified' ELSE 'present' END AS relation_here, CASE p_partkey % 11 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS data_moved FROM part"
PTRS = f"SELECT node, CASE WHEN selected OR NOT in_upstream THEN 'this_target' WHEN NOT built_here OR NOT same_code OR data_moved IS NULL OR data_moved OR relation_here <> 'present' THEN 'upstream' ELSE 'this_target' END AS pointer, CASE WHEN selected THEN 'selected' WHEN NOT in_upstream THEN 'not_upstream' WHEN NOT built_here THEN 'never_built_here' WHEN NOT same_code THEN 'code_differs' WHEN data_moved IS NULL THEN 'data_unknown' WHEN data_moved THEN 'data_moved' WHEN relation_here = 'missing' THEN 'relation_missing' WHEN relation_here = 'unverified' THEN 'relation_unverified' ELSE 'unchanged' END AS reason FROM ({PTR})"


@query("j11_choose_pointers", PTRS)
def j11(spark, sf):
    return S.choose_pointers(view(spark, sf, PTR, "part"))


@query("j12_defer_candidates", f"SELECT node FROM ({PTR}) WHERE NOT selected AND in_upstream AND built_here AND same_code AND NOT data_moved")
def j12(spark, sf):
    return S.defer_candidates(view(spark, sf, PTR, "part"))


@query("s17_deferred_relations", f"SELECT node, CASE WHEN pointer = 'this_target' AND p_partkey % 2 = 0 THEN 'here.' || p_name ELSE 'up.' || p_name END AS relation FROM ({PTRS}) JOIN part ON p_partkey = node")
def s17(spark, sf):
    p = view(spark, sf, PTR, "part")
    part = bind(spark, sf, "part")
    up = part.select(F.col("p_partkey").alias("node"), F.concat(F.lit("up."), "p_name").alias("relation"))
    here = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("node"), F.concat(F.lit("here."), "p_name").alias("relation"))
    return S.deferred_relations(up, here, S.choose_pointers(p))


@query("j17_relation_check", "SELECT p_partkey AS node, CASE WHEN p_partkey % 6 = 0 THEN 'missing' WHEN p_partkey % 4 = 1 THEN 'unverified' ELSE 'present' END AS fact FROM part")
def j17(spark, sf):
    part = bind(spark, sf, "part")
    expected = part.select(F.col("p_partkey").alias("node"), F.concat(F.lit("DB.T"), "p_partkey").alias("relation"))
    present = part.where("p_partkey % 6 <> 0").select(F.concat(F.lit("db.t"), "p_partkey").alias("relation"), F.expr("p_partkey % 4 <> 1").alias("verified"))
    return S.relation_check(expected, present)


OFF = "SELECT n_name AS scope, c AS capability FROM nation CROSS JOIN (SELECT 'a' AS c UNION ALL SELECT 'b' UNION ALL SELECT 'c') x WHERE c = 'c' OR (c = 'a' AND n_nationkey % 2 = 0) OR (c = 'b' AND n_nationkey % 3 = 0)"


@query("d6_choose_strategy", "SELECT n_name AS scope, CASE WHEN n_nationkey % 6 = 0 THEN 'best' WHEN n_nationkey % 2 = 0 THEN 'good' ELSE 'fallback' END AS strategy FROM nation")
def d6(spark, sf):
    offers = view(spark, sf, OFF, "nation")
    strategies = spark.sql("SELECT 'best' AS strategy, 0 AS rank, array('a', 'b') AS requires UNION ALL SELECT 'good', 1, array('a') UNION ALL SELECT 'fallback', 2, cast(array() as array<string>)")
    return S.choose_strategy(offers, strategies)


RL = ["SELECT DISTINCT scope, run_id FROM ledger_nodes WHERE action = 'built'", "SELECT DISTINCT scope, run_id, CASE WHEN CAST(substr(run_id, 5) AS BIGINT) % 3 = 0 THEN 'failed' ELSE 'success' END AS outcome FROM ledger_nodes WHERE CAST(substr(run_id, 5) AS BIGINT) % 2 = 0", "SELECT DISTINCT scope, run_id, 'partial' AS outcome FROM ledger_nodes WHERE CAST(substr(run_id, 5) AS BIGINT) % 5 < 2"]


@query("j26_run_list", oracle(f"SELECT scope, run_id, coalesce(l.outcome, j.outcome, s.so) AS outcome, concat_ws('+', CASE WHEN s.so IS NOT NULL THEN 'snapshot' END, CASE WHEN l.outcome IS NOT NULL THEN 'ledger' END, CASE WHEN j.outcome IS NOT NULL THEN 'journal' END) AS seen_in FROM (SELECT *, 'success' AS so FROM ({RL[0]})) s FULL JOIN ({RL[1]}) l USING (scope, run_id) FULL JOIN ({RL[2]}) j USING (scope, run_id)", "ledger_nodes"))
def j26(spark, sf):
    return S.run_list(*[view(spark, sf, x, "ledger_nodes") for x in RL])
