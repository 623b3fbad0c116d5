"""Run journals, ledgers, savings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.bindings import bind, oracle
from fleetlens.operators import runs as R

QUERIES = {}
NOW = "timestamp '2024-06-30 00:00:00'"
#: Runs whose user isn't divisible by ten have a finish event.
OVER = "cast(substr(run_id, 5) as bigint) % 10 <> 0"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def events(spark, sf):
    e = bind(spark, sf, "run_events")
    return e, e.where(OVER).select("scope", "run_id").distinct()


def spans(e):
    return e.groupBy("scope", "run_id").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))


FOLD = """, g AS (
 SELECT scope, run_id, node, max(seq) FILTER (kind = 'node_started') AS s, max(seq) FILTER (kind = 'node_finished') AS f, max(seq) FILTER (kind = 'node_queued') AS q,
  arg_max(status, seq) FILTER (kind = 'node_finished') AS last_status,
  arg_max(at, seq) FILTER (kind = 'node_started') AS started_at, arg_max(at, seq) FILTER (kind = 'node_finished') AS finished_at,
  arg_max(rows_affected, seq) FILTER (kind = 'node_finished' AND rows_affected IS NOT NULL) AS rows_affected,
  arg_max({'t': thread}, seq) FILTER (kind = 'node_started' OR (kind = 'node_finished' AND thread IS NOT NULL)) AS t
 FROM run_events WHERE kind IN ('node_started', 'node_finished', 'node_queued') GROUP BY ALL
), fold AS (
 SELECT scope, run_id, node, CASE WHEN f IS NOT NULL AND (s IS NULL OR f > s) THEN coalesce(last_status, 'unknown')
   WHEN CAST(substr(run_id, 5) AS BIGINT) % 10 <> 0 THEN 'unknown'
   WHEN s IS NULL OR q > s THEN 'queued' ELSE 'running' END AS status, started_at, finished_at, rows_affected, t.t AS thread FROM g
), spans AS (SELECT scope, run_id, min(at) AS first_at, max(at) AS last_at FROM run_events GROUP BY ALL)
"""
TOTALS = FOLD + """, totals AS (
 SELECT scope, run_id, count(*) AS nodes, count(*) FILTER (status = 'success') AS n_success, count(*) FILTER (status = 'error') AS n_error, count(*) FILTER (status = 'running') AS n_running,
  count(*) FILTER (status = 'queued') AS n_queued, count(*) FILTER (status = 'unknown') AS n_unknown, CAST(sum(rows_affected) AS BIGINT) AS rows_total,
  count(*) FILTER (rows_affected IS NULL AND status NOT IN ('queued', 'skipped')) AS rows_unreported,
  CAST(floor(epoch(any_value(last_at))) - floor(epoch(any_value(first_at))) AS BIGINT) AS duration_s, count(*) FILTER (rows_affected IS NULL AND status NOT IN ('queued', 'skipped')) > 0 AS rows_at_least
 FROM fold JOIN spans USING (scope, run_id) GROUP BY scope, run_id)
"""


def folded(spark, sf):
    e, over = events(spark, sf)
    return R.fold_run(e, over), e, over


@query("e5_fold_run", oracle(FOLD + "SELECT * FROM fold", "run_events"))
def e5(spark, sf):
    return folded(spark, sf)[0]


@query("a4_run_totals", oracle(TOTALS + "SELECT * FROM totals", "run_events"))
def a4(spark, sf):
    f, e, _ = folded(spark, sf)
    return R.run_totals(f, spans(e))


VERDICT = f"""SELECT scope, run_id, CASE WHEN o IS NULL AND silent THEN 'unknown' WHEN o IS NULL THEN 'unfinished' WHEN n_error > 0 AND n_success > 0 THEN 'partial' WHEN n_error > 0 THEN 'failed'
  WHEN n_running + n_queued + n_unknown > 0 THEN 'unknown' ELSE 'succeeded' END AS verdict, o IS NULL AND silent AS inferred
 FROM (SELECT *, CASE WHEN CAST(substr(run_id, 5) AS BIGINT) % 10 <> 0 THEN true END AS o, epoch({NOW}) - floor(epoch(last_at)) > 600 AS silent FROM totals JOIN spans USING (scope, run_id))"""


@query("a5_run_verdict", oracle(TOTALS + VERDICT, "run_events"))
def a5(spark, sf):
    f, e, over = folded(spark, sf)
    s = spans(e)
    return R.run_verdict(R.run_totals(f, s), over, s.select("scope", "run_id", "last_at"), F.expr(NOW))


@query("a17_test_counts", oracle("""SELECT scope, run_id, node, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed FROM
 (SELECT scope, run_id, node, seq % 5 AS c, arg_max(status, seq) AS status FROM run_events WHERE kind = 'check_finished' GROUP BY ALL) GROUP BY ALL""", "run_events"))
def a17(spark, sf):
    return R.test_counts(bind(spark, sf, "run_events"), F.col("seq") % 5)


@query("e7_start_offsets", oracle(FOLD + "SELECT scope, run_id, node, CASE WHEN started_at >= first_at THEN CAST(floor((epoch_us(started_at) - epoch_us(first_at)) / 1000) AS BIGINT) END AS offset_ms FROM fold JOIN spans USING (scope, run_id)", "run_events"))
def e7(spark, sf):
    f, e, _ = folded(spark, sf)
    return R.start_offsets(f, spans(e))


@query("x3_live_runs", oracle(f"""SELECT scope, run_id, CASE WHEN epoch({NOW}) - floor(epoch(max(at))) <= 600 THEN 'probably_running' ELSE 'unknown' END AS state, count(*) FILTER (kind = 'node_finished') AS finished, count(*) FILTER (status = 'error') AS failed
 FROM run_events WHERE CAST(substr(run_id, 5) AS BIGINT) % 10 = 0 GROUP BY scope, run_id""", "run_events"))
def x3(spark, sf):
    e, over = events(spark, sf)
    return R.live_runs(e, over, F.expr(NOW))


@query("x7_activity_hourly", oracle("SELECT scope, date_trunc('hour', at) AS window_start, count(*) FILTER (kind = 'node_finished') AS finished, count(*) FILTER (status = 'error') AS errors FROM run_events GROUP BY ALL", "run_events"))
def x7(spark, sf):
    return R.activity(bind(spark, sf, "run_events"))


@query("x7_activity_sliding", oracle("""SELECT scope, time_bucket(INTERVAL 15 minutes, at) - INTERVAL 15 minutes * k AS window_start, count(*) FILTER (kind = 'node_finished') AS finished, count(*) FILTER (status = 'error') AS errors
 FROM run_events, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY ALL""", "run_events"))
def x7s(spark, sf):
    return R.activity(bind(spark, sf, "run_events"), "1 hour", "15 minutes")


@query("x7_activity_sessions", oracle("""SELECT scope, run_id, min(at) AS session_start, count(*) AS events FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY scope, run_id ORDER BY at, seq) AS s FROM
 (SELECT *, coalesce(at - lag(at) OVER (PARTITION BY scope, run_id ORDER BY at, seq) >= INTERVAL 10 minutes, true) AS gap FROM run_events)) GROUP BY scope, run_id, s""", "run_events"))
def x7g(spark, sf):
    return R.sessions(bind(spark, sf, "run_events"))


SAVINGS = """SELECT scope, run_id, count(*) FILTER (action = 'reused') AS reused, count(*) FILTER (action <> 'reused') AS built, count(*) FILTER (action = 'reused' AND build_ms IS NOT NULL) AS timed,
 count(*) FILTER (action = 'reused' AND build_ms IS NULL) AS untimed, coalesce(CAST(sum(build_ms) FILTER (action = 'reused') AS BIGINT), 0) AS avoided_ms,
 coalesce(string_agg(DISTINCT timed_by, ',' ORDER BY timed_by) FILTER (action = 'reused' AND build_ms IS NOT NULL), '') AS timed_by FROM ledger_nodes GROUP BY scope, run_id"""


@query("a1_run_savings", oracle(SAVINGS, "ledger_nodes"))
def a1(spark, sf):
    return R.run_savings(bind(spark, sf, "ledger_nodes"))


@query("a2_plan_savings", oracle("""SELECT p.scope, count(*) AS reused, count(build_ms) AS timed, coalesce(CAST(sum(build_ms) AS BIGINT), 0) AS avoided_ms FROM
 (SELECT DISTINCT scope, node FROM ledger_nodes WHERE action = 'reused') p LEFT JOIN (SELECT scope, node, max(build_ms) AS build_ms FROM ledger_nodes WHERE CAST(substr(node, 2) AS BIGINT) % 3 <> 0 GROUP BY ALL) s USING (scope, node) GROUP BY p.scope""", "ledger_nodes"))
def a2(spark, sf):
    led = bind(spark, sf, "ledger_nodes")
    plan = led.where("action = 'reused'").select("scope", "node").distinct().withColumn("action", F.lit("REUSE"))
    state = led.where("cast(substr(node, 2) as bigint) % 3 <> 0").groupBy("scope", "node").agg(F.max("build_ms").alias("build_ms"))
    return R.plan_savings(plan, state)


@query("a3_savings_total", oracle("""SELECT scope, count(DISTINCT (scope, run_id)) AS runs, count(*) FILTER (action = 'reused') AS reused, coalesce(CAST(sum(build_ms) FILTER (action = 'reused') AS BIGINT), 0) AS avoided_ms,
 round(coalesce(CAST(sum(build_ms) FILTER (action = 'reused') AS BIGINT), 0) / 3600000.0::DOUBLE * 2.5, 6) AS cost FROM ledger_nodes WHERE finished_at >= timestamp '1996-01-01' GROUP BY ROLLUP (scope)""", "ledger_nodes"))
def a3(spark, sf):
    return R.savings_total(bind(spark, sf, "ledger_nodes"), F.expr("timestamp '1996-01-01'"), 2.5)


@query("s10_read_ledger", oracle("""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY scope ORDER BY finished_at DESC, run_id) AS INTEGER) AS rank FROM (SELECT scope, run_id, max(finished_at) AS finished_at, count(*) AS nodes FROM ledger_nodes GROUP BY ALL)
 WHERE finished_at >= timestamp '1996-01-01') WHERE rank <= 20""", "ledger_nodes"))
def s10(spark, sf):
    return R.read_ledger(bind(spark, sf, "ledger_nodes"), F.expr("timestamp '1996-01-01'"), 20)


@query("s11_latest_snapshot", oracle("SELECT scope, arg_max(run_id, {'a': finished_at, 'b': run_id}) AS head, max(finished_at) AS at FROM ledger_nodes GROUP BY scope", "ledger_nodes"))
def s11(spark, sf):
    return R.latest(bind(spark, sf, "ledger_nodes"))


@query("e3_last_n_runs", oracle("SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY scope, node ORDER BY finished_at DESC, run_id) AS INTEGER) AS rank FROM (SELECT scope, run_id, 'n' || CAST(CAST(substr(node, 2) AS BIGINT) % 50 AS VARCHAR) AS node, action, build_ms, timed_by, finished_at FROM (SELECT DISTINCT ON (scope, run_id, CAST(substr(node, 2) AS BIGINT) % 50) * FROM ledger_nodes ORDER BY scope, run_id, CAST(substr(node, 2) AS BIGINT) % 50, finished_at DESC, node))) WHERE rank <= 5", "ledger_nodes"))
def e3(spark, sf):
    return R.node_runs(_fifty(spark, sf), 5)


def _fifty(spark, sf):
    """The ledger with fifty nodes a scope, so that nodes have a history."""
    led = bind(spark, sf, "ledger_nodes").withColumn("short", F.expr("'n' || cast(cast(substr(node, 2) as bigint) % 50 as string)"))
    # one entry a run and node: the latest, then the smallest id as text
    w = Window.partitionBy("scope", "run_id", "short").orderBy(F.desc("finished_at"), "node")
    return led.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("scope", "run_id", F.col("short").alias("node"), "action", "build_ms", "timed_by", "finished_at")


@query("a22_failure_history", oracle("""SELECT scope, node, count(*) AS runs, count(*) FILTER (action = 'failed') AS failed, count(*) FILTER (action = 'built') AS built FROM (SELECT *, row_number() OVER (PARTITION BY scope, node ORDER BY finished_at DESC, run_id) AS rank FROM
 (SELECT scope, run_id, 'n' || CAST(CAST(substr(node, 2) AS BIGINT) % 50 AS VARCHAR) AS node, action, finished_at FROM (SELECT DISTINCT ON (scope, run_id, CAST(substr(node, 2) AS BIGINT) % 50) * FROM ledger_nodes ORDER BY scope, run_id, CAST(substr(node, 2) AS BIGINT) % 50, finished_at DESC, node))) WHERE rank <= 5 GROUP BY ALL""", "ledger_nodes"))
def a22(spark, sf):
    return R.failure_history(_fifty(spark, sf))


@query("e4_prune_journals", oracle(f"""SELECT scope, run_id FROM (SELECT scope, run_id, max(at) AS last_at, row_number() OVER (PARTITION BY scope ORDER BY max(at) DESC, run_id) AS rank FROM run_events GROUP BY scope, run_id)
 WHERE rank > 10 AND epoch({NOW}) - floor(epoch(last_at)) >= 600""", "run_events"))
def e4(spark, sf):
    return R.prune_journals(spans(bind(spark, sf, "run_events")), 10, F.expr(NOW))


@query("e8_resolve_run_prefix", oracle(""", p AS (SELECT DISTINCT substr(run_id, 1, n) AS prefix FROM ledger_nodes, (SELECT unnest([7, 8]) AS n) WHERE length(run_id) >= n AND length(substr(run_id, 1, n)) >= 7)
 SELECT prefix, coalesce(max(CASE WHEN run_id = prefix THEN run_id END), CASE WHEN count(*) = 1 THEN min(run_id) END) AS run_id FROM p JOIN (SELECT DISTINCT run_id FROM ledger_nodes) r ON starts_with(r.run_id, p.prefix) GROUP BY prefix""", "ledger_nodes"))
def e8(spark, sf):
    led = bind(spark, sf, "ledger_nodes")
    p = led.select(F.explode(F.array(*[F.substring("run_id", 1, n) for n in (7, 8)])).alias("prefix")).where("length(prefix) >= 7").distinct()
    return R.resolve_run_prefix(led, p, shortest=7)


@query("p6_run_filter", oracle("SELECT scope, run_id, node, action FROM ledger_nodes WHERE finished_at >= timestamp '1998-01-01' - INTERVAL 365 days", "ledger_nodes"))
def p6(spark, sf):
    return R.run_filter(bind(spark, sf, "ledger_nodes"), F.expr("timestamp '1998-01-01'"), 365).select("scope", "run_id", "node", "action")


@query("e2_thread_lanes", oracle("""SELECT run_id, thread, count(*) AS bars, CAST(sum(greatest(e - greatest(s, coalesce(covered, s)), 0)) AS BIGINT) AS busy_s, CAST(any_value(span) - sum(greatest(e - greatest(s, coalesce(covered, s)), 0)) AS BIGINT) AS idle_s FROM
 (SELECT *, max(e) OVER (PARTITION BY run_id, thread ORDER BY s, e, node, part_no, tiebreak ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered, max(e) OVER (PARTITION BY run_id) - min(s) OVER (PARTITION BY run_id) AS span FROM
 (SELECT *, CAST(epoch(start_at) AS BIGINT) AS s, CAST(epoch(start_at) AS BIGINT) + took_days * 86400 AS e FROM thread_bars)) GROUP BY run_id, thread""", "thread_bars"))
def e2(spark, sf):
    b = bind(spark, sf, "thread_bars").withColumn("start_s", F.unix_timestamp("start_at"))
    return R.thread_lanes(b.withColumn("end_s", F.col("start_s") + F.col("took_days") * 86400))


@query("e6_critical_path", oracle(FOLD + """, e AS (SELECT 'n' || CAST(x AS VARCHAR) AS parent, 'n' || CAST(y AS VARCHAR) AS child FROM range(17) a(x), range(17) b(y) WHERE x < y AND (x + y) % 3 = 0),
 done AS (SELECT *, coalesce(started_at, finished_at) AS st FROM fold WHERE finished_at IS NOT NULL),
 best AS (SELECT scope, run_id, child AS node, arg_min(node, {'a': -epoch_us(finished_at), 'b': epoch_us(st), 'c': node}) AS parent FROM done JOIN e ON node = parent GROUP BY ALL),
 walk AS (SELECT scope, run_id, arg_min(node, {'a': -epoch_us(finished_at), 'b': epoch_us(st), 'c': node}) AS node, 0 AS step FROM done GROUP BY scope, run_id UNION ALL SELECT scope, run_id, parent, step + 1 FROM walk JOIN best USING (scope, run_id, node)) SELECT * FROM walk""", "run_events"))
def e6(spark, sf):
    e = spark.range(17).select(F.col("id").alias("x")).join(spark.range(17).select(F.col("id").alias("y")), F.expr("x < y and (x + y) % 3 = 0"))
    e = e.select(F.concat(F.lit("n"), F.col("x")).alias("parent"), F.concat(F.lit("n"), F.col("y")).alias("child"))
    return R.critical_path(folded(spark, sf)[0], F.broadcast(e))
