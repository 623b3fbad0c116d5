"""The full fold of run journals, in batch and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.bindings import bind, oracle
from fleetlens.operators import fold as O
from fleetlens.plans.shared import checkpoint_dir
from fleetlens.sources.artifacts import parse_journal
from fleetlens.streaming import journals, live

QUERIES = {}
NOW = "timestamp '2024-01-30 12:00:00'"
MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def journal(spark: SparkSession, sf: str) -> DataFrame:
    """The bound journal, its lists and maps as such."""
    j = bind(spark, sf, "run_journal")
    return j.select(
        "scope", "run_id", "seq", F.col("at").cast("timestamp").alias("at"), "kind", "node", "status", "thread",
        F.col("started_at").cast("timestamp").alias("started_at"), F.col("finished_at").cast("timestamp").alias("finished_at"), "duration_ms", "compile_ms", "execute_ms", "rows_affected", "error",
        F.when(F.col("query_id").isNotNull(), F.create_map(F.lit("query_id"), "query_id")).alias("adapter"), F.split("blockers", ",").alias("blocked_by"),
        F.when(F.col("passed").isNotNull(), F.struct("passed", "failed", "warned", "skipped")).alias("tests"), F.col("check_id").alias("check"), F.split("covered", ",").alias("covers"),
        F.split("listed", ",").alias("nodes"), "mode", "live", "outcome",
    )


def flat(folded: DataFrame) -> DataFrame:
    return folded.select(
        "scope", "run_id", "node", "requested", "status", "started_at", "finished_at", "duration_ms", "compile_ms", "execute_ms", "rows_affected", "thread", "error",
        F.col("adapter")["query_id"].alias("query_id"), F.coalesce(F.array_join("blocked_by", ","), F.lit("")).alias("blockers"), *[F.col("tests")[k].alias(k) for k in O.COUNTS],
    )


#: One event a step for each node: the fold as a loop, by a recursive query.
WALK = """, ne AS (
 SELECT scope, run_id, node, seq, false AS asked FROM run_journal WHERE kind LIKE 'node%' UNION ALL
 SELECT scope, run_id, unnest(string_split(listed, ',')), seq, true FROM run_journal WHERE kind = 'run_started'
), firsts AS (SELECT scope, run_id, node, min(seq) AS first, arg_min(asked, seq) AS requested FROM ne GROUP BY ALL),
chk AS (
 SELECT scope, run_id, seq, covered, status, lag(covered) OVER w AS old_covered, lag(status) OVER w AS old_status FROM run_journal WHERE kind = 'check_finished' WINDOW w AS (PARTITION BY scope, run_id, check_id ORDER BY seq)
), cov AS (
 SELECT scope, run_id, seq, unnest(string_split(covered, ',')) AS node, status, 1 AS n FROM chk UNION ALL SELECT scope, run_id, seq, unnest(string_split(old_covered, ',')), old_status, -1 FROM chk WHERE old_covered IS NOT NULL
), steps0 AS (
 SELECT scope, run_id, node, seq, kind, at, status, thread, started_at, finished_at, duration_ms, compile_ms, execute_ms, rows_affected, query_id, error, blockers, passed, failed, warned, skipped,
  0 AS ap, 0 AS af, 0 AS aw, 0 AS ask, 0 AS rp, 0 AS rf, 0 AS rw, 0 AS rs, 0 AS adds FROM run_journal WHERE kind LIKE 'node%'
 UNION ALL SELECT f.scope, f.run_id, f.node, j.seq, j.kind, j.at, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, 0, 0, 0, 0, 0, 0, 0, 0
  FROM firsts f JOIN run_journal j ON f.scope = j.scope AND f.run_id = j.run_id AND j.kind = 'run_finished' AND f.first < j.seq
 UNION ALL SELECT c.scope, c.run_id, c.node, c.seq, 'check', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  count(*) FILTER (n > 0 AND status = 'passed'), count(*) FILTER (n > 0 AND status = 'failed'), count(*) FILTER (n > 0 AND status = 'warned'), count(*) FILTER (n > 0 AND status IN ('skipped', 'unknown')),
  count(*) FILTER (n < 0 AND status = 'passed'), count(*) FILTER (n < 0 AND status = 'failed'), count(*) FILTER (n < 0 AND status = 'warned'), count(*) FILTER (n < 0 AND status IN ('skipped', 'unknown')), count(*) FILTER (n > 0)
  FROM cov c JOIN firsts f ON f.scope = c.scope AND f.run_id = c.run_id AND f.node = c.node AND f.first < c.seq GROUP BY c.scope, c.run_id, c.node, c.seq
), steps AS (SELECT *, row_number() OVER (PARTITION BY scope, run_id, node ORDER BY seq) AS n FROM steps0),
walk AS (
 SELECT scope, run_id, node, requested, CAST(0 AS BIGINT) AS n, 'queued' AS status, CAST(NULL AS TIMESTAMP) AS started_at, CAST(NULL AS TIMESTAMP) AS finished_at, CAST(NULL AS BIGINT) AS duration_ms, CAST(NULL AS BIGINT) AS compile_ms,
  CAST(NULL AS BIGINT) AS execute_ms, CAST(NULL AS BIGINT) AS rows_affected, CAST(NULL AS VARCHAR) AS thread, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS VARCHAR) AS query_id, '' AS blockers,
  CAST(NULL AS BIGINT) AS passed, CAST(NULL AS BIGINT) AS failed, CAST(NULL AS BIGINT) AS warned, CAST(NULL AS BIGINT) AS skipped FROM firsts
 UNION ALL
 SELECT w.scope, w.run_id, w.node, w.requested, w.n + 1,
  CASE s.kind WHEN 'node_queued' THEN CASE WHEN w.status IN ('queued', 'running') THEN 'queued' ELSE w.status END WHEN 'node_started' THEN 'running' WHEN 'node_finished' THEN s.status
   WHEN 'run_finished' THEN CASE WHEN w.status IN ('queued', 'running') THEN 'unknown' ELSE w.status END ELSE w.status END,
  CASE WHEN s.kind = 'node_started' THEN s.at WHEN s.kind = 'node_finished' THEN coalesce(s.started_at, w.started_at) ELSE w.started_at END, coalesce(s.finished_at, w.finished_at), coalesce(s.duration_ms, w.duration_ms),
  coalesce(s.compile_ms, w.compile_ms), coalesce(s.execute_ms, w.execute_ms), coalesce(s.rows_affected, w.rows_affected), CASE WHEN s.kind = 'node_started' THEN s.thread ELSE coalesce(s.thread, w.thread) END,
  CASE WHEN s.kind <> 'node_finished' THEN w.error WHEN s.error IS NULL AND s.status = 'error' THEN w.error ELSE s.error END, coalesce(s.query_id, w.query_id),
  CASE WHEN s.kind <> 'node_finished' THEN w.blockers WHEN s.blockers IS NULL AND s.status = 'skipped' THEN w.blockers ELSE coalesce(s.blockers, '') END,
  {passed}, {failed}, {warned}, {skipped}
 FROM walk w JOIN steps s ON s.scope = w.scope AND s.run_id = w.run_id AND s.node = w.node AND s.n = w.n + 1
), ended AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY scope, run_id, node ORDER BY n DESC) = 1)
"""
for _k, _add, _back in (("passed", "ap", "rp"), ("failed", "af", "rf"), ("warned", "aw", "rw"), ("skipped", "ask", "rs")):
    WALK = WALK.replace(
        f"{{{_k}}}",
        f"CASE WHEN s.kind = 'check' THEN CASE WHEN w.{_k} IS NULL AND s.adds = 0 THEN NULL ELSE greatest(coalesce(w.{_k}, 0) - s.{_back}, 0) + s.{_add} END "
        f"WHEN s.{_k} IS NULL THEN w.{_k} WHEN w.status IN ('queued', 'running') THEN s.{_k} + coalesce(w.{_k}, 0) ELSE s.{_k} END",
    )
FIELDS = "scope, run_id, node, requested, status, started_at, finished_at, duration_ms, compile_ms, execute_ms, rows_affected, thread, error, query_id, blockers, passed, failed, warned, skipped"


@query("e5_fold_nodes", oracle(f"{WALK} SELECT {FIELDS} FROM ended", "run_journal"))
def e5_nodes(spark, sf):
    return flat(O.fold_nodes(journal(spark, sf)))


@query("e5_fold_runs", oracle("""SELECT scope, run_id, arg_max(mode, seq) FILTER (kind = 'run_started') AS mode, arg_max(live, seq) FILTER (kind = 'run_started') AS live, arg_max(at, seq) FILTER (kind = 'run_started') AS started_at,
 arg_max(at, seq) FILTER (kind = 'run_finished') AS finished_at, arg_max(outcome, seq) FILTER (kind = 'run_finished') AS outcome, max(at) AS last_at FROM run_journal GROUP BY ALL""", "run_journal"))
def e5_runs(spark, sf):
    return O.fold_runs(O.partial(journal(spark, sf)))


SILENT = f"""{WALK} SELECT scope, run_id, node, CASE WHEN silent AND status IN ('queued', 'running') THEN 'unknown' ELSE status END AS status, silent AND status IN ('queued', 'running') AS inferred
 FROM ended JOIN (SELECT scope, run_id, count(*) FILTER (kind = 'run_finished') = 0 AND epoch({NOW}) - floor(epoch(max(at))) > 600 AS silent FROM run_journal GROUP BY ALL) USING (scope, run_id)"""


@query("x4_stalled_runs", oracle(SILENT, "run_journal"))
def x4(spark, sf):
    return O.fold_nodes(journal(spark, sf), F.expr(NOW)).select("scope", "run_id", "node", "status", "inferred")


def replay(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """The journal as lines of JSON, shuffled over files, every tenth line twice and every fiftieth torn once more."""
    j = journal(spark, sf)
    lines = j.select("scope", "seq", F.to_json(F.struct(*[c for c in j.columns if c != "scope"]), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value"))
    torn = F.expr("substring(value, 1, length(value) - 5)")
    copies = F.array_compact(F.array("value", F.when(F.col("seq") % 10 == 0, F.col("value")), F.when(F.col("seq") % 50 == 0, torn)))
    root = f"{checkpoint_dir(spark).rstrip('/')}/fleetlens/{uuid.uuid4().hex}"
    every = lines.select("scope", "seq", F.explode(copies).alias("value"))
    every.repartition(6, F.xxhash64("value", "seq")).select("scope", "value").write.partitionBy("scope").text(f"{root}/journals")
    return journals.stream_journals(spark, f"{root}/journals", files_per_trigger=8), root


@query("x2_live_fold", oracle(f"{WALK} SELECT {FIELDS} FROM ended", "run_journal"))
def x2(spark, sf):
    """The journal in shuffled files of lines, in batches, through two starts of the stream, with a compaction."""
    lines, root = replay(spark, sf)
    into = live.FoldTable(spark, f"{root}/fold", compact_every=3, keep="INTERVAL 365 DAYS")
    for _ in range(2):
        live.live_fold(parse_journal(lines)[0], into, f"{root}/place").awaitTermination()
    return flat(into.nodes())


@query("x6_unreadable_lines", oracle("SELECT scope, count(*) FILTER (seq % 50 = 0) AS unreadable FROM run_journal GROUP BY scope", "run_journal"))
def x6(spark, sf):
    lines, root = replay(spark, sf)
    name = f"unreadable_{uuid.uuid4().hex}"
    journals.follow(journals.unreadable_lines(lines), name, "complete").awaitTermination()
    return spark.table(name)
