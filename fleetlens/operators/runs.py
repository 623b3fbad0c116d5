"""Run journals, ledgers and savings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.plans.walk import walk

RUN = ["scope", "run_id"]
NODE = ["scope", "run_id", "node"]
#: A run without a finish event counts as live for so long after its last event.
LIVE_SECONDS = 600


def _micros(at: Column | str) -> Column:
    return F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp"))


def fold_run(events: DataFrame, finished_runs: DataFrame) -> DataFrame:
    """E5: the last state of each node of each run, from unordered events with a total order ``seq``.

    Later finishes correct earlier ones field by field and keep what they don't know; a start
    reopens a node and sets its thread even to null; a queue event counts only before a finish.
    In finished runs, nodes without a finish are ``unknown``. One shuffle by (scope, run, node).
    """
    started, finished, queued = F.col("kind") == "node_started", F.col("kind") == "node_finished", F.col("kind") == "node_queued"
    sets_thread = started | (finished & F.col("thread").isNotNull())
    g = events.where(started | finished | queued).groupBy(*NODE).agg(
        F.max(F.when(started, F.col("seq"))).alias("s"), F.max(F.when(finished, F.col("seq"))).alias("f"), F.max(F.when(queued, F.col("seq"))).alias("q"),
        F.max_by("status", F.when(finished, F.col("seq"))).alias("last_status"),
        F.max_by("at", F.when(started, F.col("seq"))).alias("started_at"), F.max_by("at", F.when(finished, F.col("seq"))).alias("finished_at"),
        F.max_by("rows_affected", F.when(finished & F.col("rows_affected").isNotNull(), F.col("seq"))).alias("rows_affected"),
        F.max_by(F.struct("thread"), F.when(sets_thread, F.col("seq"))).alias("t"),
    )
    is_done = F.col("f").isNotNull() & (F.col("s").isNull() | (F.col("f") > F.col("s")))
    state = F.when(is_done, F.coalesce("last_status", F.lit("unknown"))).when(F.col("s").isNull() | (F.col("q") > F.col("s")), "queued").otherwise("running")
    g = g.join(finished_runs.select(*RUN).distinct().withColumn("over", F.lit(True)), RUN, "left")
    state = F.when(F.col("over") & ~is_done, "unknown").otherwise(state)
    return g.select(*NODE, state.alias("status"), "started_at", "finished_at", "rows_affected", F.col("t.thread").alias("thread"))


def test_counts(events: DataFrame, check: Column) -> DataFrame:
    """Check results per node; a later event for the same check replaces the earlier one."""
    last = events.where(F.col("kind") == "check_finished").groupBy(*NODE, check.alias("check")).agg(F.max_by("status", "seq").alias("status"))
    return last.groupBy(*NODE).agg(F.count_if(F.col("status") == "passed").alias("passed"), F.count_if(F.col("status") == "failed").alias("failed"))


def run_totals(folded: DataFrame, spans: DataFrame) -> DataFrame:
    """A4: nodes by status, rows, and how many finished nodes reported no rows; ``spans(scope, run_id, first_at, last_at)``."""
    g = folded.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("nodes"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("success", "error", "running", "queued", "unknown")],
        F.sum("rows_affected").alias("rows_total"), F.count_if(F.col("rows_affected").isNull() & ~F.col("status").isin("queued", "skipped")).alias("rows_unreported"),
    )
    out = g.join(spans, RUN).withColumn("duration_s", (F.unix_timestamp("last_at") - F.unix_timestamp("first_at")))
    return out.withColumn("rows_at_least", F.col("rows_unreported") > 0).drop("first_at", "last_at")


def run_verdict(totals: DataFrame, finished_runs: DataFrame, last_at: DataFrame, now: Column) -> DataFrame:
    """A5: an executor's success isn't one with errors or unsettled nodes; silence makes a run unknown."""
    over = finished_runs.select(*RUN).distinct().withColumn("over", F.lit(True))
    t = totals.join(over, RUN, "left").join(last_at, RUN)
    silent = F.unix_timestamp(now) - F.unix_timestamp("last_at") > LIVE_SECONDS
    unsettled = F.col("n_running") + F.col("n_queued") + F.col("n_unknown") > 0
    verdict = (
        F.when(F.col("over").isNull() & silent, "unknown").when(F.col("over").isNull(), "unfinished")
        .when((F.col("n_error") > 0) & (F.col("n_success") > 0), "partial").when(F.col("n_error") > 0, "failed").when(unsettled, "unknown").otherwise("succeeded")
    )
    return t.select(*RUN, verdict.alias("verdict"), (F.col("over").isNull() & silent).alias("inferred"))


def start_offsets(folded: DataFrame, spans: DataFrame) -> DataFrame:
    """Milliseconds from the run's first event to each node's start; null if it would be negative."""
    ms = (_micros("started_at") - _micros("first_at")) / 1000
    j = folded.join(spans.select(*RUN, "first_at"), RUN)
    return j.select(*NODE, F.when(ms >= 0, ms.cast("long")).alias("offset_ms"))


def live_runs(events: DataFrame, finished_runs: DataFrame, now: Column) -> DataFrame:
    """X3 in batch: runs without a finish event; ``probably_running`` while their last event is recent."""
    r = events.groupBy(*RUN).agg(F.max("at").alias("last_at"), F.count_if(F.col("kind") == "node_finished").alias("finished"), F.count_if(F.col("status") == "error").alias("failed"))
    r = r.join(finished_runs.select(*RUN).distinct(), RUN, "left_anti")
    live = F.unix_timestamp(now) - F.unix_timestamp("last_at") <= LIVE_SECONDS
    return r.select(*RUN, F.when(live, "probably_running").otherwise("unknown").alias("state"), "finished", "failed")


def run_savings(ledger: DataFrame) -> DataFrame:
    """A1: what each run reused and the build time it avoided; a lower bound if some reuse is untimed."""
    reused = F.col("action") == "reused"
    return ledger.groupBy(*RUN).agg(
        F.count_if(reused).alias("reused"), F.count_if(~reused).alias("built"),
        F.count_if(reused & F.col("build_ms").isNotNull()).alias("timed"), F.count_if(reused & F.col("build_ms").isNull()).alias("untimed"),
        F.coalesce(F.sum(F.when(reused, F.col("build_ms"))), F.lit(0)).alias("avoided_ms"),
        F.array_join(F.array_sort(F.collect_set(F.when(reused & F.col("build_ms").isNotNull(), F.col("timed_by")))), ",").alias("timed_by"),
    )


def plan_savings(plan: DataFrame, state: DataFrame) -> DataFrame:
    """A2: what a plan's REUSE set saves, timed by the recorded builds."""
    j = plan.where(F.col("action") == "REUSE").join(state.select("scope", "node", "build_ms"), ["scope", "node"], "left")
    return j.groupBy("scope").agg(F.count(F.lit(1)).alias("reused"), F.count("build_ms").alias("timed"), F.coalesce(F.sum("build_ms"), F.lit(0)).alias("avoided_ms"))


def savings_total(ledger: DataFrame, since: Column, rate_per_hour: float) -> DataFrame:
    """A3: per scope and over all scopes (null scope), with cost at an hourly rate."""
    reused = F.col("action") == "reused"
    t = ledger.where(F.col("finished_at") >= since).rollup("scope").agg(F.countDistinct("scope", "run_id").alias("runs"), F.count_if(reused).alias("reused"), F.coalesce(F.sum(F.when(reused, F.col("build_ms"))), F.lit(0)).alias("avoided_ms"))
    return t.withColumn("cost", F.round(F.col("avoided_ms") / 3_600_000 * rate_per_hour, 6))


def read_ledger(ledger: DataFrame, since: Column, limit: int) -> DataFrame:
    """The newest entries of each scope since a time, at most ``limit`` a scope."""
    e = ledger.groupBy(*RUN).agg(F.max("finished_at").alias("finished_at"), F.count(F.lit(1)).alias("nodes")).where(F.col("finished_at") >= since)
    w = Window.partitionBy("scope").orderBy(F.desc("finished_at"), "run_id")
    return e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def node_runs(ledger: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` finished runs of each node."""
    w = Window.partitionBy("scope", "node").orderBy(F.desc("finished_at"), "run_id")
    return ledger.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def prune_journals(runs: DataFrame, keep: int, now: Column) -> DataFrame:
    """Journals beyond the newest ``keep`` of a scope, never one changed in the last ten minutes."""
    w = Window.partitionBy("scope").orderBy(F.desc("last_at"), "run_id")
    old = F.unix_timestamp(now) - F.unix_timestamp("last_at") >= LIVE_SECONDS
    return runs.withColumn("rank", F.row_number().over(w)).where((F.col("rank") > keep) & old).select(*RUN)


def resolve_run_prefix(runs: DataFrame, prefixes: DataFrame, shortest: int = 8) -> DataFrame:
    """A run by its id, or by a prefix of ``shortest`` characters or more that only it has.

    The prefixes are joined by their first ``shortest`` characters, not against all runs.
    """
    key = lambda c: F.substring(c, 1, shortest).alias("key")
    p = prefixes.where(F.length("prefix") >= shortest).select("prefix", key("prefix"))
    hit = p.join(runs.select("run_id", key("run_id")).distinct(), "key").where(F.col("run_id").startswith(F.col("prefix")))
    g = hit.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("run_id") == F.col("prefix"), F.col("run_id"))).alias("exact"), F.min("run_id").alias("only"))
    return g.select("prefix", F.coalesce("exact", F.when(F.col("n") == 1, F.col("only"))).alias("run_id"))


def run_filter(runs: DataFrame, now: Column, days: int) -> DataFrame:
    """Runs that finished within the last days; an unknown time is never within."""
    return runs.where(F.col("finished_at") >= now - F.make_interval(days=F.lit(days)))


def thread_lanes(bars: DataFrame) -> DataFrame:
    """Per run and thread, busy seconds (overlaps once) and idle seconds within the run's span.

    ``bars([scope,] run_id, thread, start_s, end_s, ...)``; a bar without both times is no bar. Runs of two scopes
    that share an id stay apart.
    """
    run = ["scope", "run_id"] if "scope" in bars.columns else ["run_id"]
    b = bars.where("start_s is not null and end_s is not null").select(*run, "thread", "start_s", "end_s")
    w = Window.partitionBy(*run, "thread").orderBy("start_s", "end_s").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("covered", F.max("end_s").over(w))
    busy = F.greatest(F.col("end_s") - F.greatest("start_s", F.coalesce("covered", F.col("start_s"))), F.lit(0))
    lanes = b.groupBy(*run, "thread").agg(F.count(F.lit(1)).alias("bars"), F.sum(busy).alias("busy_s"))
    span = b.groupBy(*run).agg((F.max("end_s") - F.min("start_s")).alias("span_s"))
    return lanes.join(span, run).select(*run, "thread", "bars", "busy_s", (F.col("span_s") - F.col("busy_s")).alias("idle_s"))


def critical_path(folded: DataFrame, edges: DataFrame) -> DataFrame:
    """From the node of a run that finished last, repeatedly to its last-finishing parent.

    ``folded(scope, run_id, node, started_at, finished_at)``; ``edges([scope,] parent, child)``. Ties go
    to the earlier start, then the smaller id. All runs' paths double in length in a round.
    """
    done = folded.where("finished_at is not null").select(*NODE, "started_at", "finished_at")
    order = lambda of: F.struct(-_micros("finished_at"), _micros(F.coalesce("started_at", "finished_at")), of)
    last = done.groupBy(*RUN).agg(F.min_by("node", order("node")).alias("node"))
    on = [*(["scope"] if "scope" in edges.columns else []), "parent"]
    parents = done.withColumnRenamed("node", "parent").join(edges, on).select(*RUN, F.col("child").alias("node"), "parent", "started_at", "finished_at")
    best = parents.groupBy(*NODE).agg(F.min_by("parent", order("parent")).alias("parent"))
    return walk(last, best, RUN, "node", "parent").withColumn("step", F.col("step").cast("int"))


def failure_history(ledger: DataFrame, n: int = 5) -> DataFrame:
    """Of the newest ``n`` runs of a node, how many failed and how many built."""
    return node_runs(ledger, n).groupBy("scope", "node").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("action") == "failed").alias("failed"), F.count_if(F.col("action") == "built").alias("built"))


def latest(entries: DataFrame) -> DataFrame:
    """The head of each scope: the entry with the largest (time, id)."""
    return entries.groupBy("scope").agg(F.max_by("run_id", F.struct("finished_at", "run_id")).alias("head"), F.max("finished_at").alias("at"))


def activity(events: DataFrame, duration: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Finishes and errors per scope and event-time window (batch or stream)."""
    w = F.window("at", duration, slide) if slide else F.window("at", duration)
    g = events.groupBy("scope", w.alias("w")).agg(F.count_if(F.col("kind") == "node_finished").alias("finished"), F.count_if(F.col("status") == "error").alias("errors"))
    return g.select("scope", F.col("w.start").alias("window_start"), "finished", "errors")


def sessions(events: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """Activity sessions of each run, closed by inactivity (batch or stream)."""
    g = events.groupBy("scope", "run_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return g.select("scope", "run_id", F.col("w.start").alias("session_start"), "events")
