"""Plans that must hold at size: what is broadcast, what is joined in every round, how bitmaps are aggregated."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import failures as X
from fleetlens.operators import fold
from fleetlens.operators import graphs as G
from fleetlens.operators import project as P
from fleetlens.plans import fixpoint as L
from fleetlens.plans import reach as R
from fleetlens.plans import strong as S
from fleetlens.plans.fixpoint import NEAR, near
from fleetlens.plans.shared import Scratch
from fleetlens.sources.artifacts import parse_journal
from fleetlens.streaming import live


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Spark broadcasts nothing by size, as with large tables."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, was)


def test_large_frontiers_are_never_broadcast(spark):
    few, e = spark.range(10).withColumnRenamed("id", "at"), spark.range(1000).withColumnRenamed("id", "at")
    assert "BroadcastHashJoin" in plan(e.join(near(few, 10), "at"))
    assert "Broadcast" not in plan(e.join(near(few, NEAR + 1), "at"))


def test_a_metric_closure_broadcasts_no_large_level(spark, monkeypatch):
    plans, cut = [], L.cut

    def ran(df):
        out = cut(df)
        plans.append(plan(df))  # as it was run in the end
        return out

    monkeypatch.setattr(L, "cut", ran)
    monkeypatch.setattr(L, "NEAR", 0, raising=False)
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, str(1 << 62))  # all that Spark thinks small, as it does with what compresses well
    try:
        reads = spark.createDataFrame([(s, f"m{i}", f"m{i + 1}") for s in "ab" for i in range(3)], "scope string, metric string, reads string")
        got = {tuple(r) for r in X.metric_closure(reads).collect()}
    finally:
        spark.conf.set(key, was)
    assert got == {(s, f"m{i}", f"m{j}") for s in "ab" for i in range(3) for j in range(i + 1, 4)}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def broadcast_rows(p) -> list[int]:
    """How many rows each broadcast of a plan that has run holds."""
    name = p.nodeName()
    if name == "BroadcastExchange":
        own = [p.metrics().apply("numOutputRows").value()]
    else:
        own = []
    inner = p.executedPlan() if name == "AdaptiveSparkPlan" else p.plan() if name.endswith("QueryStage") else None
    below = [inner] if inner is not None else [p.children().apply(i) for i in range(p.children().size())]
    return own + [n for c in below for n in broadcast_rows(c)]


def test_a_metric_closure_whose_levels_shrink_broadcasts_few_rows_at_any_level(spark, monkeypatch):
    plans, rows, cut = [], [], L.cut

    def ran(df):
        out = cut(df)
        plans.append(plan(df))
        rows.extend(broadcast_rows(df._jdf.queryExecution().executedPlan()))
        return out

    monkeypatch.setattr(L, "cut", ran)
    monkeypatch.setattr(L, "NEAR", 5, raising=False)
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, str(1 << 62))
    try:
        # levels of 9, 8, ... 1 rows: those of up to five are broadcast, the edges (9) and what was seen (up to 44) never
        reads = spark.createDataFrame([("s", f"m{i}", f"m{i + 1}") for i in range(9)], "scope string, metric string, reads string")
        got = [tuple(r) for r in X.metric_closure(reads).collect()]
    finally:
        spark.conf.set(key, was)
    assert sorted(got) == sorted(("s", f"m{i}", f"m{j}") for i in range(9) for j in range(i + 1, 10))
    assert rows and max(rows) == 5
    assert any("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


def test_strong_components_broadcast_nothing_while_many_edges_are_left(spark, monkeypatch):
    plans, write = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name, by=None: plans.append(plan(df)) or write(self, df, name, by))
    monkeypatch.setattr(S, "NEAR", 0, raising=False)
    n = spark.createDataFrame([("s", i) for i in range(6)], "scope string, node long")
    e = spark.createDataFrame([("s", *p) for p in [(0, 1), (1, 0), (1, 2), (2, 3), (3, 4), (4, 2), (5, 5)]], "scope string, parent long, child long")
    got = {(r["node"], r["component"]) for r in S.strong_components(n, e).collect()}
    assert got == {(0, 0), (1, 0), (2, 2), (3, 2), (4, 2), (5, 5)}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_bitmaps_are_short_and_hashed(spark):
    rows = spark.range(4).select("id", F.lit(0).alias("bucket"), *[F.col("id").alias(w) for w in R.WORDS])
    assert "SortAggregate" not in plan(R.united(rows, F.col("id")))
    # more nodes than a row has bits, and a cycle
    n = 3 * R.BITS // 2
    e = [("s", i, i + 1) for i in range(n - 6, n)] + [("s", n, 0)] + [("t", 0, i) for i in range(1, n)]
    got = {(r["scope"], r["node"]): r["n"] for r in R.reach_counts(spark.createDataFrame(e, "scope string, parent long, child long")).collect()}
    assert got[("t", 0)] == n - 1
    assert got[("s", n)] == 1 and got[("s", n - 1)] == 2 and got[("s", n - 5)] == 6
    ring = [("s", i, (i + 1) % 12) for i in range(12)]
    assert {r["n"] for r in R.reach_counts(spark.createDataFrame(ring, "scope string, parent long, child long")).collect()} == {11}


def test_postings_are_not_gathered_by_substring(spark, no_broadcast):
    items = spark.createDataFrame([(f"n{i}", "red gear", "red gear") for i in range(50)], "item string, label string, haystack string")
    found = X.SearchIndex(items).search(spark.createDataFrame([(1, "e"), (2, "gear r")], "query int, text string"), 3)
    assert "BroadcastHashJoin [gear" not in plan(found) and "BroadcastHashJoin [gram" in plan(found)
    assert found.count() == 6


def test_nodes_are_not_sent_to_the_macros_closures(spark, no_broadcast):
    uses = spark.createDataFrame([("s", i, "m") for i in range(20)], "scope string, node long, macro string")
    calls = spark.createDataFrame([("s", "m", "base")], "scope string, macro string, calls string")
    macros = spark.createDataFrame([("s", "m", "x"), ("s", "base", "y")], "scope string, macro string, sql string")
    lines = P.macro_lines(uses, calls, macros)
    assert "BroadcastHashJoin" in plan(lines) and lines.count() == 20


def test_a_retry_joins_once_a_round(spark, monkeypatch):
    steps, fixpoint = [], G.fixpoint
    monkeypatch.setattr(G, "fixpoint", lambda seed, step, keys: steps.append(step) or fixpoint(seed, step, keys))
    p = spark.createDataFrame([("s", i, "BUILD") for i in range(4)], "scope string, node long, action string")
    e = spark.createDataFrame([("s", i, i + 1) for i in range(3)], "scope string, parent long, child long")
    out = G.split_retry(p, e, p.where("node > 0"), p)
    assert {(r["node"], r["verdict"]) for r in out.collect()} == {(0, "changed_since"), (1, "held_back"), (2, "held_back"), (3, "held_back")}
    assert plan(steps[0](spark.createDataFrame([("s", 1)], "scope string, node long"))).count("Join") == 1


LINES = [f'{{"run_id":"r{r}","seq":{i},"at":"2024-01-{1 + 20 * r:02}T00:00:0{i}Z","kind":"{k}","node":"n","check":"c","covers":["n"],"status":"passed"}}'
         for r in (0, 1) for i, k in enumerate(("node_started", "node_finished", "check_finished", "check_finished"))]


def journal_lines(spark, lines):
    return spark.createDataFrame([("s", line) for line in lines], "scope string, value string")


def test_a_journal_line_is_parsed_once(spark):
    events, unreadable = parse_journal(journal_lines(spark, [*LINES, LINES[0][:-5], " "]))
    assert plan(events.where("kind = 'node_started' and node is not null")).count("from_json") == 1
    assert plan(unreadable).count("from_json") == 1
    assert events.count() == len(LINES) and [tuple(r) for r in unreadable.collect()] == [("s", 1)]


def test_a_batch_is_read_once_and_a_compaction_joins_only_what_goes(spark, tmp_path, monkeypatch):
    kept, plans = [], {}
    partial, put = fold.partial, live.FoldTable._put
    monkeypatch.setattr(fold, "partial", lambda e: kept.append((plan(e), e)) or partial(e))
    monkeypatch.setattr(live.FoldTable, "_put", lambda self, df, name, part: plans.update({(name, part): plan(df)}) or put(self, df, name, part))
    events = parse_journal(journal_lines(spark, LINES + LINES[:3]))[0]
    long, short = (live.FoldTable(spark, str(tmp_path / k), keep=f"INTERVAL {k} DAYS") for k in ("365", "7"))
    for into, runs in ((long, ["r0", "r1"]), (short, ["r1"])):
        into.append(events, 0)
        assert "InMemoryTableScan" in kept[-1][0] and not kept[-1][1].is_cached
        # repeats in the log go when states are merged, not in every batch
        assert "Exchange" not in plans["batch-0", "marks"] and "Exchange" not in plans["batch-0", "checks"]
        into.compact()
        joined = [part for part in live.PARTS if "Join" in plans["base-0", part]]
        assert joined == ([] if into is long else list(live.PARTS))
        assert spark.read.parquet(f"{into.path}/base-0/marks").count() == 2 * len(runs)
        assert sorted((r["run_id"], r["status"], r["tests"]["passed"]) for r in into.nodes().collect()) == [(r, "passed", 1) for r in runs]
        assert sorted(r["run_id"] for r in into.states().runs.collect()) == runs
