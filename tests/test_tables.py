"""Tables of runs: written once however often they are sent."""

from __future__ import annotations

import datetime as dt

from fleetlens.plans.shared import checkpoint_dir
from fleetlens.sources import tables as T

AT = [dt.datetime(2024, 1, d) for d in range(1, 9)]


def offer(spark, *rows):
    return spark.createDataFrame([(s, r, i, p, AT[i]) for s, r, i, p in rows], T.SNAPSHOT)


def verdicts(df):
    return {(r["scope"], r["snapshot_id"]): r["verdict"] for r in df.collect()}


def test_snapshots_go_onto_the_head_only(spark, tmp_path):
    checkpoint_dir(spark)
    t = T.SnapshotTable(spark, str(tmp_path / "s"))
    assert t.heads().count() == 0
    first = offer(spark, ("a", "r1", 1, None), ("b", "r1", 1, None), ("b", "r2", 2, None))
    assert verdicts(t.append(first)) == {("a", 1): "accepted", ("b", 1): "accepted", ("b", 2): "conflict"}
    assert verdicts(t.append(first)) == {("a", 1): "already_there", ("b", 1): "already_there", ("b", 2): "conflict"}
    assert verdicts(t.append(offer(spark, ("a", "r3", 3, 1), ("a", "r4", 4, 1), ("b", "r3", 3, 9)))) == {("a", 3): "accepted", ("a", 4): "conflict", ("b", 3): "conflict"}
    assert {(r["scope"], r["head"], r["run_id"]) for r in t.heads().collect()} == {("a", 3, "r3"), ("b", 1, "r1")}
    assert t.read().count() == 3


def test_a_record_is_replaced_whole_and_others_stay(spark, tmp_path):
    t = T.health_table(spark, str(tmp_path / "h"))
    rows = lambda *x: spark.createDataFrame([(s, r, AT[d], n, "c", "error", st) for s, r, d, n, st in x], t.schema)
    t.write(rows(("a", "1", 1, "n", "pass"), ("a", "1", 1, "m", "pass"), ("b", "1", 1, "n", "pass")))
    t.write(rows(("a", "1", 1, "n", "fail")))
    t.write(rows(("a", "2", 2, "n", "pass")))
    assert sorted((r["scope"], r["record"], r["node"], r["status"]) for r in t.read().collect()) == [("a", "1", "n", "fail"), ("a", "2", "n", "pass"), ("b", "1", "n", "pass")]
    assert sorted((r["scope"], r["record"]) for r in T.latest_record(t.read()).collect()) == [("a", "2"), ("b", "1")]
