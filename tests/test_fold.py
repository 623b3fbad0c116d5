"""The fold of run journals against a loop over the events, in any order, batches and restarts."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import fold
from fleetlens.sources.artifacts import STATS
from fleetlens.streaming import live

SCHEMA = f"scope string, run_id string, seq bigint, at timestamp, kind string, node string, check string, covers array<string>, {STATS}, nodes array<string>, mode string, live boolean, outcome string"
NAMES = [c.strip().split(" ")[0] for c in "scope run_id seq at kind node check covers status started_at finished_at duration_ms compile_ms execute_ms rows_affected thread adapter error blocked_by tests nodes mode live outcome".split()]
T0 = dt.datetime(2024, 1, 1)
STATUSES = ["success", "error", "skipped", "unknown"]


def random_event(rng, seq):
    e = dict.fromkeys(NAMES) | {"scope": rng.choice("ab"), "run_id": rng.choice(["r1", "r2"]), "seq": seq, "at": T0 + dt.timedelta(seconds=seq)}
    maybe = lambda v: v if rng.random() < 0.5 else None
    node = lambda: rng.choice(["n1", "n2", "n3"])
    kind = rng.choices(["run_started", "run_finished", "node_queued", "node_started", "node_finished", "check_finished"], [1, 2, 3, 5, 8, 6])[0]
    e["kind"] = kind
    if kind.startswith("node"):
        e["node"] = node()
    if kind == "node_started":
        e["thread"] = maybe("T1")
    if kind == "node_finished":
        e |= {"status": rng.choice(STATUSES), "started_at": maybe(e["at"]), "finished_at": maybe(e["at"]), "thread": maybe("T2"), "adapter": rng.choice([None, {}, {"q": str(seq)}]), "error": maybe(f"E{seq}")}
        e |= {"blocked_by": rng.choice([None, [], [node(), f"x{seq}"]]), "tests": maybe(tuple(rng.randint(0, 2) for _ in range(4)))}
        e |= {c: maybe(seq * 10) for c in ("duration_ms", "compile_ms", "execute_ms", "rows_affected")}
    if kind == "check_finished":
        e |= {"check": rng.choice(["c1", "c2"]), "covers": rng.choice([None, [], [node()], [node(), node()]]), "status": rng.choice(["passed", "failed", "warned", "skipped", "unknown"])}
    if kind == "run_started":
        e |= {"nodes": rng.choice([[], ["n1"], ["n1", "n3"]]), "mode": "run", "live": True}
    if kind == "run_finished":
        e["outcome"] = "succeeded"
    return e


def loop(events):
    """One event after another."""
    place = {"passed": 0, "failed": 1, "warned": 2, "skipped": 3, "unknown": 3}
    nodes, checks = {}, {}
    for e in sorted(events, key=lambda e: e["seq"]):
        run = (e["scope"], e["run_id"])

        def get(n, asked=False, run=run):
            return nodes.setdefault((*run, n), dict.fromkeys(["started_at", "finished_at", "duration_ms", "compile_ms", "execute_ms", "rows_affected", "thread", "error", "tests"]) | {"requested": asked, "status": "queued", "adapter": {}, "blocked_by": []})

        unfinished = lambda s: s["status"] in ("queued", "running")
        if e["kind"] == "run_started":
            for n in e["nodes"]:
                get(n, True)
        elif e["kind"] == "run_finished":
            for k, s in nodes.items():
                if k[:2] == run and unfinished(s):
                    s["status"] = "unknown"
        elif e["kind"] == "node_queued":
            if unfinished(s := get(e["node"])):
                s["status"] = "queued"
        elif e["kind"] == "node_started":
            get(e["node"]).update(status="running", started_at=e["at"], thread=e["thread"])
        elif e["kind"] == "node_finished":
            s = get(e["node"])
            correction = not unfinished(s)
            for c in ("started_at", "finished_at", "duration_ms", "compile_ms", "execute_ms", "rows_affected", "thread"):
                s[c] = e[c] if e[c] is not None else s[c]
            s["adapter"] = e["adapter"] or s["adapter"]
            s["blocked_by"] = e["blocked_by"] or (s["blocked_by"] if e["status"] == "skipped" else [])
            s["error"] = e["error"] or (s["error"] if e["status"] == "error" else None)
            if e["tests"] is not None:
                s["tests"] = list(e["tests"]) if correction or s["tests"] is None else [a + b for a, b in zip(e["tests"], s["tests"], strict=True)]
            s["status"] = e["status"]
        else:
            known = lambda n, run=run: nodes.get((*run, n))
            old = checks.get((*run, e["check"]))
            for n in (old or {"covers": []})["covers"] or []:
                if (s := known(n)) and s["tests"] is not None:
                    s["tests"][place[old["status"]]] = max(0, s["tests"][place[old["status"]]] - 1)
            for n in e["covers"] or []:
                if s := known(n):
                    s["tests"] = s["tests"] or [0] * 4
                    s["tests"][place[e["status"]]] += 1
            checks[(*run, e["check"])] = e
    return {k: (s["requested"], s["status"], *(s[c] for c in ("started_at", "finished_at", "duration_ms", "compile_ms", "execute_ms", "rows_affected", "thread", "error")), s["adapter"], s["blocked_by"], tuple(s["tests"]) if s["tests"] else None) for k, s in nodes.items()}


def found(df):
    return {
        (r["scope"], r["run_id"], r["node"]): (r["requested"], r["status"], *(r[c] for c in ("started_at", "finished_at", "duration_ms", "compile_ms", "execute_ms", "rows_affected", "thread", "error")), r["adapter"] or {}, r["blocked_by"] or [], tuple(r["tests"]) if r["tests"] else None)
        for r in df.collect()
    }


def frame(spark, events):
    return spark.createDataFrame([tuple(e[c] for c in NAMES) for e in events], SCHEMA)


@pytest.mark.parametrize("seed", range(4))
def test_fold_equals_the_loop_in_any_order(spark, seed):
    rng = random.Random(seed)
    events = [random_event(rng, i) for i in range(160)]
    mixed = rng.sample(events, len(events)) + rng.sample(events, 20)
    assert found(fold.fold_nodes(frame(spark, mixed).repartition(3))) == loop(events)


def test_states_merge_in_any_batches(spark, tmp_path):
    rng = random.Random(9)
    events = [random_event(rng, i) for i in range(200)]
    mixed = rng.sample(events, len(events))
    into = live.FoldTable(spark, str(tmp_path / "t"), compact_every=3)
    assert into.nodes() is None
    at = [0, 30, 31, 90, 120, 170, 200]
    for b, (i, j) in enumerate(zip(at, at[1:], strict=False)):
        into.append(frame(spark, mixed[max(0, i - 10) : j]), b)  # batches overlap
        into.append(frame(spark, mixed[max(0, i - 10) : j]), b)  # and are retried
    base, later = into.committed()
    assert base is not None and len(later) < 3
    into.append(frame(spark, mixed[:5]), 0)  # long since part of the base
    assert found(into.nodes()) == loop(events)


def test_torn_batch_is_invisible(spark, tmp_path):
    rng = random.Random(2)
    events = [random_event(rng, i) for i in range(60)]
    into = live.FoldTable(spark, str(tmp_path / "t"))
    into.append(frame(spark, events[:40]), 0)
    fold.partial(frame(spark, events[40:])).nodes.write.parquet(str(tmp_path / "t" / "batch-1" / "nodes"))
    assert found(into.nodes()) == loop(events[:40])
    into.append(frame(spark, events[40:]), 1)
    assert found(into.nodes()) == loop(events)


def test_stream_restarts_and_silent_runs(spark, tmp_path):
    rng = random.Random(7)
    events = [random_event(rng, i) for i in range(120)]
    folder = tmp_path / "in"
    folder.mkdir()
    into = live.FoldTable(spark, str(tmp_path / "t"), compact_every=2)
    mixed = rng.sample(events, len(events))
    for part in (mixed[:50], mixed[50:]):
        frame(spark, part).repartition(3).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
        live.live_fold(stream, into, str(tmp_path / "place")).awaitTermination()
    assert found(into.nodes()) == loop(events)
    # long after: what is open in a run that never ended is unknown, and said to be inferred
    open_runs = {(e["scope"], e["run_id"]) for e in events} - {(e["scope"], e["run_id"]) for e in events if e["kind"] == "run_finished"}
    for r in into.nodes(F.lit(T0 + dt.timedelta(days=1))).collect():
        was = loop(events)[r["scope"], r["run_id"], r["node"]][1]
        silent = (r["scope"], r["run_id"]) in open_runs and was in ("queued", "running")
        assert (r["status"], r["inferred"]) == (("unknown", True) if silent else (was, False))


def test_compaction_drops_runs_past_their_retention(spark, tmp_path):
    old, new = (dict.fromkeys(NAMES) | {"scope": "a", "run_id": r, "seq": 1, "at": at, "kind": "node_started", "node": "n"} for r, at in (("r1", T0), ("r2", T0 + dt.timedelta(days=30))))
    into = live.FoldTable(spark, str(tmp_path / "t"), keep="INTERVAL 7 DAYS")
    into.append(frame(spark, [old, new]), 0)
    into.compact()
    assert [r["run_id"] for r in into.nodes().collect()] == ["r2"]
