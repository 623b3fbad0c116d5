"""Simulated changes against a search node by node; events, metrics and past plans on small cases."""

from __future__ import annotations

import json
import random

import pytest

from fleetlens.operators import openlineage as O
from fleetlens.operators import records as R
from fleetlens.operators import semantic as S
from fleetlens.operators import simulation as M


def followed(changes, uses, reads, declared, wild, opaque):
    """All reasons, one change at a time."""
    todo, seen, reasons = list(changes), set(), set()
    readers = {(r, n) for r, n in reads | declared}
    while todo:
        change = todo.pop()
        if change in seen:
            continue
        seen.add(change)
        rel, col, kind = change
        for r, n in readers:
            if r != rel:
                continue
            out = []
            if n in opaque or (r, n) not in reads:
                out = [("", "rows", "opaque")]
            elif kind == "rows":
                out = [("", "rows", "rows")]
            elif kind == "added":
                if (r, n) in wild:
                    out.append((col, "added", "wildcard"))
                    if any(u[0] == r and u[2] == n and u[3] is None for u in uses):
                        out.append(("", "rows", "wildcard"))
                if any(u[1] == col and u[2] == n and u[0] != r for u in uses):
                    out.append(("", "rows", "name_capture"))
            else:
                out = [(to or "", "modified" if to else "rows", "column") for a, c, m, to in uses if (a, c, m) == (r, col, n)]
            for c, k, why in out:
                reasons.add((n, c, k, why, rel))
                todo.append((n, c, k))
    return seen, reasons


@pytest.mark.parametrize("seed", [1, 2])
def test_simulated_changes_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    names, cols = [f"n{i}" for i in range(14)], ["a", "b", "c"]
    outputs = {(n, c) for n in names if n != "n2" for c in cols}
    pairs = {(f"n{j // 2}", f"n{j}") for j in range(1, 14)} | {(f"n{j // 3}", f"n{j}") for j in range(1, 14)}
    uses = {(r, rng.choice([*cols, "d"]), n, rng.choice([*cols, None])) for r, n in pairs for _ in range(2)}
    reads = {(u[0], u[2]) for u in uses}
    declared = {("n1", "n13"), ("n0", "n12"), next(iter(sorted(reads)))}
    wild = {p for p in reads if rng.random() < 0.3}
    opaque = {"n5", "n9"}
    proposed = [("n0", "a", "drop", None), ("n1", "b", "rename", "d"), ("n2", "a", "drop", None), ("n3", "c", "retype", "int"), ("nowhere", "a", "drop", None)]
    changes = {("n0", "a", "removed"), ("n1", "b", "removed"), ("n1", "d", "added"), ("n2", "", "rows"), ("n3", "c", "modified")}
    frames = lambda tag: [
        spark.createDataFrame([(tag, *p) for p in proposed], "scope string, node string, column string, change string, to string"),
        spark.createDataFrame([(tag, n) for n in names], "scope string, node string"), spark.createDataFrame([(tag, *p) for p in outputs], "scope string, node string, column string"),
        spark.createDataFrame([(tag, *p) for p in uses], "scope string, relation string, column string, node string, to_column string"),
        *[spark.createDataFrame([(tag, *p) for p in x], "scope string, relation string, node string") for x in (reads, declared, wild)],
        spark.createDataFrame([(tag, n) for n in opaque], "scope string, node string"),
    ]
    one, other = frames("one"), frames("two")
    # the other project proposes nothing
    both = [one[0], *[a.unionByName(b) for a, b in zip(one[1:], other[1:], strict=True)]]
    must, alone = M.simulate_changes(*both)
    got = {r["node"]: r for r in must.collect()}
    seen, reasons = followed(changes, uses, reads, declared, wild, opaque)
    reached = {x[0] for x in reasons}
    assert {r["scope"] for r in got.values()} == {"one"} and set(got) == reached | {"n0", "n1", "n2", "n3"}
    for n, r in got.items():
        mine = {x for x in reasons if x[0] == n}
        dark = {x[4] for x in mine if x[3] == "rows" and x[4] in opaque & reached}
        assert set(r["how"]) == {"via_opaque" if x[3] == "rows" and x[4] in dark else x[3] for x in mine}, n
        assert r["rows_changed"] == any(x[2] == "rows" for x in mine) and r["changed_here"] == (n in {"n0", "n1", "n2", "n3"})
        assert r["lineage"] == ("opaque" if n in opaque else "inferred" if mine and all(x[3] == "rows" and x[4] in dark for x in mine) else "parsed")
        if not mine:
            assert r["verdict"] == "changed" and r["columns"] == sorted(c for m, c, _, _ in proposed if m == n)
        elif n in opaque:
            assert r["verdict"] == "unknown" and r["columns"] is None
        else:
            assert r["columns"] == sorted({c for m, c in outputs if m == n} if r["rows_changed"] else {x[1] for x in mine if x[2] != "rows"})
    named = {u[2] for u in uses if u[:2] in {("n0", "a"), ("n1", "b"), ("n2", "a")} and u[2] not in opaque and not ((u[0], u[2]) in wild and u[3] == u[1])}
    assert all(got[n]["verdict"] == "breaks" for n in named & set(got))
    left = {(n, rel) for rel, n in reads | declared for ch in seen if ch[0] == rel and n not in got}
    assert {(r["node"], r["upstream"]) for r in alone.collect()} == left
    totals = {r["scope"]: tuple(r)[1:] for r in M.simulation_totals(both[1], must, alone).collect()}
    assert totals == {"one": (len(got), len({n for n, _ in left}), 14 - len(got) - len({n for n, _ in left})), "two": (0, 0, 14)}
    tests = spark.createDataFrame([("one", "n0", "t"), ("two", "n0", "t")], "scope string, node string, test string")
    assert [tuple(r) for r in M.tests_to_run(tests, must).select("scope", "node").collect()] == [("one", "n0")]


def test_nothing_proposed_changes_nothing(spark):
    empty = lambda s: spark.createDataFrame([], s)
    pair = "relation string, node string"
    must, alone = M.simulate_changes(
        empty("node string, column string, change string, to string"), spark.createDataFrame([("a",)], "node string"), empty("node string, column string"),
        empty("relation string, column string, node string, to_column string"), empty(pair), empty(pair), empty(pair), empty("node string"),
    )
    assert must.isEmpty() and alone.isEmpty()


OPTIONS = dict(dataset_namespace="d", job_namespace="j", producer="p", event_time="t")


def some_events(spark, **more):
    nodes = [("a", "db.a", "model", True, False, "k"), ("b", "db.b", "model", True, True, None), ("c", "db.c", "snapshot", False, None, None), ("s", "db.s", "seed", None, None, None), ("x", "db.x", "test", True, None, None)]
    frame = spark.createDataFrame
    return {
        r["node"]: json.loads(r["event"])
        for r in O.lineage_events(
            frame(nodes, "node string, relation string, resource_type string, analysed boolean, opaque boolean, cache_key string"),
            frame([("a", "db.s"), ("a", "db.s"), ("b", "db.a")], "node string, relation string"), frame([("a", "db.q"), ("c", "db.b")], "node string, relation string"),
            frame([("a", 'o"1'), ("a", "o2")], "node string, column string"),
            frame([("a", 'o"1', "db.s", "k", "INDIRECT", "CONDITIONAL"), ("a", 'o"1', "db.s", "k", "DIRECT", "IDENTITY"), ("a", 'o"1', "db.s", "k", "DIRECT", "IDENTITY")], "node string, column string, from_relation string, from_column string, type string, subtype string"),
            frame([("a", "db.s", "w", "FILTER"), ("b", "db.a", "w", "JOIN")], "node string, from_relation string, from_column string, subtype string"), **OPTIONS, **more,
        ).collect()
    }


def test_events_by_kind_and_placement(spark):
    job = some_events(spark)
    assert set(job) == {"a", "b", "c", "x"}
    assert job["a"]["inputs"] == [{"namespace": "d", "name": "db.s"}] and job["c"]["inputs"] == [{"namespace": "d", "name": "db.b"}] and job["x"]["inputs"] == []
    facet = job["a"]["outputs"][0]["facets"]["columnLineage"]
    assert [w["subtype"] for w in facet["fields"]['o"1']["inputFields"][0]["transformations"]] == ["IDENTITY", "CONDITIONAL"] and facet["fields"]["o2"] == {"inputFields": []}
    assert [f["field"] for f in facet["dataset"]] == ["w"]
    assert "facets" not in job["b"]["outputs"][0] and "facets" not in job["c"]["outputs"][0] and job["x"]["outputs"][0]["facets"]["columnLineage"]["fields"] == {}
    assert "run" not in job["a"] and job["a"]["schemaURL"].endswith("JobEvent")
    run = some_events(spark, kind="run", placement="dataset_and_fields")
    assert run["a"]["eventType"] == "COMPLETE" and run["a"]["schemaURL"].endswith("RunEvent") and run["a"]["run"] == some_events(spark, kind="run")["a"]["run"] != run["b"]["run"]
    fields = run["a"]["outputs"][0]["facets"]["columnLineage"]["fields"]
    assert [f["field"] for f in fields['o"1']["inputFields"]] == ["k", "w"] and [f["field"] for f in fields["o2"]["inputFields"]] == ["w"]
    with pytest.raises(ValueError):
        some_events(spark, kind="dataset")


def test_written_events_are_lines(spark, tmp_path):
    events = spark.createDataFrame([("b", "{2}"), ("a", "{1}")], "node string, event string")
    O.write_events(events, str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["{1}", "{2}"]


def test_metrics_read_through_metrics_and_cycles_end(spark):
    frame = spark.createDataFrame
    views = S.metric_views(
        frame([("ratio", "Ratio"), ("a", "A"), ("b", "B"), ("none", None)], "metric string, name string"),
        frame([("ratio", "a"), ("ratio", "b"), ("a", "sm1"), ("b", "sm2"), ("b", "ratio"), ("b", "gone")], "metric string, reads string"),
        frame([("sm2", "customers"), ("sm1", "orders"), ("sm3", "unused")], "model string, name string"),
        frame([("sm1", "day"), ("sm2", "day"), ("sm2", "city"), ("sm3", "x")], "model string, dimension string"), frame([("sm1", "n1"), ("sm2", "n1"), ("sm2", "n0")], "model string, node string"),
    )
    got = {r["metric"]: tuple(r)[1:] for r in views.collect()}
    whole = (["orders", "customers"], ["city", "day"], ["n0", "n1"])
    assert got == {"ratio": ("Ratio", *whole), "b": ("B", *whole), "a": ("A", ["orders"], ["day"], ["n1"]), "none": (None, [], [], [])}
    changed = frame([("n0",), ("n0",), ("n9",)], "node string")
    assert {tuple(r) for r in S.metrics_reached(views, changed).collect()} == {("n0", "ratio"), ("n0", "b")}


def test_past_plan_claims_only_what_states_show(spark):
    frame = spark.createDataFrame
    state = "scope string, run_id string, node string, digest string, components map<string,string>"
    before = [("s", "r", "a", "1", {"sql": "x", "config": "c", "macros": None}), ("s", "r", "b", "1", {"sql": "x"}), ("s", "r", "c", "1", {"sql": "x"}), ("s", "r", "gone", "1", {})]
    after = [("s", "r", "a", "2", {"sql": "y", "macros": None, "file": "f"}, "r"), ("s", "r", "b", "2", {"sql": "z"}, "older"), ("s", "r", "c", "1", {"sql": "x"}, "r"), ("s", "r", "d", "9", {"sql": "q"}, "r")]
    runs = frame([("s", "r", n) for n in "aabcd"], "scope string, run_id string, node string")
    got = {r["node"]: r for r in R.past_plan(runs, frame(before, state), frame(after, state + ", recorded_by string"), frame([("s", "a", "p2"), ("s", "a", "p1"), ("s", "a", "p1")], "scope string, node string, parent string")).collect()}
    assert set(got) == set("abcd") and all(r["action"] == "BUILD" for r in got.values())
    assert (got["a"]["reason"], got["a"]["changed"], got["a"]["was"], got["a"]["now"], got["a"]["depends_on"]) == ("code_changed", ["config", "file", "sql"], "1", "2", ["p1", "p2"])
    assert all(got[n]["reason"] is None and got[n]["changed"] is None and got[n]["depends_on"] == [] for n in "bcd")
