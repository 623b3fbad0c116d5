"""Named behaviours of the metadata operators on small inputs."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.bindings import bind
from fleetlens.functions import scalars as S
from fleetlens.operators import failures, graphs, lineage, runs, state
from fleetlens.plans.components import connected_components
from fleetlens.plans.fixpoint import layers
from fleetlens.queries import everything
from fleetlens.sources import artifacts
from fleetlens.streaming import journals, live

T0 = dt.datetime(2024, 1, 1)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(20)] + [(200, 200 + i) for i in range(40)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            up[max(find(a), find(b))] = min(find(a), find(b))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = dict(rows(connected_components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert got == {x: min(y for y in linked if find(y) == find(x)) for x in linked}


def test_layers_ignore_unknown_and_leave_cycles_out(spark):
    n = spark.createDataFrame([("s", i) for i in range(6)], "scope string, node long")
    e = spark.createDataFrame([("s", 0, 1), ("s", 0, 1), ("s", 1, 2), ("s", 0, 2), ("s", 99, 0), ("s", 4, 5), ("s", 5, 4)], "scope string, parent long, child long")
    assert rows(layers(n, e), "node", "depth") == [(0, 0), (1, 1), (2, 2), (3, 0)]
    assert [r["cycle"] for r in graphs.find_cycles(n, e).collect()] == [[4, 5, 4]]


def test_closure_doesnt_depend_on_order(spark):
    e = [("s", i // 2, i) for i in range(1, 40)] + [("s", i // 3, i) for i in range(1, 40)]
    seeds = spark.createDataFrame([("s", 3)], "scope string, node long")
    a = rows(graphs.closure(seeds, spark.createDataFrame(e, "scope string, parent long, child long")), "node", "hops")
    b = rows(graphs.closure(seeds, spark.createDataFrame(e[::-1], "scope string, parent long, child long").repartition(7)), "node", "hops")
    assert a == b and (3, 0) in a


BASE = {"full_refresh": False, "recorded": True, "same_target": True, "fp_error": False, "fp_changed": False, "policy_blocked": False, "self_contained": True, "built_at": T0, "lag_s": 0, "quorum": "any", "relation": "present", "checks_required": False, "source_inputs": 1, "source_new": 0, "source_bad": 0}


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({}, "unchanged"), ({"full_refresh": True, "recorded": False}, "full_refresh_requested"), ({"recorded": False}, "never_built"), ({"same_target": False}, "target_changed"), ({"fp_error": True, "fp_changed": True}, "code_evidence_incomplete"),
        ({"fp_changed": True}, "code_changed"), ({"policy_blocked": True}, "policy_blocks_reuse"), ({"self_contained": False, "source_inputs": 0}, "missing_data_evidence"), ({"source_bad": 1}, "missing_data_evidence"),
        ({"source_new": 1, "source_inputs": 2, "quorum": "all"}, "quorum_not_met"), ({"source_new": 1, "lag_s": 10**9}, "within_lag_tolerance"), ({"source_new": 1}, "new_upstream_data"), ({"relation": "missing"}, "relation_missing"), ({"relation": "unverified"}, "relation_unverified"),
    ],
)
def test_plan_rules(spark, change, reason):
    n = spark.createDataFrame([{"scope": "s", "node": 1} | BASE | change])
    e = spark.createDataFrame([], "scope string, parent long, child long, recorded boolean")
    got = graphs.plan(n, e, F.lit(T0 + dt.timedelta(days=1))).first()
    assert got["reason"] == reason
    assert got["action"] == ("REUSE" if reason in ("unchanged", "quorum_not_met", "within_lag_tolerance") else "BUILD")


def test_a_change_rebuilds_what_is_downstream_and_nothing_else(spark):
    e = [("s", i // 2, i, True) for i in range(2, 16)]
    n = spark.createDataFrame([{"scope": "s", "node": i} | BASE | {"source_inputs": 0, "fp_changed": i == 3} for i in range(1, 16)])
    got = dict(rows(graphs.plan(n, spark.createDataFrame(e, "scope string, parent long, child long, recorded boolean"), F.lit(T0)), "node", "action"))
    assert {i for i, a in got.items() if a == "BUILD"} == {3, 6, 7, 12, 13, 14, 15}


def test_fold_keeps_what_a_correction_doesnt_know(spark):
    ev = [("s", "r", 1, T0, "n", "node_started", None, None, "T1"), ("s", "r", 2, T0, "n", "node_finished", "success", 7, None), ("s", "r", 3, T0, "n", "node_finished", "error", None, None), ("s", "r", 4, T0, "m", "node_started", None, None, None)]
    e = spark.createDataFrame(ev, "scope string, run_id string, seq long, at timestamp, node string, kind string, status string, rows_affected long, thread string")
    got = rows(runs.fold_run(e, e), "node", "status", "rows_affected", "thread")
    assert got == [("m", "unknown", None, None), ("n", "error", 7, "T1")]


def test_states_around_is_strictly_before(spark):
    s = spark.createDataFrame([("s", T0, 1, "a"), ("s", T0 + dt.timedelta(hours=1), 2, "b")], "scope string, created_at timestamp, snapshot_id long, by_run string")
    r = spark.createDataFrame([("s", "b", T0 + dt.timedelta(hours=1)), ("s", "x", T0)], "scope string, run_id string, started_at timestamp")
    assert sorted((x["run_id"], x["before"], x["committed"]) for x in state.states_around(r, s).collect()) == [("b", 1, 2), ("x", None, None)]


def test_kleene_unknown_is_never_a_pass(spark):
    df = spark.createDataFrame([("1",), ("NaN",), (None,), ("x",)], "v string")
    assert [r[0] for r in df.select(S.kleene(S.number(F.col("v")) > 0)).collect()] == ["pass", "unknown", "unknown", "unknown"]
    assert df.select(S.kleene((S.number(F.col("v")) > 0) | F.lit(True))).distinct().collect()[0][0] == "pass"


def test_a_quoted_value_never_survives_redaction(spark):
    df = spark.createDataFrame([("a 'secret' b",), ("a 'secret",), ('x "secret" 42',)], "v string")
    assert all("secret" not in r[0] and "42" not in r[0] for r in df.select(S.redact_literals(F.col("v"))).collect())


def test_did_you_mean_finds_all_within_two_edits(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(80)})

    def lev(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a):
            q = [i + 1]
            for j, y in enumerate(b):
                q.append(min(p[j + 1] + 1, q[j] + 1, p[j] + (x != y)))
            p = q
        return p[-1]

    n = spark.createDataFrame([("s", w) for w in words[:10]], "scope string, name string")
    c = spark.createDataFrame([("s", w) for w in words], "scope string, candidate string")
    want = sorted((w, x) for w in words[:10] for x in words if x != w and lev(w, x) <= 2)
    assert rows(failures.did_you_mean(n, c, most=1000), "name", "candidate") == want


def test_impact_reaches_everything_downstream_of_an_opaque_node(spark):
    uses = spark.createDataFrame([("a", "x", "b", "y"), ("b", "y", "c", None)], "relation string, column string, node string, to_column string")
    readers = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")], "relation string, node string")
    none = spark.createDataFrame([], "relation string, node string")
    opaque = spark.createDataFrame([("d",)], "node string")
    got = lineage.impact(spark.createDataFrame([("a", "x", "modified")], "relation string, column string, kind string"), uses, readers, none, opaque)
    assert {(r["relation"], r["kind"]) for r in got.collect()} == {("a", "modified"), ("b", "modified"), ("c", "rows"), ("d", "rows"), ("e", "rows")}


def parts(spark, folder, names):
    """The tables that the bindings read, from sf0.001, with other names of parts."""
    import shutil

    for t in ("region nation customer supplier orders lineitem events documents labels").split():
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", folder)
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").limit(1).drop("p_partkey", "p_name").crossJoin(spark.createDataFrame(list(enumerate(names)), "p_partkey long, p_name string"))
    part.write.parquet(str(folder / "part.parquet"))
    return str(folder)


def test_every_part_name_is_asked(spark, tmp_path):
    rng = random.Random(6)
    names = ["".join(rng.choice("abcD") for _ in range(rng.randrange(1, 7))) for _ in range(120)]

    def lev(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a):
            q = [i + 1]
            for j, y in enumerate(b):
                q.append(min(p[j + 1] + 1, q[j] + 1, p[j] + (x != y)))
            p = q
        return p[-1]

    want = []
    for n in {x + ("s" if i % 2 == 0 else "") for i, x in enumerate(names)}:
        near = sorted((lev(n.lower(), c.lower()), c) for c in set(names) if c != n and lev(n.lower(), c.lower()) <= 2)
        want += [(n, c, d, k + 1) for k, (d, c) in enumerate(near[:3])]
    got = everything()["j16_did_you_mean"][0](spark, parts(spark, tmp_path, names))
    assert rows(got, "name", "candidate", "distance", "rank") == sorted(want)


def test_every_finished_check_counts(spark):
    sf = "/root/testdata/sf0.001"
    events = [r.asDict() for r in bind(spark, sf, "run_events").collect()]
    checks = {}
    for e in events:
        key = (f"{e['scope']}/{e['run_id']}", e["node"])
        checks.setdefault(key, [])
        checks[key] += [(e["status"], e["run_id"])] if e["kind"] == "check_finished" else []
    want = sorted((*k, ("old" if not c else c[0][1] if all(s == "passed" for s, _ in c) else None) or "") for k, c in checks.items())
    assert len({w[2][:3] for w in want}) == 3
    for name, key in (("g18_record_tests", "node"), ("g19_record_source_checks", "source")):
        got = everything()[name][0](spark, sf)
        assert rows(got.withColumn("tested", F.coalesce("tested", F.lit(""))), "scope", key, "tested") == want


def test_downstream_uses_follow_a_chain_to_its_end(spark):
    chain = [(f"n{i}", "c", f"n{i + 1}", "c") for i in range(15)] + [("n15", "c", "n3", "c"), ("n15", "c", "n16", None)]
    e = spark.createDataFrame(chain, "from_relation string, from_column string, node string, to_column string")
    got = dict(rows(lineage.downstream_uses(spark.createDataFrame([("n0", "c")], "relation string, column string"), e), "steps", "path"))
    want = [f"n{i}.c" for i in range(16)] + ["n16.*"]
    assert got == {k: ">".join(want[:k]) for k in range(2, 18)}


def test_journals_count_what_they_cant_read(spark, tmp_path):
    good = {"run_id": "r", "seq": 1, "at": "2024-01-01T00:00:00Z", "kind": "node_started", "node": "n"}
    (tmp_path / "p1").mkdir()
    (tmp_path / "p1" / "r.jsonl").write_text("\n".join([json.dumps(good), "", '{"run_id": "r", "se', json.dumps(good | {"version": 9}), json.dumps(good | {"seq": 2, "kind": "node_finished", "status": "success", "rows_affected": 3})]))
    events, bad = artifacts.read_journals(spark, str(tmp_path))
    assert rows(events, "scope", "seq", "kind") == [("p1", 1, "node_started"), ("p1", 2, "node_finished")]
    assert rows(bad, "scope", "unreadable") == [("p1", 2)]


def test_artifacts(spark, tmp_path):
    p = tmp_path / "proj"
    p.mkdir()
    node = lambda i, kind, on: {"unique_id": i, "name": i, "resource_type": kind, "depends_on": {"nodes": on, "macros": []}, "columns": {"c": {"name": "c", "data_type": "int"}}, "tags": []}
    for name, version in (("manifest", "v12"), ("other", "v3")):
        (p / f"{name}.json").write_text(json.dumps({"metadata": {"dbt_schema_version": f"https://x/manifest/{version}.json"}, "nodes": {"a": node("a", "model", []), "b": node("b", "model", ["a"]), "t": node("t", "test", ["b"])}, "sources": {}}))
    m = artifacts.read_manifest(spark, [str(p / "manifest.json"), str(p / "other.json")])
    assert rows(m["nodes"], "scope", "node") == [("proj", "a"), ("proj", "b")]
    assert rows(m["edges"], "parent", "child") == [("a", "b"), ("b", "t")] and rows(m["tests"], "check", "node") == [("t", "b")]
    assert rows(m["refused"], "version") == [("v3.json",)]
    (p / "run_results.json").write_text(json.dumps({"metadata": {"invocation_id": "r1"}, "results": [{"unique_id": "a", "status": "success", "timing": [{"name": "execute", "started_at": "2024-01-01T00:00:00Z", "completed_at": "2024-01-01T00:00:05Z"}], "adapter_response": {"rows_affected": "4"}}]}))
    assert rows(artifacts.read_run_results(spark, str(p / "run_results.json")), "run_id", "node", "rows_affected") == [("r1", "a", 4)]


def test_lineage_export_skips_and_splits(spark, tmp_path):
    f = tmp_path / "log.csv"
    f.write_text("event_time,source_table_full_name,source_column_name,target_table_full_name,target_column_name\n2024-01-01T00:00:00Z,a.b.c,x,d.e.f,y\n2024-01-02T00:00:00Z,a.b.c,x,d.e.f,\n2024-01-03T00:00:00Z,,x,d.e.f,y\n")
    got = artifacts.read_observed_lineage(spark, str(f), "csv")
    assert got["edges"].count() == 1 and got["row_inputs"].count() == 1
    assert tuple(got["stats"].first())[:2] == (3, 1)
    with pytest.raises(ValueError, match="lacks"):
        artifacts.observed_lineage(spark.createDataFrame([("a",)], "source_table_full_name string"))


def test_streamed_fold_equals_batch(spark, tmp_path):
    folder = tmp_path / "p1"
    folder.mkdir()
    at = "2024-01-01T00:00:00Z"
    ev = [{"run_id": "r", "seq": 2, "at": at, "kind": "node_finished", "node": "n", "status": "success", "rows_affected": 5}, {"run_id": "r", "seq": 1, "at": at, "kind": "node_started", "node": "n"}, {"run_id": "r", "seq": 3, "at": at, "kind": "node_finished", "node": "n", "status": "error"}]
    (folder / "1.jsonl").write_text("\n".join(map(json.dumps, [*ev, ev[0]])) + "\nnot json\n")
    lines = journals.stream_journals(spark, str(folder))
    into = live.FoldTable(spark, str(tmp_path / "fold"))
    live.live_fold(artifacts.parse_journal(lines)[0], into, str(tmp_path / "place")).awaitTermination()
    assert rows(into.nodes(), "node", "status", "rows_affected") == [("n", "error", 5)]
    q = journals.follow(journals.unreadable_lines(lines), "bad", "complete")
    q.awaitTermination()
    assert [tuple(r) for r in spark.sql("select * from bad").collect()] == [("p1", 1)]


def test_downstream_uses_equal_their_sql_on_long_paths(spark, tmp_path):
    import duckdb

    key, column, keys = 40, 1, []
    while len(keys) < 15:  # one reader after the other, over the rule by which a part reads its half
        key, column = next((k, i) for k in (2 * key, 2 * key + 1) for i in (0, 1) if (k + i) % 3 == column)
        keys.append(key)
    duckdb.sql(f"COPY (SELECT unnest({keys}::BIGINT[]) AS p_partkey) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    for name in ("region", "nation", "customer", "supplier", "orders", "lineitem", "events", "documents", "labels"):
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    query, sql = everything()["g27_downstream_uses"]
    got = rows(query(spark, str(tmp_path)), "path", "steps")
    assert got == sorted(duckdb.sql(sql.replace("FROM part ", f"FROM '{tmp_path}/part.parquet' ")).fetchall())
    assert max(steps for _, steps in got) > 13
