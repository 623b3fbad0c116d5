"""Operators within scopes: equal names in two scopes don't meet."""

from __future__ import annotations

import pytest

from fleetlens.operators import lineage as L
from fleetlens.operators import project as P
from fleetlens.operators import runs as R
from fleetlens.operators import state as S
from fleetlens.operators.registry import Registry
from fleetlens.plans.fixpoint import layers


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_two_scopes_share_relation_names(spark):
    # in scope a, t.x feeds u.y; in scope b the same names are there, but u reads another column
    edges = frame(spark, [("a", "t", "x", "u", "y"), ("b", "t", "z", "u", "y")], "scope string, from_relation string, from_column string, node string, to_column string")
    outputs = frame(spark, [("a", "u", "y"), ("b", "u", "y")], "scope string, relation string, column string")
    seeds = frame(spark, [("a", "t", "x"), ("b", "t", "x")], "scope string, relation string, column string")
    got = {(r["scope"], r["relation"], r["column"]) for r in L.reaches(seeds, edges, outputs).collect()}
    assert got == {("a", "t", "x"), ("b", "t", "x"), ("a", "u", "y")}
    paths = {(r["scope"], r["path"]) for r in L.downstream_uses(seeds, edges).collect()}
    assert paths == {("a", "t.x>u.y")}
    sources = {tuple(r) for r in L.value_sources(frame(spark, [("a", "u", "y"), ("b", "u", "y")], "scope string, relation string, column string"), edges).select("scope", "seed", "relation", "column").collect()}
    assert sources == {("a", "u.y", "t", "x"), ("b", "u.y", "t", "z")}


def test_breaks_stay_in_their_scope(spark):
    pair = "scope string, relation string, node string"
    triple = "scope string, relation string, column string, node string"
    removed = frame(spark, [("a", "t", "x")], "scope string, relation string, column string")
    uses = frame(spark, [("a", "t", "x", "u"), ("b", "t", "x", "u"), ("b", "t", "x", "v")], triple)
    none = frame(spark, [], pair)
    got = L.breaks(removed, uses, frame(spark, [("a", "t", "u"), ("b", "t", "v")], pair), frame(spark, [], triple), none, frame(spark, [], "scope string, node string"))
    assert {tuple(r) for r in got.select("scope", "node", "verdict").collect()} == {("a", "u", "broken")}


def test_scope_is_all_or_nothing(spark):
    with pytest.raises(ValueError, match="scope"):
        L.unresolved_readers(frame(spark, [("a", "n", "t", "x")], "scope string, node string, relation string, column string"), frame(spark, [("t", "x")], "relation string, column string"))


def test_readings_by_scope(spark):
    rows = [("a", "s", 0, None, "v"), ("a", "s", 1, "2", "f"), ("b", "s", 0, "1", "v")]
    got = S.choose_source_versions(frame(spark, rows, "scope string, source string, rank int, version string, strategy string")).collect()
    assert {(r["scope"], r["source"], r["version"], r["strategy"]) for r in got} == {("a", "s", "2", "f"), ("b", "s", "1", "v")}


def test_critical_path_of_real_ids_by_scope(spark):
    rows = [(s, "r", n, f"2024-01-01 00:00:0{i}", f"2024-01-01 00:00:0{i + 1}") for s in "ab" for i, n in enumerate(["model.shop.orders", "model.shop.items", "model.shop.report"])]
    folded = frame(spark, rows, "scope string, run_id string, node string, started_at string, finished_at string").selectExpr("scope", "run_id", "node", "cast(started_at as timestamp) started_at", "cast(finished_at as timestamp) finished_at")
    edges = frame(spark, [("a", "model.shop.orders", "model.shop.report"), ("b", "model.shop.items", "model.shop.report")], "scope string, parent string, child string")
    got = {(r["scope"], r["node"], r["step"]) for r in R.critical_path(folded, edges).collect()}
    assert got == {("a", "model.shop.report", 0), ("a", "model.shop.orders", 1), ("b", "model.shop.report", 0), ("b", "model.shop.items", 1)}


def test_layers_and_build_stats_of_a_chain_with_a_cycle_behind(spark):
    nodes = frame(spark, [("a", i, True, False, i == 2) for i in range(6)], "scope string, node long, analysed boolean, cached boolean, opaque boolean")
    edges = frame(spark, [("a", 0, 1), ("a", 1, 2), ("a", 3, 4), ("a", 4, 3), ("a", 99, 5)], "scope string, parent long, child long")
    assert {(r["node"], r["depth"]) for r in layers(nodes, edges).collect()} == {(0, 0), (1, 1), (2, 2), (5, 0)}
    s = P.build_stats(nodes, edges).first()
    assert (s["waves"], s["missing"], s["opaque"]) == (3, 1, 1)


def test_registry_refuses_a_second_name(spark):
    r = Registry()
    r.register_check("c", "warn", lambda asked: asked)
    with pytest.raises(ValueError, match="already"):
        r.register_check("c", "warn", lambda asked: asked)
    with pytest.raises(ValueError, match="severity"):
        r.register_check("d", "fatal", lambda asked: asked)
    with pytest.raises(ValueError, match="requirement"):
        P.requirements(frame(spark, [("a", "n")], "scope string, node string"), ["colour"])
