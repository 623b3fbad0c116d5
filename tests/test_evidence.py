"""What isn't known is never taken for good: silent checks, null names, missing macros, hooks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from fleetlens.operators import health as H
from fleetlens.operators import lineage as L
from fleetlens.operators import project as P
from fleetlens.operators import state as S

T = dt.datetime(2024, 1, 1)


def test_a_silent_check_leaves_nodes_unknown(spark):
    nodes = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "scope string, node long")
    answers = nodes.select("scope", "node", F.lit("loud").alias("check"), F.lit("pass").alias("status"))
    found = H.reconcile(nodes, answers, nodes, ["loud", "silent"])
    assert sorted(map(tuple, found.where("check = 'silent'").select("scope", "node", "status").collect())) == [("a", 1, "unknown"), ("a", 2, "unknown"), ("b", 1, "unknown")]
    badges = H.badge(found.withColumn("severity", F.lit("error")))
    assert {r["health"] for r in badges.collect()} == {"unknown"}
    none = H.reconcile(nodes, answers.limit(0), nodes, ["silent"])
    assert {r["status"] for r in none.collect()} == {"unknown"} and none.count() == 3


def test_a_stranger_voids_the_check_in_its_scope_only(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "scope string, node long")
    answers = spark.createDataFrame([("a", 1, "c", "pass"), ("a", 2, "c", "pass"), ("b", 1, "c", "pass"), ("b", 2, "c", "fail")], "scope string, node long, check string, status string")
    got = {(r["scope"], r["node"]): r["status"] for r in H.reconcile(nodes, answers, nodes, ["c"]).collect()}
    assert got == {("a", 1): "unknown", ("b", 1): "pass", ("b", 2): "fail"}


def test_badges_of_two_projects_stay_apart(spark):
    found = spark.createDataFrame([("a", 1, "c", "error", "fail"), ("b", 1, "c", "error", "pass")], "scope string, node long, check string, severity string, status string")
    assert sorted((r["scope"], r["health"]) for r in H.badge(found).collect()) == [("a", "failing"), ("b", "healthy")]


def test_null_names_meet_nothing_and_types_stay(spark):
    schema = "scope string, source long, version string, taken_at timestamp"
    a, b = spark.createDataFrame([("s1", None, "1", T), ("s1", 7, "1", T)], schema), spark.createDataFrame([("s1", None, "2", T), ("s1", 7, "1", T)], schema)
    got = S.merge_readings(a, b)
    assert sorted(map(str, ((r["scope"], r["source"], r["version"]) for r in got.collect()))) == sorted(map(str, [("s1", None, "1"), ("s1", None, "2"), ("s1", 7, "1")]))
    assert got.schema["source"].dataType.simpleString() == "bigint"
    plain = S.merge_readings(a.drop("scope"), b.drop("scope"))
    assert got.drop("scope").schema == plain.schema and sorted(map(str, got.drop("scope").collect())) == sorted(map(str, plain.collect()))
    edges = spark.createDataFrame([("s1", 1, 2, "o"), ("s1", None, 2, "o"), ("s2", 1, 2, "o")], "scope string, node long, source long, output string")
    rows = spark.createDataFrame([("s1", 1, 9)], "scope string, node long, source long")
    out = L.inputs_of(edges, rows)
    assert out.schema["node"].dataType.simpleString() == "bigint"
    assert {tuple(r) for r in out.where("node is not null").collect()} == {("s1", 1, "o", 2), ("s1", 1, "o", 9), ("s2", 1, "o", 2)}


def code(spark, rows):
    n = spark.createDataFrame([("s", n, "model", "sql", "select 1", "sum", True, config, "", "r", "e") for n, config in rows], "scope string, node long, resource_type string, language string, compiled string, checksum string, pure boolean, config map<string,string>, contract string, relation string, engine string")
    macro = "scope string, node long, macro string"
    uses = spark.createDataFrame([("s", 1, "macro.p.a"), ("s", 2, "macro.p.b"), ("s", 3, "macro.p.env"), ("s", 4, "macro.p.env"), ("s", 5, "macro.dbt.env")], macro)
    calls = spark.createDataFrame([("s", "macro.p.b", "macro.p.gone"), ("s", "macro.p.a", "macro.p.b2"), ("s", "macro.p.b2", "macro.p.a")], "scope string, macro string, calls string")
    macros = spark.createDataFrame([("s", "macro.p.a", "x"), ("s", "macro.p.b", "y"), ("s", "macro.p.b2", "z"), ("s", "macro.p.env", "{{ env_var('A') }}"), ("s", "macro.dbt.env", "{{ env_var('A') }}")], "scope string, macro string, sql string")
    return {r["node"]: (r["digest"], r["reason"]) for r in P.code_fingerprint(n, uses, calls, macros, F.col("compiled")).collect()}


def test_fingerprints_are_refused_where_code_is_missing(spark):
    hook = {"post-hook": "[\"grant select\"]"}
    got = code(spark, [(1, {}), (2, {}), (3, {}), (4, hook), (5, hook), (6, {"pre_hook": "{{ target.name }}"}), (7, {"pre_hook": "my_target_table"}), (8, {"pre-hook": "[]"})])
    assert got[1][0] and got[3][0] and got[5][0] and got[7][0] and got[8][0]
    assert got[2] == (None, "macros that the artifacts don't include: macro.p.gone")
    assert got[4] == (None, "hooks' macros read what is known at run time") and got[6] == (None, "hooks read what is known at run time")


def test_nested_configuration_in_any_order_is_one_digest(spark):
    a = code(spark, [(1, {"grants": '{"x": {"b": 1, "a": [2, {"d": 3, "c": 4}]}, "k": null}', "m": "view"})])
    b = code(spark, [(1, {"m": "view", "grants": '{ "k": null, "x": {"a": [2, {"c": 4, "d": 3}], "b": 1} }'})])
    c = code(spark, [(1, {"m": "view", "grants": '{ "k": null, "x": {"a": [{"c": 4, "d": 3}, 2], "b": 1} }'})])
    assert a[1][0] == b[1][0] != c[1][0]
