"""What runs leave in the state, the check of stored snapshots, relationships by name and missing tests."""

from __future__ import annotations

from collections import Counter

from fleetlens.operators import erd as E
from fleetlens.operators import records as R


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def run(spark, results, nodes, parents=(), versions=(), previous=(), reads=()):
    return R.record_run(
        frame(spark, results, "scope string, node string, run_id string, at long, outcome string, tested boolean, build_ms long"), frame(spark, nodes, "scope string, node string, fp string, checks string"),
        frame(spark, list(parents), "scope string, node string, parent string"), frame(spark, list(versions), "scope string, source string, version string, predates boolean"),
        frame(spark, list(previous), "scope string, node string, run_id string, built_at long, fp string, build_ms long, tested string"), frame(spark, list(reads), "scope string, node string, kind string, name string, value string"),
    )


def test_what_a_run_leaves(spark):
    results = [("s", n, "r2", 9, o, t, None) for n, o, t in [("a", "success", True), ("b", "success", True), ("c", "failed", True), ("d", "skipped", None), ("e", "success", True), ("gone", "success", True), ("new", "failed", None)]]
    nodes = [("s", n, None if n == "e" else f"f{n}", None if n == "b" else "k") for n in "abcde"] + [("s", "new", "fn", "k")]
    previous = [("s", n, "r1", 1, f"o{n}", 50, "r1") for n in "acdeu"]
    parents = [("s", "a", p) for p in ("b", "c", "src", "late", "unknown", "new", "b")] + [("s", "c", "b")]
    versions = [("s", "src", "v7", True), ("s", "late", "v8", False), ("other", "src", "v1", True)]
    reads = [("s", "a", "parent", "x", "r0"), ("s", "d", "parent", "a", "r1")]
    state, read, fate = run(spark, results, nodes, parents, versions, previous, reads)
    assert rows(state) == [
        ("s", "a", "r2", 9, "fa", None, "r2"), ("s", "b", "r2", 9, "fb", None, None), ("s", "c", "r1", 1, "oc", 50, None),
        ("s", "d", "r1", 1, "od", 50, "r1"), ("s", "e", "r1", 1, "oe", 50, None), ("s", "u", "r1", 1, "ou", 50, "r1"),
    ]
    assert rows(read) == [("s", "a", "input", "late", None), ("s", "a", "input", "src", "v7"), ("s", "a", "parent", "b", "r2"), ("s", "a", "parent", "c", "r1"), ("s", "d", "parent", "a", "r1")]
    assert dict((n, b) for _, n, b in rows(fate)) == {"a": "advanced", "b": "advanced", "c": "kept_failed", "d": "kept_skipped", "e": "kept_no_fingerprint", "gone": "ignored", "new": "kept_failed"}


def test_a_first_run_and_an_empty_one(spark):
    state, read, fate = run(spark, [("s", "a", "r", 1, "success", None, 3)], [("s", "a", "f", "k")], [("s", "a", "a2")])
    assert rows(state) == [("s", "a", "r", 1, "f", 3, None)] and rows(read) == [] and rows(fate) == [("s", "a", "advanced")]
    assert [rows(x) for x in run(spark, [], [])] == [[], [], []]


def test_stored_snapshots(spark):
    doc = lambda run_id, parent, nodes: f'{{"run_id": "{run_id}", "parent": {parent}, "nodes": {nodes}, "more": [1]}}'
    snapshots = [
        ("a", 1, None, "r1", 2, doc("r1", "null", 2)), ("a", 2, 1, "r2", 2, doc("r2", 1, 3)), ("a", 3, 9, "r3", 2, "{"), ("a", 4, 1, "r4", 2, None),
        ("a", 5, 1, "r5", 2, '{"parent": 1}'), ("b", 6, 1, "r6", 1, doc("x", 1, 1)), ("b", 7, None, "r7", 1, doc("r7", 6, 1)),
    ]
    got = R.check_records(frame(spark, snapshots, "scope string, snapshot_id long, parent long, run_id string, nodes long, document string"), frame(spark, [("a", 5), ("c", 1)], "scope string, head long"))
    assert set(rows(got)) == {
        ("a", 2, "inconsistent", "nodes"), ("a", 3, "unreadable", None), ("a", 3, "broken_chain", None), ("a", 4, "unreadable", None), ("a", 5, "unreadable", None),
        ("b", 6, "inconsistent", "run_id"), ("b", 6, "broken_chain", None), ("b", 7, "inconsistent", "parent"), ("c", 1, "head_missing", None), ("b", 7, "no_head", None),
    }


def relate(spark, entities, columns, keys, known=()):
    three = "scope string, entity string, column string"
    return E.relationships_by_form(frame(spark, entities, "scope string, entity string, name string"), frame(spark, columns, three), frame(spark, keys, "scope string, entity string, columns array<string>, basis int"), frame(spark, list(known), three))


def test_relationships_by_form(spark):
    names = {"c": "stg_customers", "o": "orders", "p": "product", "q": "dim_products", "x": "extra", "n": None}
    entities = [("a", e, n) for e, n in names.items()] + [("b", "o", "orders"), ("b", "c", "customers")]
    keys = [("a", "c", ["id"], 0), ("a", "o", ["order_id"], 2), ("a", "p", ["id"], 0), ("a", "q", ["ID"], 3), ("a", "x", ["order_id", "z_id"], 3), ("a", "n", ["id"], 3), ("b", "c", ["id"], 0)]
    columns = [("a", "o", c) for c in ("order_id", "Customer_ID", "product_id", "known_id", "n_id", "note")] + [("a", "x", "order_id"), ("a", "c", "customer_id"), ("a", "c", "order_id"), ("b", "o", "product_id"), ("b", "o", "customers_id"), ("a", None, "order_id"), ("a", "o", None)]
    good, several = relate(spark, entities, columns, keys, [("a", "o", "KNOWN_id")])
    # the trusted of two products; a customer isn't its own reference, a key's column isn't a reference, scopes stay apart
    assert set(rows(good)) >= {("a", "o", "Customer_ID", "c", "id"), ("a", "o", "product_id", "q", "ID"), ("a", "c", "order_id", "o", "order_id"), ("b", "o", "customers_id", "c", "id")}
    assert {r[1:3] for r in rows(good)} == {("o", "Customer_ID"), ("o", "product_id"), ("c", "order_id"), ("o", "customers_id"), (None, "order_id")} and rows(several) == []
    # two tested keys: neither is guessed, and one of two is what remains beside the entity itself
    entities = [("a", e, "user") for e in "uvw"]
    good, several = relate(spark, entities, [("a", "u", "user_id"), ("a", "w", "user_id")], [("a", "u", ["id"], 2), ("a", "v", ["id"], 3)])
    assert rows(good) == [("a", "u", "user_id", "v", "id")] and rows(several) == [("a", "w", "user_id", 2)]


def test_a_name_that_everyone_holds_costs_a_sum(spark):
    n = 3000
    e = spark.range(n).selectExpr("'a' scope", "concat('e', id) entity", "'user' name")
    good, several = E.relationships_by_form(e, e.selectExpr("scope", "entity", "'user_id' column"), e.selectExpr("scope", "entity", "array('id') columns", "0 basis"), e.limit(0).selectExpr("scope", "entity", "'x' column"))
    assert good.count() == 0 and several.where(f"n_targets = {n - 1}").count() == n


def test_suggested_tests(spark):
    three = "scope string, entity string, column string"
    primary = frame(spark, [("a", "c", ["id"], 0), ("a", "o", ["oid"], 2)], "scope string, entity string, columns array<string>, basis int")
    unique = frame(spark, [("a", "c", ["mail"]), ("a", "o", ["oid"]), ("a", "o", ["x", "y"]), ("a", "c", ["nick"])], "scope string, entity string, columns array<string>")
    guessed = frame(spark, [("a", "o", "c_id", "c", "id")], three + ", to string, to_column string")
    joins = [("a", "c", "ID", "m1"), ("a", "c", "id", "m2"), ("a", "c", "id", "m2"), ("a", "o", "OID", "m1"), ("a", "o", "X", "m1"), ("a", "o", "fk", "m1"), ("a", "c", "nick", "m1"), ("b", "o", "oid", "m1")]
    got = E.suggested_tests(primary, unique, frame(spark, [("a", "c", "nick")], three), guessed, frame(spark, [("a", "o", "fk")], three), frame(spark, joins, three + ", reader string"))
    assert set(rows(got)) == {
        ("a", "c", "id", "unique+not_null", "untested_key", None), ("a", "c", "mail", "not_null", "unique_but_nullable", None), ("a", "o", "c_id", "relationship", "untested_relationship", "c.id"),
        ("a", "c", "ID", "not_null", "untested_join", "2"), ("b", "o", "oid", "not_null", "untested_join", "1"),
    }
    assert Counter(r["reason"] for r in got.collect())["untested_join"] == 2
