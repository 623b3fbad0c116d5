"""Plan helpers and searches against brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import failures as X
from fleetlens.operators import graphs as G
from fleetlens.plans import walk as W
from fleetlens.plans.asof import last_before
from fleetlens.plans.reach import reach_counts
from fleetlens.plans.strong import strong_components


def reachable(edges, start):
    seen, todo = set(), [start]
    while todo:
        for a, b in edges:
            if a == todo[0] and b not in seen:
                seen.add(b)
                todo.append(b)
        todo.pop(0)
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_strong_components_and_cycles_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    rows, edges = [], {}
    for scope, n, m in (("a", 14, 18), ("b", 10, 9), ("c", 12, 30)):
        edges[scope] = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        rows += [(scope, x, y) for x, y in edges[scope]]
    nodes = [(s, i) for s, n in (("a", 14), ("b", 10), ("c", 12)) for i in range(n)]
    n, e = spark.createDataFrame(nodes, "scope string, node long"), spark.createDataFrame(rows + [("a", 99, 1), rows[0]], "scope string, parent long, child long")
    reach = {(s, x): reachable(edges[s], x) for s, x in nodes}
    want = {(s, x, min(y for t, y in nodes if t == s and y in reach[s, x] and x in reach[s, y])) for s, x in nodes if x in reach[s, x]}
    assert {tuple(r) for r in strong_components(n, e).collect()} == want
    got = {r["scope"]: r["cycle"] for r in G.find_cycles(n, e).collect()}
    assert {s: c[0] for s, c in got.items()} == {s: min(x for t, x, _ in want if t == s) for s in {t for t, _, _ in want}}
    for s, c in got.items():
        assert c[0] == c[-1] and all(p in edges[s] for p in zip(c, c[1:], strict=False))
        dist, level = {}, [c[0]]
        while level and c[0] not in dist:
            level = sorted({b for a, b in edges[s] if a in level} - set(dist))
            dist |= {x: len(dist) and max(dist.values()) + 1 or 1 for x in level}
        assert len(c) - 1 == dist[c[0]]


def test_nodes_between_cycles_cost_no_search_each(spark):
    # two cycles, and a ladder of sixty nodes between them
    e = [(0, 1), (1, 0), (1, 10)] + [(i, i + 1) for i in range(10, 69)] + [(69, 80), (80, 81), (81, 80)]
    n = spark.createDataFrame([("s", i) for i in {x for p in e for x in p}], "scope string, node long")
    got = strong_components(n, spark.createDataFrame([("s", *p) for p in e], "scope string, parent long, child long"), max_rounds=3)
    assert {(r["node"], r["component"]) for r in got.collect()} == {(0, 0), (1, 0), (80, 80), (81, 80)}


@pytest.mark.parametrize("seed", range(2))
def test_reach_counts_of_random_graphs(spark, seed, monkeypatch):
    rng = random.Random(seed)
    edges = {s: {(rng.randrange(n), rng.randrange(n)) for _ in range(m)} for s, n, m in (("a", 40, 60), ("b", 25, 20))}
    rows = [(s, x, y) for s in edges for x, y in edges[s]]
    got = reach_counts(spark.createDataFrame(rows + rows[:5], "scope string, parent long, child long").repartition(3))
    want = {(s, x): len(reachable(edges[s], x) - {x}) for s in edges for x, _ in edges[s]}
    assert {(r["scope"], r["node"]): r["n"] for r in got.collect()} == want
    assert reach_counts(spark.createDataFrame([], "scope string, parent long, child long")).count() == 0


def test_walks_double(spark, monkeypatch):
    rounds = []
    kept = W.Scratch.table
    monkeypatch.setattr(W.Scratch, "table", lambda self, df, name: (rounds.append(name), kept(self, df, name))[1])
    steps = spark.range(4000).select(F.lit("a").alias("run"), F.col("id").alias("node"), (F.col("id") + 1).alias("to"))
    ring = spark.createDataFrame([("b", 0, 1), ("b", 1, 2), ("b", 2, 1)], "run string, node long, to long")
    starts = spark.createDataFrame([("a", 0), ("b", 0), ("c", 5)], "run string, node long")
    got = W.walk(starts, steps.unionByName(ring), ["run"], "node", "to")
    rows = {(r["run"], r["node"]): r["step"] for r in got.collect()}
    assert {k: v for k, v in rows.items() if k[0] != "a"} == {("b", 0): 0, ("b", 1): 1, ("b", 2): 2, ("c", 5): 0}
    assert len(rows) == 4001 + 4 and all(v == k[1] for k, v in rows.items() if k[0] == "a")
    assert rounds.count("path") - 1 <= math.ceil(math.log2(4001)) + 1  # 13 rounds


@pytest.mark.parametrize("buckets", [2, 7, 256])
def test_last_before_is_strictly_before(spark, buckets):
    rng = random.Random(buckets)
    moment = lambda: rng.choice([rng.randrange(50), rng.randrange(2000), 700])
    asked = [(rng.choice("ab"), moment()) for _ in range(150)] + [("c", 3), ("a", None)]
    known = [(rng.choice("ab"), moment(), i) for i in range(150)] + [("d", 1, 1), ("a", None, 7)]
    at = lambda df: df.withColumn("t", F.timestamp_seconds("t"))
    got = last_before(at(spark.createDataFrame(asked, "k string, t long")), at(spark.createDataFrame(known, "k string, t long, v long")), ["k"], "t", "v", buckets)
    want = {}
    for k, t in asked:
        before = [(u, v) for j, u, v in known if j == k and t is not None and u is not None and u < t]
        want[k, t] = max(before)[1] if before else None
    assert {(r["k"], r["t"]): r["v"] for r in got.select("k", F.unix_seconds("t").alias("t"), "v").collect()} == want
    assert last_before(at(spark.createDataFrame([], "k string, t long")), at(spark.createDataFrame([], "k string, t long, v long")), ["k"], "t", "v").count() == 0


def test_many_patterns_by_an_inverted_index(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    patterns = [(rng.randrange(3), i, f"p{i}", rng.choice([None, "K1", "K2"]), [text(rng.randint(1, 2)) for _ in range(rng.randint(1, 3))], "s", "c") for i in range(5000)]
    patterns += [(9, 0, "short", "K3", ["a"], "s", "c"), (9, 1, "any", "K4", [], "s", "c")]
    errors = [(i, rng.choice(["K1", "K2", "K3", "K4", "K5"]), text(rng.randint(1, 12)).upper()) for i in range(60)] + [(60, "K1", None), (61, None, "x"), (62, "K4", ""), (62, "K4", "")]
    got = X.classify_errors(spark.createDataFrame(errors, "id long, kind string, message string"), spark.createDataFrame(patterns, "catalogue_rank int, ordinal int, pattern string, kind string, phrases array<string>, symptom string, category string"))
    want = []
    for i, kind, message in errors:
        fit = [(r, o, p) for r, o, p, k, phrases, *_ in patterns if (k is None or k == kind) and all(x in (message or "").lower() for x in phrases)]
        want.append((i, min(fit)[2] if fit else None))
    assert sorted(((r["id"], r["pattern"]) for r in got.collect()), key=str) == sorted(want, key=str)
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_search_terms_against_a_scan(spark):
    rng = random.Random(6)
    label = lambda: " ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(2))
    items = [(i, s := label(), s + " ID" + str(i)) for i in range(300)] + [(300, "", ""), (301, None, None)]
    queries = [(i, t) for i, t in enumerate(["a", "ab", "ABA b", "é a", "id12", "", None, "a a", "zz", "ab é id1"])]
    got = X.SearchIndex(spark.createDataFrame(items, "item long, label string, haystack string")).search(spark.createDataFrame(queries, "query int, text string"), 5)
    want = []
    for q, t in queries:
        t = (t or "").strip().lower()
        hits = [(not (h or "").lower().startswith(t), len(lab or ""), lab or "", i) for i, lab, h in items if t and all(x in (h or "").lower() for x in t.split())]
        want += [(q, r, h[3]) for r, h in enumerate(sorted(hits)[:5], 1)]
    assert sorted((r["query"], r["rank"], r["item"]) for r in got.collect()) == sorted(want)


def test_value_sources_keep_no_pairs_of_seeds_and_what_lies_between(spark, monkeypatch):
    from fleetlens.operators import lineage
    from fleetlens.plans import fixpoint as plans

    largest = []
    monkeypatch.setattr(plans, "cut", lambda df, cut=plans.cut: (largest.append(df.count()), cut(df))[1])
    # twenty seeds over one chain of thirteen columns: 260 pairs of a seed and what lies between
    edges = [(f"n{i}", "c", f"n{i + 1}", "c") for i in range(12)] + [("n12", "c", f"s{i}", "c") for i in range(20)]
    e = spark.createDataFrame(edges, "from_relation string, from_column string, node string, to_column string")
    seeds = spark.createDataFrame([(f"s{i}", "c") for i in range(20)], "relation string, column string")
    got = {tuple(r) for r in lineage.value_sources(seeds, e).select("seed", "relation", "column").collect()}
    assert got == {(f"s{i}.c", "n0", "c") for i in range(20)}
    assert sum(largest) < 200


def test_explain_keeps_no_pairs_of_nodes_and_what_lies_between(spark, monkeypatch):
    from fleetlens.operators import graphs
    from fleetlens.plans import fixpoint as plans

    rows = []
    monkeypatch.setattr(plans, "cut", lambda df, cut=plans.cut: (rows.append(df.count()), cut(df))[1])
    plan = [("s", 0, "BUILD", "code_changed")] + [("s", i, "BUILD", "upstream_code_changed") for i in range(1, 13)]
    planned = spark.createDataFrame(plan, "scope string, node long, action string, reason string")
    edges = spark.createDataFrame([("s", i, i + 1) for i in range(12)], "scope string, parent long, child long")
    got = {tuple(r) for r in graphs.explain(planned, edges).select("node", "root", "root_reason").collect()}
    assert got == {(i, 0, "code_changed") for i in range(13)}
    assert sum(rows) < 50  # 91 pairs of a node and what it traces back through


@pytest.mark.parametrize("most", [0, 50_000])
def test_fixpoints_and_layers_are_the_same_however_frontiers_are_joined(spark, monkeypatch, most):
    from fleetlens.plans import fixpoint as plans

    monkeypatch.setattr(plans, "NEAR", most)
    edges = [(a, b) for a in range(40) for b in (2 * a, 2 * a + 1, 3 * a + 2) if b < 40 and a != b] + [(39, 3), (50, 51)]
    e = spark.createDataFrame([("s", *x) for x in edges], "scope string, parent long, child long")
    n = spark.createDataFrame([("s", i) for i in range(40)], "scope string, node long")
    seed = spark.createDataFrame([("s", 5)], "scope string, node long")
    step = lambda f: f.join(e.withColumnRenamed("parent", "node"), ["scope", "node"]).select("scope", F.col("child").alias("node"))
    seen = {5}
    while more := {b for a, b in edges if a in seen} - seen:
        seen |= more
    assert {r["node"] for r in plans.fixpoint(seed, step, ["scope", "node"]).collect()} == seen
    inner = [(a, b) for a, b in edges if b < 40 and a < 40]
    depth, left, at = {}, set(range(40)), 0
    while ready := {x for x in left if not any(b == x and a in left for a, b in inner)}:
        depth |= dict.fromkeys(ready, at)
        left, at = left - ready, at + 1
    assert {r["node"]: r["depth"] for r in plans.layers(n, e).collect()} == depth
