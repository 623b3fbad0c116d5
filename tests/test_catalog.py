"""Coverage, columns and lineage changes at the catalog's width."""

from __future__ import annotations

import random
from collections import Counter

from fleetlens.operators import health as H
from fleetlens.operators import lineage as L


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_coverage_measures(spark):
    models = spark.createDataFrame([("a", "m", "m", 1, "text", 0), ("a", "n", "n", None, "  ", 2), ("a", "o", None, 0, None, None)], "scope string, node string, name string, tests int, description string, constraints int")
    sources = spark.createDataFrame([("b", "s", "s", None, None, "v"), ("b", "t", "t", None, None, None), ("b", "u", "u", "field", None, None)], "scope string, node string, name string, measured_with string, read_by_runs string, version string")
    counts, uncovered = H.coverage_measures(models, sources)
    assert {r[:2]: r[2:] for r in rows(counts)} == {
        ("a", "tests"): (1, 3), ("a", "descriptions"): (1, 3), ("a", "constraints"): (1, 3), ("a", "source_freshness"): (None, 0),
        ("b", "tests"): (None, 0), ("b", "descriptions"): (None, 0), ("b", "constraints"): (None, 0), ("b", "source_freshness"): (2, 3),
    }
    assert {r[:3] for r in rows(uncovered)} == {("a", "tests", "n"), ("a", "tests", "o"), ("a", "descriptions", "n"), ("a", "descriptions", "o"), ("a", "constraints", "m"), ("a", "constraints", "o"), ("b", "source_freshness", "t")}
    assert [rows(x) for x in H.coverage_measures(models.limit(0), sources.limit(0))] == [[], []]


def test_column_catalog(spark):
    f = lambda schema, *r: spark.createDataFrame(list(r), "scope string, node string, column string" + schema)
    listed = f(", lister string, type string", ("a", "t", "Id", "declared", "int"), ("a", "t", "ID", "warehouse", "BIGINT"), ("a", "t", "old", "warehouse", "TEXT"), ("a", "t", "kept", "warehouse", None), ("a", "t", "note", "declared", "text"), ("b", "t", "old", "declared", None))
    code = f("", ("a", "t", "KEPT"))
    tests = f(", test string", ("a", "t", "iD", "unique"), ("a", "t", "id", "not_null"), ("a", "t", "id", "unique"))
    constraints = f(", constraint string", ("a", "t", "NOTE", "check"))
    edges = f(", from_node string, from_column string", ("a", "t", "ID", "s", "x"), ("a", "t", "id", "t", "note"), ("a", "t", "id", "s", "x"), ("a", "t", "id", "s", None))
    assert rows(H.column_catalog(listed, code, tests, constraints, edges)) == [
        ("a", "t", "Id", "BIGINT", "warehouse", False, "not_null,unique", None, "note,s.x"), ("a", "t", "kept", None, None, False, None, None, None),
        ("a", "t", "note", "text", "declared", False, None, "check", None), ("a", "t", "old", "TEXT", "warehouse", True, None, None, None), ("b", "t", "old", None, None, False, None, None, None),
    ]


def expected(before, after, ob, oa):
    """One relation at a time, as a reader would compare two lists of columns."""
    out = set()
    for key, (opaque, digest) in after.items():
        old, new = ob.get(key, []), oa.get(key, [])
        names = [Counter(c for c, _ in x) for x in (old, new)]
        if key not in before or opaque or before[key][0] or before[key][1] != digest or any(n > 1 for x in names for n in x.values()):
            why = "new" if key not in before else "opaque" if opaque or before[key][0] else "row_digest" if before[key][1] != digest else "duplicate_name"
            out.add((*key, "rows", None, why))
            continue
        was, now = dict(old), dict(new)
        out |= {(*key, "added", c, None) for c in now if c not in was} | {(*key, "removed", c, None) for c in was if c not in now}
        out |= {(*key, "modified", c, "digest") for c in now if c in was and was[c] != now[c]}
        pairs = zip([c for c, _ in old if c in now], [c for c, _ in new if c in was], strict=True)
        out |= {(*key, "modified", b, "moved") for a, b in pairs if a != b and was[b] == now[b]}
    return out


def test_relation_changes_against_brute_force(spark):
    rng = random.Random(5)
    sides = []
    for _ in range(2):
        heads, outputs = {}, {}
        for key in [(s, f"n{i}") for s in "ab" for i in range(150)]:
            if rng.random() < 0.9:
                heads[key] = (rng.random() < 0.05, rng.choice(["d", "d", "d", "d", None]))
                names = rng.sample("pqrst", rng.randrange(6)) if rng.random() < 0.5 else list("pqrst")
                outputs[key] = [(c, rng.choice(["e", "e", "e", None])) for c in names + (["p"] if rng.random() < 0.05 else [])]
        sides.append((heads, outputs))
    (before, ob), (after, oa) = sides
    head = lambda h: spark.createDataFrame([(*k, *v) for k, v in h.items()], "scope string, node string, opaque boolean, row_digest string")
    outs = lambda o: spark.createDataFrame([(*k, c, d, i) for k, v in o.items() for i, (c, d) in enumerate(v)], "scope string, node string, column string, digest string, ordinal int")
    got = L.relation_changes(head(before), head(after), outs(ob), outs(oa))
    want = expected(before, after, ob, oa)
    assert set(rows(got)) == want and got.count() == len(want) and {r[4] for r in want} == {"new", "opaque", "row_digest", "duplicate_name", "digest", "moved", None}
