"""Licence notices without an anchor, and what the gate leaves out."""

from __future__ import annotations

from fleetlens.llm import license_scan as L

PROSE = ["the sun went down over the hills and nobody said a word", "in the morning they walked to the sea and back", "she wrote the work in an hour"]


def test_notices_without_an_anchor_are_found(spark):
    rows = [(1, "Distributed under the GPL v2 or later."), (2, "Released under CC BY-SA 4.0."), (3, "Intro text here.\n\nReleased under\nCC BY-SA 4.0."), (4, PROSE[0]), (5, None), (6, ""), (None, "Distributed under the GPL v2 or later."), (None, "x")]
    prose = [(100 + i, f"{p} {w}") for i in range(100) for p in PROSE for w in (f"day{i}",)]
    docs = spark.createDataFrame(rows + prose, "doc_id long, text string").selectExpr("*", "'x' AS row", "1 AS pos", "'y' AS family", "'z' AS paragraph")
    got = {r["doc_id"]: r for r in L.scan_licenses(docs.repartition(3)).collect()}
    assert {i: got[i]["license"] for i in (1, 2, 3, 4, 5, 6)} == {1: "gpl", 2: "cc-by-sa", 3: "cc-by-sa", 4: None, 5: None, 6: None}
    assert got[None]["license"] == "gpl" and got[1]["n_confirmed"] == 1 and got[1]["families"] == ["gpl"]
    assert all(got[i]["license"] is None for i, _ in prose)


def test_everyday_words_dont_pass_the_gate():
    gate = L.gate_words([f"{p} {i}" for i in range(300) for p in PROSE])
    assert {"gpl", "apache", "by-sa"} <= gate and gate.isdisjoint({"the", "and", "to", "in", "work"})
    assert L.pieces("the work went to the sea", gate) == [] and L.pieces("under the gpl", gate) == ["under the gpl"]
    assert L.pieces("All rights reserved.", frozenset()) == ["All rights reserved."]


def test_sparse_and_dense_probabilities_agree():
    model = L.fit(PROSE * 20)
    for text in ("Distributed under the GPL v2 or later.", "nothing of that", ""):
        assert abs(model.likelihood(text) - model.probabilities(model.vector(text))).max() < 1e-12
