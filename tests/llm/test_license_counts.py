"""The licence scan's gate counts the whole corpus."""

from __future__ import annotations

from fleetlens.llm import license_scan


def test_everyday_words_are_counted_over_all_lines(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "SAMPLE", 1)  # a sample in which nothing can be everyday
    rows = [(i, f"record {i} of the terms and conditions") for i in range(200)] + [(900, "Released under CC BY-SA 4.0, as is.")] + [(1000 + i, "the mozilla said so again") for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    gate = license_scan.corpus_gate(d)
    assert not {"of", "the", "terms", "conditions"} & gate and {"by-sa", "under", "mozilla"} <= gate  # copies of a line count once
    found = {r["doc_id"]: r["n_candidates"] for r in license_scan.scan_licenses(d).collect()}
    assert found[900] == 1 and not any(found[i] for i in range(200)) and all(found[1000 + i] for i in range(20))
