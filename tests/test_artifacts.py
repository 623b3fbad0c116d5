"""Artifact readers and writers on small files."""

from __future__ import annotations

import hashlib
import json

from fleetlens.sources import artifacts as A


def test_info_schema_parts_macro_edges(spark, tmp_path):
    spark.createDataFrame([("model.a",)], "node string").write.parquet(str(tmp_path / "nodes"))
    spark.createDataFrame([("macro.m", "model.a"), ("model.b", "model.a")], "parent string, child string").write.parquet(str(tmp_path / "edges"))
    got = A.read_info_schema(spark, str(tmp_path))
    assert [r["parent"] for r in got["edges"].collect()] == ["model.b"]
    assert [r["parent"] for r in got["macro_edges"].collect()] == ["macro.m"]
    assert got["nodes"].count() == 1


def test_seed_columns_only_of_the_recorded_file(spark, tmp_path):
    (tmp_path / "good.csv").write_text("id,name\n1,x\n")
    (tmp_path / "changed.csv").write_text("id\n1\n")
    recorded = spark.createDataFrame([("good", hashlib.sha256(b"id,name\n1,x\n").hexdigest()), ("changed", "0")], "seed string, checksum string")
    got = {r["seed"]: r["columns"] for r in A.seed_columns(spark, str(tmp_path), recorded).collect()}
    assert got == {"good": ["id", "name"], "changed": None}


def test_ledger_is_idempotent_by_run(spark, tmp_path):
    entries = spark.createDataFrame([("a", "r1"), ("a", "r2"), ("b", "r1")], "scope string, run_id string")
    for _ in range(2):
        A.write_ledger(entries, str(tmp_path / "ledger"))
    got = sorted((r["scope"], r["run_id"]) for r in A.read_ledger_table(spark, str(tmp_path / "ledger")).collect())
    assert got == [("a", "r1"), ("a", "r2"), ("b", "r1")]


def test_engine_log_keeps_node_events(spark):
    start = '{"info": {"name": "NodeStart", "ts": "2024-01-01T00:00:00Z"}, "data": {"node_info": {"unique_id": "model.a"}}}'
    lines = spark.createDataFrame([("s", start), ("s", '{"info": {"name": "Other"}}'), ("s", "not json")], "scope string, value string")
    got = [(r["scope"], r["node"], r["kind"]) for r in A.engine_log_events(lines).collect()]
    assert got == [("s", "model.a", "node_started")]


def test_catalog_columns(spark, tmp_path):
    node = {"metadata": {"type": "view"}, "columns": {"id": {"name": "id", "type": "int", "index": 1}, "at": {"name": "at", "type": "date", "index": 2}}}
    (tmp_path / "catalog.json").write_text(json.dumps({"nodes": {"model.a": node}}))
    got = A.read_catalog(spark, str(tmp_path / "catalog.json")).select("node", "kind", "column", "type", "ordinal").collect()
    assert sorted(map(tuple, got)) == [("model.a", "view", "at", "date", 2), ("model.a", "view", "id", "int", 1)]


def test_source_freshness_keeps_runtime_errors_apart(spark, tmp_path):
    results = [
        {"unique_id": "source.a", "status": "pass", "max_loaded_at": "2024-05-01T10:00:00Z"},
        {"unique_id": "source.b", "status": "warn", "max_loaded_at": "not a time"},
        {"unique_id": "source.c", "status": "runtime error", "error": "no such table"},
    ]
    (tmp_path / "sources.json").write_text(json.dumps({"results": results}))
    fine, bad = A.read_source_freshness(spark, str(tmp_path / "sources.json"))
    assert sorted((r["source"], r["status"], str(r["loaded_at"])) for r in fine.collect()) == [("source.a", "pass", "2024-05-01 10:00:00"), ("source.b", "warn", "None")]
    assert [(r["source"], r["error"]) for r in bad.collect()] == [("source.c", "no such table")]
