"""Artifacts written from the test tables, one set of files a project of 500 nodes, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.bindings import bind, oracle, tables
from fleetlens.plans.shared import checkpoint_dir
from fleetlens.queries.fold import replay
from fleetlens.sources import artifacts as A
from fleetlens.sources import tables as T

QUERIES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/fleetlens/{uuid.uuid4().hex}/artifacts"


def project_files(spark: SparkSession, documents: DataFrame) -> str:
    """Write ``documents(scope, value)``, one document a scope, each to a file in its scope's folder."""
    where = folder(spark)
    documents.repartition(F.col("scope")).write.partitionBy("scope").text(where)
    return where


def by_name(*rows):
    """A JSON object of a project's (name, content) rows; a project has 500 nodes at most."""
    return F.map_from_entries(F.collect_list(F.struct(*rows)))


PARTS = """SELECT 'p' || CAST(CAST(floor(p_partkey / 500) AS BIGINT) AS STRING) AS scope, 'model.x.' || CAST(p_partkey AS STRING) AS node, p_name AS name, p_partkey AS k, p_type AS type, p_brand AS brand,
 CASE WHEN p_partkey % 4 = 3 THEN 'test' ELSE 'model' END AS kind, CASE WHEN p_partkey % 500 > 0 THEN 'model.x.' || CAST(p_partkey - 1 AS STRING) END AS parent FROM part"""
PROJECTS = f"WITH n AS ({PARTS})"


def parts(spark, sf):
    tables(spark, sf)
    return spark.sql(PARTS)


def manifests(spark, sf):
    n = parts(spark, sf)
    content = F.struct(
        F.col("node").alias("unique_id"), "name", F.col("kind").alias("resource_type"), F.lit("db").alias("database"), F.col("brand").alias("schema"), F.col("name").alias("alias"),
        F.struct(F.array_compact(F.array("parent")).alias("nodes"), F.array().cast("array<string>").alias("macros")).alias("depends_on"),
        F.create_map(F.lit("c"), F.struct(F.lit("c").alias("name"), F.col("type").alias("data_type"))).alias("columns"), F.struct(F.sha2("name", 256).alias("checksum")).alias("checksum"),
    )
    version = F.when(F.col("scope") == "p1", "https://x/manifest/v99.json").otherwise("https://x/manifest/v12.json")
    docs = n.groupBy("scope").agg(by_name("node", content).alias("nodes")).select("scope", F.to_json(F.struct(F.struct(version.alias("dbt_schema_version")).alias("metadata"), "nodes")).alias("value"))
    return A.read_manifest(spark, project_files(spark, docs))


@query("s1_manifest_nodes", f"{PROJECTS} SELECT scope, node, name, kind AS resource_type, brand AS \"schema\", sha256(name) AS checksum FROM n WHERE kind <> 'test' AND scope <> 'p1'")
def s1(spark, sf):
    return manifests(spark, sf)["nodes"].select("scope", "node", "name", "resource_type", "schema", "checksum")


@query("s1_manifest_edges", f"{PROJECTS} SELECT scope, parent, node AS child FROM n WHERE parent IS NOT NULL AND scope <> 'p1'")
def s1_edges(spark, sf):
    return manifests(spark, sf)["edges"]


@query("s2_catalog", f"{PROJECTS} SELECT scope, node, 'view' AS kind, c AS \"column\", CASE c WHEN 'id' THEN 'int' ELSE type END AS type, CASE c WHEN 'id' THEN 1 ELSE 2 END AS ordinal FROM n, (SELECT unnest(['id', 'what']) AS c)")
def s2(spark, sf):
    column = lambda name, kind, at: F.struct(F.lit(name).alias("name"), kind.alias("type"), F.lit(at).alias("index"))
    content = F.struct(F.struct(F.lit("view").alias("type")).alias("metadata"), F.create_map(F.lit("id"), column("id", F.lit("int"), 1), F.lit("what"), column("what", F.col("type"), 2)).alias("columns"))
    docs = parts(spark, sf).groupBy("scope").agg(by_name("node", content).alias("nodes")).select("scope", F.to_json(F.struct("nodes")).alias("value"))
    return A.read_catalog(spark, project_files(spark, docs))


@query("s3_info_schema_edges", f"{PROJECTS} SELECT parent, node AS child, false AS macro FROM n WHERE parent IS NOT NULL UNION ALL SELECT 'macro.' || brand, node, true FROM n")
def s3(spark, sf):
    n, where = parts(spark, sf), folder(spark)
    n.select("node", "name").write.parquet(f"{where}/nodes")
    n.where("parent is not null").select("parent", F.col("node").alias("child")).unionByName(n.select(F.concat(F.lit("macro."), "brand").alias("parent"), F.col("node").alias("child"))).write.parquet(f"{where}/edges")
    got = A.read_info_schema(spark, where)
    return got["edges"].withColumn("macro", F.lit(False)).unionByName(got["macro_edges"].withColumn("macro", F.lit(True)))


@query("s4_run_results", f"{PROJECTS} SELECT scope, 'inv-' || scope AS run_id, node, CASE k % 3 WHEN 0 THEN 'error' ELSE 'success' END AS status, timestamp '2024-01-01 00:00:00' + INTERVAL 1 second * CAST(k % 60 AS INTEGER) AS started_at, 'T' || (k % 4) AS thread, CASE WHEN k % 5 > 0 THEN k END AS rows_affected FROM n")
def s4(spark, sf):
    began = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("k") % 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    result = F.struct(
        F.col("node").alias("unique_id"), F.when(F.col("k") % 3 == 0, "error").otherwise("success").alias("status"), F.concat(F.lit("T"), F.col("k") % 4).alias("thread_id"),
        F.array(F.struct(F.lit("compile").alias("name"), F.lit("2023-01-01T00:00:00Z").alias("started_at")), F.struct(F.lit("execute").alias("name"), began.alias("started_at"))).alias("timing"),
        F.when(F.col("k") % 5 > 0, F.create_map(F.lit("rows_affected"), F.col("k").cast("string"))).alias("adapter_response"),
    )
    docs = parts(spark, sf).groupBy("scope").agg(F.collect_list(result).alias("results"))
    docs = docs.select("scope", F.to_json(F.struct(F.struct(F.concat(F.lit("inv-"), "scope").alias("invocation_id")).alias("metadata"), "results")).alias("value"))
    return A.read_run_results(spark, project_files(spark, docs)).select("scope", "run_id", "node", "status", "started_at", "thread", "rows_affected")


@query("s5_source_freshness", f"{PROJECTS} SELECT scope, node AS source, CASE k % 4 WHEN 0 THEN 'runtime error' WHEN 1 THEN 'warn' ELSE 'pass' END AS status, CASE WHEN k % 4 > 1 THEN timestamp '2024-05-01 10:00:00' END AS loaded_at, CASE WHEN k % 4 = 0 THEN 'gone ' || k END AS error FROM n")
def s5(spark, sf):
    kind = F.when(F.col("k") % 4 == 0, "runtime error").when(F.col("k") % 4 == 1, "warn").otherwise("pass")
    at = F.when(F.col("k") % 4 > 1, "2024-05-01T10:00:00Z").when(F.col("k") % 4 == 1, "not a time")
    result = F.struct(F.col("node").alias("unique_id"), kind.alias("status"), at.alias("max_loaded_at"), F.when(F.col("k") % 4 == 0, F.concat(F.lit("gone "), "k")).alias("error"))
    docs = parts(spark, sf).groupBy("scope").agg(F.collect_list(result).alias("results")).select("scope", F.to_json(F.struct("results")).alias("value"))
    fine, bad = A.read_source_freshness(spark, project_files(spark, docs))
    return fine.withColumn("error", F.lit(None).cast("string")).unionByName(bad.withColumn("status", F.lit("runtime error")), allowMissingColumns=True)


@query("s6_read_journals", oracle("SELECT scope, run_id, seq, at, kind, node, status, rows_affected FROM run_journal UNION ALL SELECT scope, run_id, seq, at, kind, node, status, rows_affected FROM run_journal WHERE seq % 10 = 0", "run_journal"))
def s6(spark, sf):
    _, root = replay(spark, sf)
    return A.read_journals(spark, f"{root}/journals")[0].select("scope", "run_id", "seq", "at", "kind", "node", "status", "rows_affected")


@query("s7_engine_log_events", oracle("SELECT scope, node, at, kind, CASE WHEN kind = 'node_finished' THEN status END AS status, thread FROM run_events WHERE kind IN ('node_started', 'node_finished')", "run_events"))
def s7(spark, sf):
    e = bind(spark, sf, "run_events").withColumn("ts", F.date_format(F.col("at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    name = F.when(F.col("kind") == "node_started", "NodeStart").when(F.col("kind") == "node_finished", "NodeFinished").otherwise("Other")
    line = F.to_json(F.struct(F.struct(name.alias("name"), "ts", "thread").alias("info"), F.struct(F.struct(F.col("node").alias("unique_id"), F.col("status").alias("node_status")).alias("node_info")).alias("data")))
    return A.engine_log_events(e.select("scope", line.alias("value")).unionByName(e.select("scope", F.lit("no json").alias("value"))))


@query("s12_snapshot_table", oracle(""", s AS (SELECT DISTINCT scope, run_id, CAST(substr(run_id, 5) AS BIGINT) AS id FROM ledger_nodes), f AS (SELECT scope, min(id) AS a FROM s GROUP BY scope),
 g AS (SELECT s.scope, min(id) AS b FROM s JOIN f USING (scope) WHERE id > a GROUP BY s.scope) SELECT scope, id AS snapshot_id, CASE WHEN id > a THEN a END AS parent FROM s JOIN f USING (scope) JOIN g USING (scope) WHERE id IN (a, b)""", "ledger_nodes"))
def s12_table(spark, sf):
    """Every run of a scope offers a first snapshot, then one onto the first: one of each is accepted; all is sent twice."""
    led = bind(spark, sf, "ledger_nodes").select("scope", "run_id", F.expr("cast(substr(run_id, 5) as bigint)").alias("snapshot_id")).distinct()
    into = T.SnapshotTable(spark, f"{folder(spark)}/snapshots")
    at = lambda d: F.lit(f"2024-01-0{d}").cast("timestamp")
    for _ in range(2):
        into.append(led.withColumns({"parent": F.lit(None).cast("bigint"), "created_at": at(1)}))
    heads = into.heads().select("scope", F.col("head").alias("parent"))
    then = led.join(heads, "scope").where(F.col("snapshot_id") > F.col("parent")).withColumn("created_at", at(2)).checkpoint()
    for _ in range(2):
        into.append(then)
    return into.read().select("scope", "snapshot_id", "parent")


@query("s13_ledger_table", oracle("SELECT scope, run_id, node, action, build_ms FROM ledger_nodes", "ledger_nodes"))
def s13(spark, sf):
    led = bind(spark, sf, "ledger_nodes").where("node is not null")
    few = led.withColumn("bucket", F.concat(F.lit("b"), F.pmod(F.xxhash64("run_id"), F.lit(8)))).select("scope", "bucket", "run_id", "node", "action", "build_ms")
    into = T.RunTable(spark, f"{folder(spark)}/ledger", few.schema, key="bucket")
    for _ in range(2):
        into.write(few)
    return into.read().drop("bucket")


@query("x1_stream_journals", oracle("SELECT scope, count(*) + count(*) FILTER (seq % 10 = 0) + count(*) FILTER (seq % 50 = 0) AS lines FROM run_journal GROUP BY scope", "run_journal"))
def x1(spark, sf):
    lines, root = replay(spark, sf)
    where = folder(spark)
    for _ in range(2):  # the second start has nothing left to read
        lines.writeStream.format("parquet").option("path", where).option("checkpointLocation", f"{root}/lines").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(where).groupBy("scope").agg(F.count(F.lit(1)).alias("lines"))
