"""Project artifacts as relations: manifests, catalogs, run results, freshness, journals, lineage logs, seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "struct<unique_id:string,name:string,resource_type:string,database:string,schema:string,alias:string,tags:array<string>,depends_on:struct<nodes:array<string>,macros:array<string>>,columns:map<string,struct<name:string,data_type:string>>,checksum:struct<checksum:string>>"
MANIFEST = f"metadata struct<dbt_schema_version:string,project_name:string>, nodes map<string,{NODE}>, sources map<string,struct<unique_id:string,name:string,source_name:string>>"
CATALOG = "nodes map<string,struct<metadata:struct<type:string,schema:string,name:string,database:string,owner:string>,columns:map<string,struct<name:string,type:string,index:int>>>>"
RESULT = "struct<unique_id:string,status:string,thread_id:string,execution_time:double,message:string,failures:bigint,timing:array<struct<name:string,started_at:string,completed_at:string>>,adapter_response:map<string,string>>"
RUN_RESULTS = f"metadata struct<invocation_id:string,generated_at:string>, results array<{RESULT}>"
FRESHNESS = "results array<struct<unique_id:string,status:string,max_loaded_at:string,snapshotted_at:string,error:string>>"
STATS = (
    "status string, started_at timestamp, finished_at timestamp, duration_ms bigint, compile_ms bigint, execute_ms bigint, rows_affected bigint, thread string, "
    "adapter map<string,string>, error string, blocked_by array<string>, tests struct<passed:bigint,failed:bigint,warned:bigint,skipped:bigint>"
)
EVENT = (
    f"run_id string, seq bigint, at timestamp, kind string, node string, check string, covers array<string>, {STATS}, "
    "nodes array<string>, mode string, live boolean, outcome string, version int, _bad string"
)
ENGINE = "info struct<name:string,level:string,ts:timestamp,thread:string>, data struct<node_info:struct<unique_id:string,node_status:string>>"
#: Versions of the manifest and journal schemas that are read.
MANIFESTS = tuple(f"v{n}.json" for n in range(9, 13))
JOURNAL = 1


def folder_of_file() -> Column:
    """The scope of a file: the folder that holds it, as such or as ``scope=name``."""
    return F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2), "^scope=", "")


def _json(spark: SparkSession, paths, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(paths).withColumn("scope", folder_of_file())


def read_manifest(spark: SparkSession, paths) -> dict[str, DataFrame]:
    """Nodes, edges, tests and columns of many projects; other schema versions go to ``refused``."""
    m = _json(spark, paths, MANIFEST)
    version = F.element_at(F.split("metadata.dbt_schema_version", "/"), -1)
    fine = m.where(version.isin(*MANIFESTS))
    n = fine.select("scope", F.explode(F.map_values("nodes")).alias("n")).select("scope", "n.*")
    edges = n.select("scope", F.explode("depends_on.nodes").alias("parent"), F.col("unique_id").alias("child")).distinct()
    return {
        "nodes": n.where("resource_type <> 'test'").select("scope", F.col("unique_id").alias("node"), "name", "resource_type", "database", "schema", "alias", "tags", F.col("checksum.checksum").alias("checksum")),
        "edges": edges, "tests": n.where("resource_type = 'test'").select("scope", F.col("unique_id").alias("check"), F.explode("depends_on.nodes").alias("node")),
        "columns": n.select("scope", F.col("unique_id").alias("node"), F.explode(F.map_values("columns")).alias("c")).select("scope", "node", F.col("c.name").alias("column"), F.col("c.data_type").alias("type")),
        "refused": m.where(~F.coalesce(version.isin(*MANIFESTS), F.lit(False))).select("scope", version.alias("version")),
    }


def read_catalog(spark: SparkSession, paths) -> DataFrame:
    """relations' columns and types."""
    c = _json(spark, paths, CATALOG).select("scope", F.explode("nodes").alias("node", "n"))
    return c.select("scope", "node", F.col("n.metadata.type").alias("kind"), F.explode(F.map_values("n.columns")).alias("c")).select("scope", "node", "kind", F.col("c.name").alias("column"), F.col("c.type").alias("type"), F.col("c.index").alias("ordinal"))


def read_info_schema(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """S3: columnar metadata tables; edges from macros apart from edges from nodes."""
    e = spark.read.parquet(f"{folder}/edges")
    macro = F.col("parent").startswith("macro.")
    return {"nodes": spark.read.parquet(f"{folder}/nodes"), "edges": e.where(~macro), "macro_edges": e.where(macro)}


def read_run_results(spark: SparkSession, paths) -> DataFrame:
    """One row a node result, with the execute step's times."""
    r = _json(spark, paths, RUN_RESULTS).select("scope", F.col("metadata.invocation_id").alias("run_id"), F.explode("results").alias("r"))
    step = F.get(F.filter("r.timing", lambda t: t["name"] == "execute"), F.lit(0))
    return r.select("scope", "run_id", F.col("r.unique_id").alias("node"), F.col("r.status").alias("status"), step["started_at"].try_cast("timestamp").alias("started_at"), step["completed_at"].try_cast("timestamp").alias("finished_at"), F.col("r.thread_id").alias("thread"), F.col("r.adapter_response")["rows_affected"].try_cast("bigint").alias("rows_affected"), F.col("r.message").alias("message"), F.col("r.failures").alias("failures"))


def read_source_freshness(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """The newest load of each source; runtime errors apart."""
    r = _json(spark, paths, FRESHNESS).select("scope", F.explode("results").alias("r")).select("scope", "r.*")
    bad = F.col("status") == "runtime error"
    fine = r.where(~bad).select("scope", F.col("unique_id").alias("source"), F.col("max_loaded_at").try_cast("timestamp").alias("loaded_at"), "status")
    return fine, r.where(bad).select("scope", F.col("unique_id").alias("source"), "error")


def parse_journal(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of JSON lines (column ``value``), and per scope how many lines couldn't be read.

    Torn lines and lines of newer versions are counted, not fatal; blank lines are skipped. An event is
    exploded from an array of one, since filters that were pushed below the parsing would each repeat it.
    """
    event = F.from_json("value", EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = lines.where(F.trim("value") != "").select("scope", F.explode(F.array(event)).alias("e"))
    bad = F.col("e._bad").isNotNull() | F.col("e.kind").isNull() | (F.coalesce("e.version", F.lit(JOURNAL)) > JOURNAL)
    return parsed.where(~bad).select("scope", "e.*").drop("_bad", "version"), parsed.groupBy("scope").agg(F.count_if(bad).alias("unreadable"))


def read_journals(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """S6 over files; the scope is the file's folder."""
    return parse_journal(spark.read.text(folder, recursiveFileLookup=True).withColumn("scope", folder_of_file()))


def engine_log_events(lines: DataFrame) -> DataFrame:
    """An engine's JSON log lines as run events; other lines are dropped."""
    p = lines.select("scope", F.from_json("value", ENGINE).alias("e")).where(F.col("e.info.name").isin("NodeStart", "NodeFinished"))
    return p.select("scope", F.col("e.data.node_info.unique_id").alias("node"), F.col("e.info.ts").alias("at"), F.when(F.col("e.info.name") == "NodeStart", "node_started").otherwise("node_finished").alias("kind"), F.when(F.col("e.info.name") == "NodeFinished", F.col("e.data.node_info.node_status")).alias("status"), F.col("e.info.thread").alias("thread"))


#: Columns that a lineage export must have, in any order.
LINEAGE = ["source_table_full_name", "source_column_name", "target_table_full_name", "target_column_name", "event_time"]


def observed_lineage(log: DataFrame) -> dict[str, DataFrame]:
    """An exported column-lineage log (strings): edges, row inputs (no target column), and counts.

    A table is its three parts where all are there, else its full name; records without a source
    or target table are skipped and counted.
    """
    missing = [c for c in LINEAGE if c not in log.columns]
    if missing:
        raise ValueError(f"the lineage export lacks {', '.join(missing)}")

    def table(side: str):
        parts = [f"{side}_table_{p}" for p in ("catalog", "schema", "name")]
        full = F.nullif(F.trim(f"{side}_table_full_name"), F.lit(""))
        if not all(p in log.columns for p in parts):
            return full
        whole = F.when(F.col(parts[0]).isNotNull() & F.col(parts[1]).isNotNull() & F.col(parts[2]).isNotNull(), F.concat_ws(".", *parts))
        return F.coalesce(whole, full)

    t = log.select(table("source").alias("source"), F.col("source_column_name").alias("source_column"), table("target").alias("target"), F.nullif(F.col("target_column_name"), F.lit("")).alias("target_column"), F.col("event_time").try_cast("timestamp").alias("at"))
    fine = F.col("source").isNotNull() & F.col("target").isNotNull()
    return {
        "edges": t.where(fine & F.col("target_column").isNotNull()).select("source", "source_column", "target", "target_column").distinct(),
        "row_inputs": t.where(fine & F.col("target_column").isNull()).select("source", "source_column", "target").distinct(),
        "stats": t.agg(F.count(F.lit(1)).alias("records"), F.count_if(~fine).alias("skipped"), F.min("at").alias("first_at"), F.max("at").alias("last_at")),
    }


def read_observed_lineage(spark: SparkSession, path: str, kind: str) -> dict[str, DataFrame]:
    """S8 from ``csv`` with a header, ``json`` (an array) or ``ndjson``."""
    if kind == "csv":
        return observed_lineage(spark.read.option("header", True).csv(path))
    schema = ", ".join(f"{c} string" for c in [*LINEAGE, *(f"{s}_table_{p}" for s in ("source", "target") for p in ("catalog", "schema", "name"))])
    return observed_lineage(spark.read.schema(schema).option("multiLine", kind == "json").json(path))


def seed_columns(spark: SparkSession, folder: str, recorded: DataFrame) -> DataFrame:
    """A seed's columns are its header, if the file's SHA-256 is the recorded one; else unknown (null)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    f = f.select(F.regexp_extract("path", r"([^/]+)\.csv$", 1).alias("seed"), F.sha2("content", 256).alias("sum"), F.split(F.regexp_replace(F.decode("content", "UTF-8"), r"(?s)\r?\n.*", ""), ",").alias("header"))
    return f.join(recorded, "seed", "left").select("seed", F.when(F.col("sum") == F.col("checksum"), F.col("header")).alias("columns"))


def write_ledger(entries: DataFrame, path: str) -> None:
    """Append entries, partitioned by scope."""
    entries.write.mode("append").partitionBy("scope").parquet(path)


def read_ledger_table(spark: SparkSession, path: str) -> DataFrame:
    """One entry a run, however often it was appended."""
    return spark.read.parquet(path).dropDuplicates(["scope", "run_id"])
