"""S14 in full: OpenLineage events of a column graph, one JSON document a node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.scalars import stable_uuid

# Schemas of the OpenLineage specification, and the ways of using a column in its order.
EVENT_SCHEMA = "https://openlineage.io/spec/2-0-2/OpenLineage.json"
FACET_SCHEMA = "https://openlineage.io/spec/facets/1-2-0/ColumnLineageDatasetFacet.json#/$defs/ColumnLineageDatasetFacet"
WAYS = [
    ("DIRECT", "IDENTITY"), ("DIRECT", "TRANSFORMATION"), ("DIRECT", "AGGREGATION"), ("INDIRECT", "JOIN"), ("INDIRECT", "FILTER"),
    ("INDIRECT", "GROUP_BY"), ("INDIRECT", "SORT"), ("INDIRECT", "WINDOW"), ("INDIRECT", "CONDITIONAL"),
]
EVENT_KINDS = ("job", "run")
PLACEMENTS = ("dataset", "dataset_and_fields")


def _input_fields(uses: DataFrame, of: list[str], namespace: str) -> DataFrame:
    """``of, input``: each input column once, with every way it is used, in the specification's order."""
    order = F.array(*[F.lit(f"{t} {s}") for t, s in WAYS])
    rank = F.array_position(order, F.concat_ws(" ", "type", "subtype"))
    way = F.struct(rank.alias("rank"), F.struct("type", "subtype", F.lit("").alias("description"), F.lit(False).alias("masking")).alias("way"))
    g = uses.groupBy(*of, "from_relation", "from_column").agg(F.array_sort(F.collect_set(way)).alias("ways"))
    entry = F.struct(F.lit(namespace).alias("namespace"), F.col("from_relation").alias("name"), F.col("from_column").alias("field"), F.transform("ways", lambda w: w["way"]).alias("transformations"))
    return g.select(*of, entry.alias("input"))


def lineage_events(
    nodes: DataFrame, reads: DataFrame, depends: DataFrame, outputs: DataFrame, inputs: DataFrame, row_inputs: DataFrame,
    *, dataset_namespace: str, job_namespace: str, producer: str, event_time: str, kind: str = "job", placement: str = "dataset",
) -> DataFrame:
    """``[scope,] node, event``, an event for every model or snapshot and every other node with analysed SQL.

    ``nodes(node, relation, resource_type, analysed, opaque, cache_key)``; ``reads(node, relation)`` of analysed SQL, else
    ``depends(node, relation)`` gives the inputs; ``outputs(node, column)``; ``inputs(node, column, from_relation,
    from_column, type, subtype)``; ``row_inputs(node, from_relation, from_column, subtype)``, which shape rows. All may have a
    ``scope``; a node's event holds the columns of that node alone. A node that is opaque or without analysed SQL gets
    table-level lineage and no column facet. ``placement`` says whether row inputs stand in the facet's ``dataset`` alone or
    in every field too. ``kind`` ``job`` gives static events, ``run`` complete runs, whose id depends on the job and the node's
    cache key only. An output without inputs has an empty list; equal rows count once.
    """
    if kind not in EVENT_KINDS or placement not in PLACEMENTS:
        raise ValueError(f"kind is one of {EVENT_KINDS}, placement one of {PLACEMENTS}")
    at = ["scope", "node"] if "scope" in nodes.columns else ["node"]
    analysed, opaque = F.coalesce("analysed", F.lit(False)), F.coalesce("opaque", F.lit(False))
    n = nodes.where(analysed | F.col("resource_type").isin("model", "snapshot")).select(*at, "relation", "cache_key", analysed.alias("analysed"), (analysed & ~opaque).alias("clear"))
    tables = reads.select(*at, "relation").withColumn("sql", F.lit(True)).unionByName(depends.select(*at, "relation").withColumn("sql", F.lit(False)))
    dataset = lambda name: F.struct(F.lit(dataset_namespace).alias("namespace"), name.alias("name"))
    read = lambda sql: F.transform(F.array_sort(F.collect_set(F.when(F.col("sql") == sql, F.col("relation")))), dataset)
    tables = tables.groupBy(*at).agg(read(True).alias("by_sql"), read(False).alias("by_hand"))

    shaping = row_inputs.select(*at, "from_relation", "from_column", F.lit("INDIRECT").alias("type"), "subtype")
    uses = inputs.select(*at, "column", "from_relation", "from_column", "type", "subtype")
    columns = outputs.select(*at, "column").distinct()
    if placement == "dataset_and_fields":
        uses = uses.unionByName(columns.join(shaping, at).select(*uses.columns))
    fields = columns.join(_input_fields(uses, [*at, "column"], dataset_namespace), [*at, "column"], "left")
    fields = fields.groupBy(*at, "column").agg(F.struct(F.array_sort(F.collect_list("input")).alias("inputFields")).alias("field"))
    fields = fields.groupBy(*at).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", "field")))).alias("fields"))
    whole = _input_fields(shaping, at, dataset_namespace).groupBy(*at).agg(F.array_sort(F.collect_list("input")).alias("dataset"))

    j = n.join(tables, at, "left").join(fields, at, "left").join(whole, at, "left")
    none = F.from_json(F.lit("[]"), whole.schema["dataset"].dataType)
    no_fields = F.from_json(F.lit("{}"), fields.schema["fields"].dataType)
    facet = F.struct(F.lit(producer).alias("_producer"), F.lit(FACET_SCHEMA).alias("_schemaURL"), F.coalesce("fields", no_fields).alias("fields"), F.coalesce("dataset", none).alias("dataset"))
    output = F.struct(F.lit(dataset_namespace).alias("namespace"), F.col("relation").alias("name"), F.when(F.col("clear"), F.struct(facet.alias("columnLineage"))).alias("facets"))
    no_tables = F.from_json(F.lit("[]"), tables.schema["by_sql"].dataType)
    name = F.col("node").cast("string")
    parts: list[Column] = [
        F.lit(event_time).alias("eventTime"), F.lit(producer).alias("producer"), F.struct(F.lit(job_namespace).alias("namespace"), name.alias("name")).alias("job"),
        F.coalesce(F.when(F.col("analysed"), F.col("by_sql")).otherwise(F.col("by_hand")), no_tables).alias("inputs"), F.array(output).alias("outputs"),
        F.lit(f"{EVENT_SCHEMA}#/$defs/{kind.title()}Event").alias("schemaURL"),
    ]
    if kind == "run":
        key = F.concat(F.lit(f"{job_namespace}/"), name, F.lit("/"), F.coalesce("cache_key", F.lit("")))
        parts += [F.lit("COMPLETE").alias("eventType"), F.struct(stable_uuid(key).alias("runId")).alias("run")]
    return j.select(*at, F.to_json(F.struct(*parts)).alias("event"))


def write_events(events: DataFrame, path: str) -> None:
    """One event a line, in the order of nodes over all files."""
    events.orderBy(*[c for c in events.columns if c != "event"]).select("event").write.mode("overwrite").text(path)
