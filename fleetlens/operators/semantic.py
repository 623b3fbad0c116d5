"""G22 in full: what metrics read, and so what they can be sliced by and which models reach them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.failures import metric_closure
from fleetlens.plans.shared import cut


def metric_views(metrics: DataFrame, reads: DataFrame, models: DataFrame, dimensions: DataFrame, defined_on: DataFrame) -> DataFrame:
    """Every metric with its semantic models, their dimensions and the models that these are defined on.

    ``metrics(metric, name)``, ``reads(metric, reads)`` where what is read is a metric or a semantic model,
    ``models(model, name)``, ``dimensions(model, dimension)``, ``defined_on(model, node)``; all with a ``scope``
    or none. A metric reads through the metrics that it reads; a cycle ends where it repeats, and what is neither
    a metric nor a semantic model is passed over. Returns ``[scope,] metric, name, semantic_models`` (names in
    the order of the models' ids), ``dimensions, depends_on`` (sorted, each once); a metric that reaches no
    semantic model has empty lists.
    """
    within = ["scope"] if "scope" in metrics.columns else []
    reached = metric_closure(reads).select(*within, "metric", F.col("reads").alias("model")).distinct()
    used = cut(reached.join(models.select(*within, "model", F.col("name").alias("model_name")).dropDuplicates([*within, "model"]), [*within, "model"]))
    at = [*within, "metric"]
    named = used.groupBy(*at).agg(F.transform(F.array_sort(F.collect_list(F.struct("model", "model_name"))), lambda m: m["model_name"]).alias("semantic_models"))
    listed = lambda d, c, name: used.join(d.select(*within, "model", c).distinct(), [*within, "model"]).groupBy(*at).agg(F.array_sort(F.collect_set(c)).alias(name))
    out = metrics.select(*at, "name").join(named, at, "left").join(listed(dimensions, "dimension", "dimensions"), at, "left").join(listed(defined_on, "node", "depends_on"), at, "left")
    none = F.array().cast("array<string>")
    return out.select(*at, "name", *[F.coalesce(F.col(c).cast("array<string>"), none).alias(c) for c in ("semantic_models", "dimensions", "depends_on")])


def metrics_reached(views: DataFrame, changed: DataFrame) -> DataFrame:
    """The metrics that changed models reach: ``[scope,] node, metric``, by what the metrics depend on."""
    within = ["scope"] if "scope" in views.columns else []
    on = views.select(*within, "metric", F.explode("depends_on").alias("node"))
    return on.join(changed.select(*within, F.col("node").cast("string").alias("node")).distinct(), [*within, "node"], "left_semi").select(*within, "node", "metric")
