"""The registered queries: each operator applied to the test tables, with SQL to compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def everything() -> dict[str, tuple[Query, str | None]]:
    from fleetlens.queries import catalog, erd, failures, fold, graphs, health, history, keys, lineage, project, records, runs, scalars, semantic, simulation, sources, state

    out: dict[str, tuple[Query, str | None]] = {}
    for module in (runs, fold, history, scalars, graphs, state, lineage, erd, health, failures, project, sources, keys, records, catalog, simulation, semantic):
        out |= module.QUERIES
    return out
