"""What a user adds to the engine: checks, error catalogues, lineage sources, readings and probes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.erd import probe
from fleetlens.operators.failures import classify_errors
from fleetlens.operators.health import reconcile
from fleetlens.operators.state import choose_source_versions


class Registry:
    """Registered extensions of one session. A name registers once; a second time raises."""

    def __init__(self):
        self.checks: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {}
        self.catalogues: list[tuple[str, str, DataFrame]] = []
        self.lineage: dict[str, Callable[[SparkSession], DataFrame]] = {}
        self.readings: dict[str, DataFrame] = {}
        self.probes: dict[str, tuple[dict[str, Column], Column, Callable[[str], bool]]] = {}

    def _new(self, name: str, taken) -> None:
        if name in taken:
            raise ValueError(f"{name} is registered already")

    def register_check(self, name: str, severity: str, fn: Callable[[DataFrame], DataFrame]) -> None:
        """A health check; ``fn`` maps the nodes asked about to ``(node, status)``."""
        self._new(name, self.checks)
        if severity not in ("error", "warn"):
            raise ValueError(f"no such severity: {severity}")
        self.checks[name] = (severity, fn)

    def findings(self, asked: DataFrame, everyone: DataFrame) -> DataFrame:
        """The registered checks' findings for ``asked``, reconciled by H8; each check is one pass."""
        out = []
        for name, (severity, fn) in self.checks.items():
            answers = fn(asked)
            answers = answers.select(*[c for c in ("scope",) if c in everyone.columns], F.lit(name).alias("check"), "node", "status")
            out.append(reconcile(asked, answers, everyone, [name]).withColumn("severity", F.lit(severity)))
        return reduce(DataFrame.unionByName, out)

    def register_catalogue(self, name: str, version: str, patterns: DataFrame) -> None:
        """Error patterns ``(ordinal, pattern, kind, phrases ARRAY, symptom, category)``; earlier catalogues win."""
        self._new(name, [n for n, _, _ in self.catalogues])
        self.catalogues.append((name, version, patterns))

    def classify(self, errors: DataFrame) -> DataFrame:
        """Errors by the catalogues' patterns."""
        ranked = [p.withColumn("catalogue_rank", F.lit(i)) for i, (_, _, p) in enumerate(self.catalogues)]
        return classify_errors(errors, reduce(DataFrame.unionByName, ranked))

    def register_lineage_source(self, name: str, fn: Callable[[SparkSession], DataFrame]) -> None:
        """D3: a source of observed edges."""
        self._new(name, self.lineage)
        self.lineage[name] = fn

    def observed(self, spark: SparkSession) -> DataFrame:
        """The edges that any source saw, each once."""
        return reduce(DataFrame.unionByName, [fn(spark) for fn in self.lineage.values()]).distinct()

    def register_reading(self, capability: str, versions: DataFrame) -> None:
        """Versions ``(source, version)`` that a provider reads; earlier registrations are preferred."""
        self._new(capability, self.readings)
        self.readings[capability] = versions

    def versions(self) -> DataFrame:
        """Of each source the version of the most preferred reading that has one."""
        ranked = [v.select("source", F.lit(i).alias("rank"), "version", F.lit(c).alias("strategy")) for i, (c, v) in enumerate(self.readings.items())]
        return choose_source_versions(reduce(DataFrame.unionByName, ranked))

    def register_probe(self, name: str, aggregates: dict[str, Column], condition: Column, select: Callable[[str], bool] = lambda _: True) -> None:
        """One row of aggregates of each selected relation, and the condition on it that passes."""
        self._new(name, self.probes)
        self.probes[name] = (aggregates, condition, select)

    def probe_values(self, relations: dict[str, DataFrame]) -> DataFrame:
        """All probes' values as ``(probe, node, column, value)``."""
        return reduce(DataFrame.unionByName, [probe(df, n, a).withColumn("probe", F.lit(p)) for p, (a, _, wanted) in self.probes.items() for n, df in relations.items() if wanted(n)])

    def probe_findings(self, relations: dict[str, DataFrame]) -> DataFrame:
        """All probes' verdicts: a condition that is null is unknown, never a pass."""
        out = []
        for p, (aggregates, condition, wanted) in self.probes.items():
            for n, df in relations.items():
                if wanted(n):
                    row = df.agg(*[c.alias(k) for k, c in aggregates.items()])
                    out.append(row.select(F.lit(p).alias("probe"), F.lit(n).alias("node"), F.when(condition, "pass").when(~condition, "fail").otherwise("unknown").alias("status")))
        return reduce(DataFrame.unionByName, out)
