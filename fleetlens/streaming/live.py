"""The fold of runs over a stream, as tables of mergeable states.

Each micro-batch becomes its partial states (``operators.fold``), written under the batch's id, so a
batch that is retried overwrites itself and one that overlaps an earlier batch adds nothing. Readers
merge what is committed. Every ``compact_every`` batches what is there becomes one base, which
bounds the number of files and drops runs that have been silent for the retention time. Late events
correct as any others: only ``seq`` orders them. No Python runs on rows, and no state lives in the
memory of the stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.operators import fold

PARTS = ("nodes", "runs", "marks", "checks")


class FoldTable:
    """States of runs in a folder that all executors share: ``batch-N`` and ``base-N`` (all up to N)."""

    def __init__(self, spark: SparkSession, path: str, compact_every: int = 20, keep: str = "INTERVAL 7 DAYS"):
        self.spark, self.path = spark, path.rstrip("/")
        self.compact_every, self.keep = compact_every, keep

    def _fs(self, name: str = ""):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def committed(self) -> tuple[int | None, list[int]]:
        """The newest base, and the batches after it, of those that were written to the end."""
        fs, root = self._fs()
        if not fs.exists(root):
            return None, []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = {n.removesuffix(".done") for n in names if n.endswith(".done")}
        base = max((int(n[5:]) for n in done if n.startswith("base-")), default=None)
        return base, sorted(int(n[6:]) for n in done if n.startswith("batch-") and (base is None or int(n[6:]) > base))

    def _put(self, df: DataFrame, name: str, part: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/{part}")

    def _commit(self, name: str) -> None:
        fs, mark = self._fs(f"{name}.done")
        fs.create(mark, True).close()

    def _delete(self, name: str) -> None:
        for n in (f"{name}.done", name):
            fs, where = self._fs(n)
            fs.delete(where, True)

    def _read(self, names: list[str]) -> fold.States:
        return fold.States(*(self.spark.read.parquet(*[f"{self.path}/{n}/{part}" for n in names]) for part in PARTS))

    def states(self) -> fold.States | None:
        """What is committed, merged; None before the first batch."""
        base, batches = self.committed()
        names = [f"batch-{b}" for b in batches] + ([f"base-{base}"] if base is not None else [])
        if not names:
            return None
        read = self._read(names)
        none = fold.States(*(getattr(read, p).limit(0) for p in PARTS))
        return fold.merge(read, none)

    def append(self, events: DataFrame, batch: int) -> None:
        """Add a batch of events, which is read once for all its states; a batch that is already part of the base is skipped."""
        base, batches = self.committed()
        if base is not None and batch <= base:
            return
        events = events.persist()
        try:
            states = fold.partial(events)
            for part in PARTS:
                self._put(getattr(states, part), f"batch-{batch}", part)
        finally:
            events.unpersist()
        self._commit(f"batch-{batch}")
        if len(set(batches) | {batch}) >= self.compact_every:
            self.compact()

    def compact(self) -> None:
        """One base of all that is committed; bases and batches that an earlier one replaced are deleted.

        What the new base replaces stays until the next compaction, for readers that have begun.
        Runs whose last event is older than the retention time, by the newest event of all, are dropped.
        """
        base, batches = self.committed()
        if not batches:
            return
        states, name = self.states(), f"base-{batches[-1]}"
        last = states.runs.select(*fold.RUN, "last_at")
        old = last.join(F.broadcast(last.agg(F.max("last_at").alias("newest")))).where(~F.coalesce(F.expr(f"last_at >= newest - {self.keep}"), F.lit(False)))  # the newest is one row
        gone = old.select(F.col("scope").alias("of"), F.col("run_id").alias("gone"))
        none_gone = gone.isEmpty()
        for part in PARTS:
            merged = getattr(states, part)
            # few runs go at a time; where none does, nothing is joined
            alive = merged if none_gone else merged.join(gone, F.col("scope").eqNullSafe(F.col("of")) & F.col("run_id").eqNullSafe(F.col("gone")), "left_anti")
            self._put(alive, name, part)
        self._commit(name)
        fs, root = self._fs()
        for n in {s.getPath().getName().removesuffix(".done") for s in fs.listStatus(root)}:
            kind, _, at = n.partition("-")
            if base is not None and int(at) <= base and n != f"base-{base}" or kind == "base" and base is not None and int(at) < base:
                self._delete(n)

    def nodes(self, now: Column | None = None) -> DataFrame | None:
        """The folded nodes; with ``now``, silent runs' open nodes are unknown, inferred."""
        states = self.states()
        return None if states is None else fold.finish(states, now)


def live_fold(events: DataFrame, into: FoldTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Fold a stream of events into a table; ``trigger`` as for ``DataStreamWriter.trigger``."""

    def batch(df: DataFrame, batch_id: int) -> None:
        into.append(df, batch_id)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
