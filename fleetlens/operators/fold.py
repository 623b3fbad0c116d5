"""E5 in full: the state of every node of a run from its events, as a state that merges.

Events come in any order and any batches; ``seq`` is their order within a run. Everything but the
test counts is the value of a last event of some kind, so a state keeps (seq, value) pairs and two
states of a node merge by taking the later pair. Test counts depend on what was known at each
check; they are folded from a thin log of starts, finishes and checks. ``fold_nodes`` is the batch
form, ``fleetlens.streaming.live`` keeps the same states over a stream.

Columns of an event, null where its kind has none: ``scope, run_id, seq, at, kind, node, thread,
status``; of a finish ``started_at, finished_at, duration_ms, compile_ms, execute_ms,
rows_affected, adapter (map), error, blocked_by (array), tests (struct of passed, failed, warned,
skipped)``; of a check ``check, covers (array)``; of a run's start ``nodes (array), mode, live``;
of its end ``outcome``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = ["scope", "run_id"]
NODE = ["scope", "run_id", "node"]
COUNTS = ["passed", "failed", "warned", "skipped"]
#: A run without an end counts as live for so long after its last event.
LIVE_SECONDS = 600
#: Below any sum of counts.
NEVER = -(1 << 40)

KINDS = ("node_started", "node_finished", "node_queued")
#: Fields of a node's state.
FIELDS = ["status", "started_at", "thread", "error", "blocked_by", "adapter", "finished_at", "duration_ms", "compile_ms", "execute_ms", "rows_affected"]


def _is(kind: str) -> Column:
    return F.col("kind") == kind


def _fields() -> dict[str, tuple[Column, Column]]:
    """Of each field: the value an event gives, and whether it sets the field."""
    started, finished = _is("node_started"), _is("node_finished")
    known = lambda c: finished & F.col(c).isNotNull()
    out = {
        "status": (F.col("status"), finished),
        # a start sets both, the thread even to null
        "started_at": (F.when(started, F.col("at")).otherwise(F.col("started_at")), started | known("started_at")),
        "thread": (F.col("thread"), started | known("thread")),
        # errors and blockers of earlier finishes last only through finishes of the same outcome that say nothing
        "error": (F.col("error"), known("error") | (finished & ~F.col("status").eqNullSafe("error"))),
        "blocked_by": (F.col("blocked_by"), (finished & (F.size("blocked_by") > 0)) | (finished & ~F.col("status").eqNullSafe("skipped"))),
        "adapter": (F.col("adapter"), finished & (F.size("adapter") > 0)),
    }
    for c in ("finished_at", "duration_ms", "compile_ms", "execute_ms", "rows_affected"):
        out[c] = (F.col(c), known(c))
    return out


@dataclass
class States:
    """Mergeable states of nodes and runs, and the log that test counts are folded from."""

    nodes: DataFrame
    runs: DataFrame
    marks: DataFrame
    checks: DataFrame


def partial(events: DataFrame) -> States:
    """The states that a set of events amounts to. One shuffle each by node, by run, and none for the log, which keeps repeats."""
    listed = events.where(_is("run_started")).select("scope", "run_id", "seq", F.explode("nodes").alias("node"), F.lit("listed").alias("kind"))
    own = events.where(F.col("kind").isin(*KINDS) & F.col("node").isNotNull())
    rows = own.unionByName(listed, allowMissingColumns=True)
    last = [F.max_by(F.struct("seq", value.alias("value")), F.when(sets, F.col("seq"))).alias(name) for name, (value, sets) in _fields().items()]
    nodes = rows.groupBy(*NODE).agg(
        F.min("seq").alias("first"),
        F.min(F.when(_is("listed"), F.col("seq"))).alias("asked"),
        F.max(F.when(_is("node_queued"), F.col("seq"))).alias("queued"),
        F.max(F.when(_is("node_started"), F.col("seq"))).alias("start"),
        F.max(F.when(_is("node_finished"), F.col("seq"))).alias("finish"),
        *last,
    )
    begun, ended = _is("run_started"), _is("run_finished")
    runs = events.groupBy(*RUN).agg(
        F.max_by(F.struct("seq", "at", "mode", "live"), F.when(begun, F.col("seq"))).alias("begun"),
        F.max_by(F.struct("seq", "at", "outcome"), F.when(ended, F.col("seq"))).alias("ended"),
        F.collect_set(F.when(ended, F.col("seq"))).alias("ends"),
        F.max("at").alias("last_at"),
    )
    marks = own.where(_is("node_started") | _is("node_finished")).select(*NODE, "seq", "kind", "tests")
    checks = events.where(_is("check_finished")).select(*RUN, "check", "seq", "covers", "status")
    return States(nodes, runs, marks, checks)


def once(states: States) -> States:
    """States whose log holds each event once."""
    return States(states.nodes, states.runs, states.marks.dropDuplicates([*NODE, "seq", "kind"]), states.checks.dropDuplicates([*RUN, "check", "seq"]))


def merge(a: States, b: States) -> States:
    """Two states as one; events that both hold count once."""
    pairs = [F.max_by(c, F.col(c)["seq"]).alias(c) for c in FIELDS]
    nodes = a.nodes.unionByName(b.nodes).groupBy(*NODE).agg(
        F.min("first").alias("first"), F.min("asked").alias("asked"), F.max("queued").alias("queued"),
        F.max("start").alias("start"), F.max("finish").alias("finish"), *pairs,
    )
    runs = a.runs.unionByName(b.runs).groupBy(*RUN).agg(
        F.max_by("begun", F.col("begun")["seq"]).alias("begun"), F.max_by("ended", F.col("ended")["seq"]).alias("ended"),
        F.array_distinct(F.flatten(F.collect_list("ends"))).alias("ends"), F.max("last_at").alias("last_at"),
    )
    return once(States(nodes, runs, a.marks.unionByName(b.marks), a.checks.unionByName(b.checks)))


def test_changes(states: States) -> DataFrame:
    """What each event does to a node's test counts: (scope, run_id, node, seq, a_*, b_*, seen), of states whose log has no repeats.

    A count x becomes max(x + a, b). A check takes back what its last outcome added, never below zero,
    and adds the new one, at the nodes known by then. A finish that reports counts adds them; if
    the node was finished already it is a correction, and its counts replace what was there.
    """
    by_check = Window.partitionBy(*RUN, "check").orderBy("seq")
    c = states.checks.select(*RUN, "seq", "covers", "status", F.lag("covers").over(by_check).alias("old_covers"), F.lag("status").over(by_check).alias("old_status"))
    side = lambda covers, status, n: c.where(F.col(covers).isNotNull()).select(*RUN, "seq", F.explode(covers).alias("node"), F.col(status).alias("as"), F.lit(n).alias("n"))
    # in the counts, an unknown outcome is a skipped one
    each = side("covers", "status", 1).unionByName(side("old_covers", "old_status", -1)).withColumn("as", F.when(F.col("as") == "unknown", "skipped").otherwise(F.col("as")))
    add = lambda k: F.count_if((F.col("n") > 0) & (F.col("as") == k))
    back = lambda k: F.count_if((F.col("n") < 0) & (F.col("as") == k))
    checks = each.groupBy(*NODE, "seq").agg(
        *[(add(k) - back(k)).alias(f"a_{k}") for k in COUNTS], *[add(k).alias(f"b_{k}") for k in COUNTS], (F.count_if(F.col("n") > 0) > 0).alias("seen")
    )
    checks = checks.join(states.nodes.select(*NODE, "first"), NODE).where(F.col("first") < F.col("seq")).drop("first")
    by_node = Window.partitionBy(*NODE).orderBy("seq")
    m = states.marks.select(*NODE, "seq", "kind", "tests", F.lag("kind").over(by_node).alias("before"), F.lag("seq").over(by_node).alias("before_at"))
    m = m.where(F.col("tests").isNotNull() & (F.col("kind") == "node_finished"))
    m = m.join(states.nodes.select(*NODE, "first"), NODE).join(states.runs.select(*RUN, "ends"), RUN)
    # nodes that were still open when the run ended are finished: unknown
    shut = F.exists("ends", lambda e: (e > F.coalesce("before_at", "first")) & (e < F.col("seq")))
    replaces = F.col("before").eqNullSafe("node_finished") | shut
    told = {k: F.coalesce(F.col("tests")[k], F.lit(0)).cast("long") for k in COUNTS}
    finishes = m.select(
        *NODE, "seq", *[F.when(replaces, F.lit(NEVER)).otherwise(told[k]).alias(f"a_{k}") for k in COUNTS], *[told[k].alias(f"b_{k}") for k in COUNTS], F.lit(True).alias("seen")
    )
    return checks.unionByName(finishes)


def fold_tests(states: States) -> DataFrame:
    """(scope, run_id, node, tests): the changes in order, as the largest of each change's floor and what follows it."""
    changes = test_changes(states)
    after = Window.partitionBy(*NODE).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    steps = changes.select(*NODE, "seen", *[f"a_{k}" for k in COUNTS], *[(F.col(f"b_{k}") + F.coalesce(F.sum(f"a_{k}").over(after), F.lit(0))).alias(f"end_{k}") for k in COUNTS])
    g = steps.groupBy(*NODE).agg(F.max("seen").alias("seen"), *[F.greatest(F.max(f"end_{k}"), F.sum(f"a_{k}")).alias(k) for k in COUNTS])
    return g.where("seen").select(*NODE, F.struct(*COUNTS).alias("tests"))


def finish(states: States, now: Column | None = None) -> DataFrame:
    """The folded nodes of a state whose log has no repeats.

    With ``now``, nodes that are open in a run without an end that has been silent for ``LIVE_SECONDS``
    are unknown, and ``inferred`` says so; without it nothing is inferred.
    """
    value = lambda c: F.col(c)["value"].alias(c)
    n = states.nodes.join(states.runs.select(*RUN, F.col("ended")["seq"].alias("end"), "last_at"), RUN, "left").join(fold_tests(states), NODE, "left")
    done = F.col("finish").isNotNull() & (F.col("start").isNull() | (F.col("finish") > F.col("start")))
    left_open = F.col("end") > F.coalesce("start", "first")
    state = F.when(done, F.coalesce(F.col("status")["value"], F.lit("unknown"))).when(left_open, "unknown")
    state = state.when(F.col("start").isNull() | (F.col("queued") > F.col("start")), "queued").otherwise("running")
    silent = F.lit(False) if now is None else F.col("end").isNull() & (F.unix_timestamp(now) - F.unix_timestamp("last_at") > LIVE_SECONDS)
    inferred = silent & state.isin("queued", "running")
    return n.select(
        *NODE, F.coalesce(F.col("asked") == F.col("first"), F.lit(False)).alias("requested"), F.when(inferred, "unknown").otherwise(state).alias("status"), inferred.alias("inferred"),
        *[value(c) for c in ("started_at", "finished_at", "duration_ms", "compile_ms", "execute_ms", "rows_affected", "thread", "adapter", "error", "blocked_by")], "tests",
    )


def fold_nodes(events: DataFrame, now: Column | None = None) -> DataFrame:
    """E5: every node that the events of a run name, folded."""
    return finish(once(partial(events)), now)


def fold_runs(states: States) -> DataFrame:
    """The runs of a state: mode and liveness of the last start, outcome of the last end."""
    return states.runs.select(
        *RUN, F.col("begun")["mode"].alias("mode"), F.col("begun")["live"].alias("live"), F.col("begun")["at"].alias("started_at"),
        F.col("ended")["at"].alias("finished_at"), F.col("ended")["outcome"].alias("outcome"), "last_at",
    )
