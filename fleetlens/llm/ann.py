"""Approximate nearest neighbours by inner product over balanced posting lists.

*Fit* (bounded): k-means centroids from at most ``SAMPLE`` vectors, chosen by the hash of their
ids; clusters that hold over twice their share are split again. Inner products become Euclidean
distances by one more component that lifts every vector to the largest norm.

*Index* (everything): equal vectors are one class with their ``k + 1`` smallest ids; no other
member can be among the nearest, because ties go to smaller ids. Each class goes to its nearest
list and to every further one, up to ``COPIES``, whose distance is within ``BOUNDARY`` of the
nearest, so vectors at a boundary stand on both sides. Lists over ``LIST`` rows are dealt into
parts of about that size; a query visits all parts of a list.

*Search*: each query class walks a neighbour graph over the centroids (in memory, at most
``MAX_LISTS`` of them); the distance-ratio test selects lists among the ``PROBES`` nearest. A query's
``k + 2``-th best score within the sample is a floor of what its neighbours score. Selected lists whose
best possible score (centroid, plus the list's radius) is under the floor are pruned, which loses
nothing; all others, selected or not, are visited if their likely best (centroid, plus ``SPREAD``
deviations of the list's residuals) reaches it. So norms count, clustered data prune well, and data
without structure are scanned as far as it takes. Where the lists hold fewer than ``k + 1`` ids,
further ones follow in order of distance, over all lists if need be. Queries and parts meet by
(list, part, slice); a task holds one part and at most ``QUERIES`` of a list's queries, about. Scores are
sums in double precision, component by component, so equal vectors have equal scores.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.plans.shared import table

SAMPLE = 20_000
ROWS_A_LIST = 256
MAX_LISTS = 4096
LIST = 2048
COPIES = 2
BOUNDARY = 1.15
PROBES = 32
PRUNE = 1.6
DEGREE = 16
#: Deviations of a list's residuals (per component) that its likely best score is above its centroid's.
SPREAD = 3.0
#: Queries of a list that meet a part at a time.
QUERIES = 20_000


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, e) of the vectors that take part: not null, not zero, all components finite."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & fine & F.exists(e, lambda x: x != 0)).select("vec_id", e.alias("e"))


def fit_centroids(x: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means, then oversized clusters are split in two until all are balanced or can't be split."""
    rng = np.random.default_rng(7)
    lists = min(lists, len(x))
    c = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        for d in range(x.shape[1]):
            total = np.bincount(own, weights=x[:, d], minlength=len(c))
            n = np.maximum(np.bincount(own, minlength=len(c)), 1)
            c[:, d] = np.where(np.bincount(own, minlength=len(c)) > 0, total / n, c[:, d])
    for _ in range(8):
        own = _nearest(x, c)
        big = np.flatnonzero(np.bincount(own, minlength=len(c)) > 2 * max(8, len(x) // len(c)))
        new = []
        for b in big:
            part = x[own == b]
            far = part[np.argmax(((part - c[b]) ** 2).sum(axis=1))]
            if np.allclose(far, c[b]) or len(c) + len(new) >= MAX_LISTS:
                continue
            side = ((part - far) ** 2).sum(axis=1) < ((part - c[b]) ** 2).sum(axis=1)
            c[b] = part[~side].mean(axis=0) if (~side).any() else c[b]
            new.append(part[side].mean(axis=0))
        if not new:
            break
        c = np.vstack([c, *new])
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1), 0)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(x[at : at + 4096], c).argmin(axis=1) for at in range(0, len(x), 4096)])


def neighbour_graph(c: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Each centroid's nearest others, plus a ring that keeps the graph connected."""
    n = len(c)
    d = min(degree, n - 1)
    near = np.zeros((n, d), dtype=np.int64)
    for at in range(0, n, 1024):
        dist = _distances(c[at : at + 1024], c)
        dist[np.arange(len(dist)), np.arange(at, at + len(dist))] = np.inf
        near[at : at + len(dist)] = np.argsort(dist, axis=1)[:, :d]
    return np.hstack([near, (np.arange(n)[:, None] + 1) % n])


def graph_search(q: np.ndarray, c: np.ndarray, graph: np.ndarray, want: int) -> list[tuple[float, int]]:
    """Best-first walk over the centroids: about the ``want`` nearest, nearest first."""
    seen = np.zeros(len(c), dtype=bool)
    start = np.unique(np.linspace(0, len(c) - 1, min(8, len(c))).astype(np.int64))
    seen[start] = True
    todo = [(float(((c[s] - q) ** 2).sum()), int(s)) for s in start]
    best = [(-d, s) for d, s in todo]
    heapq.heapify(todo)
    heapq.heapify(best)
    while todo:
        d, at = heapq.heappop(todo)
        if len(best) >= want and d > -best[0][0]:
            break
        new = graph[at][~seen[graph[at]]]
        seen[new] = True
        for nd, s in zip(((c[new] - q) ** 2).sum(axis=1).tolist(), new.tolist(), strict=True):
            if len(best) < want or nd < -best[0][0]:
                heapq.heappush(todo, (nd, s))
                heapq.heappush(best, (-nd, s))
                if len(best) > want:
                    heapq.heappop(best)
    return sorted((-d, s) for d, s in best)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _chunked(column: pa.ChunkedArray) -> np.ndarray:
    return _matrix(column.combine_chunks())


def assigner(c: np.ndarray, norm: float):
    """Batches of classes to (list, home, off, rep, ids, e), boundary vectors more than once.

    ``home`` is the nearest list, ``off`` the distance to the centroid without the lifted component.
    """

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                x = _matrix(part.column("e"))
                lift = np.sqrt(np.maximum(norm**2 - (x**2).sum(axis=1), 0))
                d = np.sqrt(_distances(np.hstack([x, lift[:, None]]), c))
                few = min(COPIES, len(c))
                near = np.argpartition(d, few - 1, axis=1)[:, :few]
                dist = np.take_along_axis(d, near, axis=1)
                row, col = np.nonzero(dist <= dist.min(axis=1, keepdims=True) * BOUNDARY)
                out = part.take(pa.array(row))
                home = col == dist.argmin(axis=1)[row]
                lists = near[row, col]
                off = np.sqrt(((x[row] - c[lists, :-1]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array(home), pa.array(off), out.column("rep"), out.column("ids"), out.column("e")], ["list", "home", "off", "rep", "ids", "e"])

    return assign


@dataclass
class Lists:
    """What is known of all lists: centroids, parts, ids at home, radius and mean square of the residuals; and the sample."""

    c: np.ndarray
    parts: np.ndarray
    held: np.ndarray
    radius: np.ndarray
    spread: np.ndarray
    sample: np.ndarray


def visits(q: np.ndarray, graph: np.ndarray, lists: Lists, floor: float, size: float, need: int, probes: int, prune: float) -> list[int]:
    """The lists that a query visits, which together hold ``need`` ids, or all lists.

    ``held`` counts each class in its nearest list only, so a sum over lists counts none twice.
    ``size`` scales the query to the centroids, so that distance ratios are comparable.
    """
    scaled = np.append(q * size, 0.0)
    found = graph_search(scaled, lists.c, graph, probes)
    length = float(np.sqrt((q**2).sum()))
    middle = lists.c[:, :-1] @ q
    possible = middle + length * lists.radius * (1 + 1e-9) + 1e-9 >= floor
    likely = middle + length * lists.spread >= floor
    out = [s for d, s in found if d <= found[0][0] * prune**2 and possible[s]]
    seen = set(out)
    out += [s for s in np.flatnonzero(likely & possible).tolist() if s not in seen]
    have = int(lists.held[out].sum())
    if have < need:
        seen = set(out)
        for s in np.argsort(((lists.c - scaled) ** 2).sum(axis=1), kind="stable").tolist():
            if have >= need:
                break
            if s not in seen:
                out.append(s)
                have += int(lists.held[s])
    return out


def router(lists: Lists, need: int, probes: int, prune: float):
    """Batches of query classes to (list, part, q, qe): a row for each part that the query visits."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = lists.c
        graph = neighbour_graph(c)
        mean = np.sqrt((c**2).sum(axis=1)).mean()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                piece = b.slice(at, 256)
                x = _matrix(piece.column("qe"))
                if len(lists.sample) > need:
                    floors = -np.partition(-(x @ lists.sample.T), need, axis=1)[:, need] - 1e-9
                else:
                    floors = np.full(len(x), -np.inf)
                rows, to, part = [], [], []
                for i, q in enumerate(x):
                    for s in visits(q, graph, lists, floors[i], mean / np.sqrt((q**2).sum()), need, probes, prune):
                        for p in range(lists.parts[s]):
                            rows.append(i)
                            to.append(s)
                            part.append(p)
                out = piece.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(part, pa.int32()), out.column("q"), out.column("qe")], ["list", "part", "q", "qe"])

    return route


def scorer(k: int):
    """The ``k + 1`` best classes of one part for each of its queries."""

    def score(postings: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        reps = postings["rep"].to_numpy()
        if len(reps) and queries.num_rows:
            x = _chunked(postings["e"])
            ids = queries["q"].to_numpy()
            q = _chunked(queries["qe"])
            for at in range(0, len(q), 256):
                part = q[at : at + 256]
                s = np.zeros((len(part), len(x)))
                for d in range(x.shape[1]):
                    s += part[:, d, None] * x[None, :, d]
                for i in range(len(part)):
                    row = s[i]
                    if len(row) > k + 1:
                        least = np.partition(row, len(row) - k - 1)[len(row) - k - 1]
                        keep = np.flatnonzero(row >= least)
                    else:
                        keep = np.arange(len(row))
                    keep = keep[np.lexsort((reps[keep], -row[keep]))[: k + 1]]
                    found.append((np.full(len(keep), ids[at + i]), keep, row[keep]))
        if not found:
            return pa.table({"q": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int64()))})
        rows = np.concatenate([f[1] for f in found])
        return pa.table({"q": np.concatenate([f[0] for f in found]), "rep": reps[rows], "score": np.concatenate([f[2] for f in found]), "ids": postings["ids"].take(pa.array(rows)).combine_chunks().cast(pa.list_(pa.int64()))})

    return score


def nearest_neighbours(vectors: DataFrame, every: int = 20, k: int = 20, probes: int = PROBES, prune: float = PRUNE) -> DataFrame:
    """The ``k`` nearest others of each vector whose id is divisible by ``every``.

    Input ``vectors(vec_id, embedding, ...)``; other columns are ignored. Vectors that are null,
    zero or hold null or non-finite components take no part, nor do null ids. A query's own id
    is never its neighbour; a repeated id counts once, with its best score. Ties go to the
    smaller id. Fewer candidates than ``k`` are all returned; an empty table gives an empty
    result. Vectors of different lengths raise.

    Returns ``query_id, rank, vec_id, score``.
    """
    spark = vectors.sparkSession
    v = valid_vectors(vectors)
    empty = "query_id long, rank int, vec_id long, score double"
    first = v.withColumn("rn", F.row_number().over(Window.partitionBy("e").orderBy("vec_id"))).where(F.col("rn") <= k + 1)
    classes = table(first.groupBy("e").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "e"), "vector_classes")
    n = classes.count()
    if not n:
        return spark.createDataFrame([], empty)
    lengths = classes.agg(F.min(F.size("e")), F.max(F.size("e"))).first()
    if lengths[0] != lengths[1]:
        raise ValueError(f"vectors of {lengths[0]} to {lengths[1]} components")
    norm = float(classes.agg(F.max(F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()[0]) ** 0.5
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("e").toArrow()
    x = _chunked(sample["e"])
    x = np.hstack([x, np.sqrt(np.maximum(norm**2 - (x**2).sum(axis=1), 0))[:, None]])
    c = fit_centroids(x, max(1, min(MAX_LISTS // 2, n // ROWS_A_LIST)))

    kind = classes.schema["e"].dataType.simpleString()
    postings = table(classes.mapInArrow(assigner(c, norm), f"list int, home boolean, off double, rep long, ids array<long>, e {kind}"), "postings")
    lists = Lists(c, np.ones(len(c), np.int64), np.zeros(len(c), np.int64), np.zeros(len(c)), np.zeros(len(c)), x[:, :-1])
    square = F.col("off") * F.col("off")
    for r in postings.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("home"), F.size("ids")).otherwise(0)).alias("held"), F.max("off").alias("radius"), F.avg(square).alias("square")).collect():  # at most MAX_LISTS rows
        lists.parts[r["list"]] = -(-r["n"] // LIST)
        lists.held[r["list"]] = r["held"]
        lists.radius[r["list"]] = r["radius"]
        lists.spread[r["list"]] = SPREAD * np.sqrt(r["square"] / (x.shape[1] - 1))
    of_list = lambda values: F.element_at(F.lit(values), F.col("list") + 1)
    postings = postings.drop("home", "off").withColumn("part", F.pmod(F.xxhash64("rep"), of_list(lists.parts.tolist())).cast("int"))

    q = v.where(F.col("vec_id") % every == 0).select("vec_id", "e")
    mine = table(q.join(classes.select("e", "rep"), "e").select("vec_id", F.col("rep").alias("q")).distinct(), "queries")
    asked = classes.join(mine.select(F.col("q").alias("rep")).distinct(), "rep", "left_semi").select(F.col("rep").alias("q"), F.col("e").alias("qe"))
    probed = table(asked.repartition("q").mapInArrow(router(lists, k + 1, probes, prune), f"list int, part int, q long, qe {kind}"), "probed")
    slices = np.ones(len(c), dtype=np.int64)
    for r in probed.where("part = 0").groupBy("list").count().collect():  # at most MAX_LISTS rows
        slices[r["list"]] = -(-r["count"] // QUERIES)
    n_slices = of_list(slices.tolist())
    parts = postings.withColumn("slice", F.explode(F.sequence(F.lit(0), (n_slices - 1).cast("int"))))
    probed = probed.withColumn("slice", F.pmod(F.xxhash64("q"), n_slices).cast("int"))
    meet = ["list", "part", "slice"]
    near = parts.groupBy(*meet).cogroup(probed.groupBy(*meet)).applyInArrow(scorer(k), "q long, rep long, score double, ids array<long>")

    best = near.groupBy("q", "rep").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    best = best.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))).where(F.col("rn") <= k + 1)
    flat = best.select("q", "score", F.explode("ids").alias("cand"))
    flat = flat.groupBy("q", "cand").agg(F.max("score").alias("score"))
    flat = flat.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cand"))).where(F.col("rn") <= k + 1)
    top = table(flat.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "cand"))).alias("top")), "top")
    own = mine.join(top, "q").select("vec_id", F.slice(F.filter("top", lambda t: t["cand"] != F.col("vec_id")), 1, k).alias("top"))
    return own.select(F.col("vec_id").alias("query_id"), F.posexplode("top").alias("pos", "t")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("t.cand").alias("vec_id"), (-F.col("t.minus")).alias("score"))
