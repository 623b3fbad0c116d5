"""Whitening of embeddings: principal components of the centred covariance, found by bisection.

*Fit.* Entries become whole numbers; each distinct vector counts once. Two passes over the
distinct vectors: exact sums by dimension, then the products of the centred vectors. A task adds
its vectors to one triangle, and the triangles are added entry by entry in a shuffle, so what
reaches the driver is one triangle, ``MOST_DIMENSIONS`` squared at most, whatever the input.

*Components.* Householder reflections make the covariance tridiagonal. A Sturm sequence counts
the eigenvalues below a point, so bisection finds the leading ones, each to the last bits. Inverse
iteration finds the vectors; those whose eigenvalues lie close together are made orthogonal to each
other in every round. The reflections, applied backwards, give the components.

*Projection.* Means and components go to every task, which projects batches of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.plans.shared import table

SCALE = 64
SHIFT = 1_000_000
#: Longer vectors raise: the covariance is held by the driver.
MOST_DIMENSIONS = 4096
#: A component whose eigenvalue is under this share of the largest has no variance to scale.
NO_VARIANCE = 1e-12
#: Eigenvalues closer than this share of the largest are a cluster.
CLOSE = 1e-3


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflections) of a symmetric matrix, by Householder reflections."""
    a = a.copy()
    reflections = []
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        size = np.sqrt(v @ v)
        v[0] += np.copysign(size, v[0])
        norm = np.sqrt(v @ v)
        if norm == 0:
            reflections.append(v)
            continue
        v /= norm
        block = a[k + 1 :, k + 1 :]
        p = 2 * (block @ v)
        q = p - (v @ p) * v
        block -= np.outer(v, q) + np.outer(q, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def count_below(d: np.ndarray, e: np.ndarray, points: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each point (a Sturm sequence)."""
    least = np.finfo(float).tiny * max(1.0, float((e**2).max(initial=0)))
    q = d[0] - points
    n = (q < 0).astype(np.int64)
    for i in range(1, len(d)):
        q = np.where(np.abs(q) < least, -least, q)
        q = d[i] - points - e[i - 1] ** 2 / q
        n += q < 0
    return n


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection on the Sturm count."""
    reach = np.abs(d) + np.abs(np.append(e, 0)) + np.abs(np.append(0, e))
    bound = float(reach.max(initial=0)) * (1 + 1e-12) + np.finfo(float).tiny
    low, high = np.full(k, -bound), np.full(k, bound)
    rank = len(d) - np.arange(k)  # the j-th largest is the least point with so many at or below it
    for _ in range(200):
        mid = (low + high) / 2
        if np.all((mid <= low) | (mid >= high)):
            break
        under = count_below(d, e, mid) >= rank
        high, low = np.where(under, mid, high), np.where(under, low, mid)
    return (low + high) / 2


def _eliminated(d: np.ndarray, e: np.ndarray, value: float, least: float):
    """The tridiagonal matrix less ``value``, factored with row exchanges: (rows, multipliers, exchanged)."""
    n = len(d)
    rows = np.zeros((n, 3))  # diagonal, first and second above it
    times, exchanged = np.zeros(n), np.zeros(n, dtype=bool)
    now = [d[0] - value, e[0] if n > 1 else 0.0, 0.0]
    for i in range(n - 1):
        below = [e[i], d[i + 1] - value, e[i + 1] if i + 2 < n else 0.0]
        if abs(below[0]) > abs(now[0]):
            exchanged[i] = True
            now, below = below, now
        if abs(now[0]) < least:
            now[0] = least
        rows[i] = now
        times[i] = below[0] / now[0]
        now = [below[1] - times[i] * now[1], below[2] - times[i] * now[2], 0.0]
    rows[n - 1] = [now[0] if abs(now[0]) >= least else least, 0, 0]
    return rows, times, exchanged


def _solved(factors, b: np.ndarray) -> np.ndarray:
    rows, times, exchanged = factors
    y, n = b.copy(), len(b)
    for i in range(n - 1):
        if exchanged[i]:
            y[i], y[i + 1] = y[i + 1], y[i]
        y[i + 1] -= times[i] * y[i]
    for i in range(n - 1, -1, -1):
        y[i] -= (rows[i, 1] * y[i + 1] if i + 1 < n else 0.0) + (rows[i, 2] * y[i + 2] if i + 2 < n else 0.0)
        y[i] /= rows[i, 0]
        if abs(y[i]) > 1e100:  # direction is all that counts
            y /= abs(y[i])
    return y


def leading_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Unit eigenvectors (columns) by inverse iteration; within a cluster each round ends orthogonal."""
    norm = float(np.abs(values).max(initial=0)) or 1.0
    least = np.finfo(float).eps * norm
    rng = np.random.default_rng(11)
    out = np.zeros((len(d), len(values)))
    first = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLOSE * norm:
            first = j
        # members of a cluster that are equal get slightly different shifts
        shift = value - (j - first) * least if j > first and values[j - 1] - value < 2 * least else value
        factors = _eliminated(d, e, shift, least)
        x = rng.uniform(-1, 1, len(d))
        for _ in range(rounds):
            x = _solved(factors, x / np.abs(x).max())
            x /= np.sqrt(x @ x)
            for _ in range(2):
                for i in range(first, j):
                    x -= (out[:, i] @ x) * out[:, i]
            x /= np.sqrt(x @ x)
        out[:, j] = x
    return out


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the ``k`` largest eigenvalues, falling."""
    d, e, reflections = tridiagonal(v)
    values = leading_values(d, e, min(k, len(d)))
    vectors = leading_vectors(d, e, values)
    for i in range(len(reflections) - 1, -1, -1):
        h = reflections[i]
        vectors[i + 1 :] -= 2 * np.outer(h, h @ vectors[i + 1 :])
    return values, vectors / np.sqrt((vectors**2).sum(axis=0))


@dataclass
class Whitening:
    """``scale`` has the components over the roots of their eigenvalues, one a column."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    scale: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return self.sums.astype(np.float64) / self.n


def whole(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that take part, their entries as whole numbers."""
    v = F.col("embedding")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.where(v.isNotNull() & fine & (F.size(v) > 0))
    return rows.select("vec_id", F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT).alias("x"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _added(rows: DataFrame, of, shape: str) -> np.ndarray:
    """The entry-wise sum over all rows of ``of(matrix of a batch)``, an upper triangle or a vector."""
    kind = "long" if shape == "vector" else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if len(b):
                part = of(_matrix(b.column("x")))
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(total)) if shape == "triangle" else (np.arange(len(total)), np.zeros(len(total), dtype=np.int64))
            v = total[i, j] if shape == "triangle" else total
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v)], ["i", "j", "v"])

    cells = rows.select("x").mapInArrow(run, f"i int, j int, v {kind}").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    if not len(cells):
        return np.zeros(0, dtype=np.int64)
    i, j, v = (cells[c].to_numpy() for c in ("i", "j", "v"))
    if shape == "vector":
        out = np.zeros(i.max() + 1, dtype=np.int64)
        out[i] = v
        return out
    out = np.zeros((i.max() + 1,) * 2)
    out[i, j] = v
    out[j, i] = v
    return out


def fit(rows: DataFrame, components: int = 16) -> Whitening | None:
    """Fit on the distinct vectors of ``rows(x)``; None where there are none.

    Components without variance are left out, so fewer than ``components`` may remain.
    """
    once = table(rows.select("x").distinct(), "distinct_vectors")
    sizes = once.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x"))).first()
    n, short, long = sizes
    if not n:
        return None
    if short != long or long > MOST_DIMENSIONS:
        raise ValueError(f"vectors have {short} to {long} dimensions; all need the same number, {MOST_DIMENSIONS} at most")
    sums = _added(once, lambda m: m.sum(axis=0), "vector")
    mean = sums.astype(np.float64) / n

    def products(m: np.ndarray) -> np.ndarray:
        c = m - mean
        return c.T @ c

    v = _added(once, products, "triangle") / n
    values, vectors = leading_components(v, components)
    keep = values > NO_VARIANCE * max(float(values[0]), np.finfo(float).tiny)
    values, vectors = values[keep], vectors[:, keep]
    trace = float(np.trace(v))
    fitted = Whitening(n, sums, values, vectors / np.sqrt(values), values / trace if trace else values)
    if len(values):

        def products_white(m: np.ndarray) -> np.ndarray:
            w = (m - mean) @ fitted.scale
            return w.T @ w

        fitted.identity_error = float(np.abs(_added(once, products_white, "triangle") / n - np.eye(len(values))).max())
    return fitted


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """Whiten ``vectors(vec_id, embedding, ...)``: one row for each vector that takes part and component.

    Other columns are ignored. Vectors that are null, empty, or hold null or non-finite entries take
    no part; vectors of different lengths raise. Repeated rows and equal vectors get equal rows,
    and count once in the fit; a null vec_id is kept. An empty table, and one whose vectors are all
    equal, gives an empty result. ``deviation`` is exact whatever its size, hence a decimal.

    Returns ``vec_id, component, n, deviation, whitened, explained, identity_error``.
    """
    rows = whole(vectors)
    fitted = fit(rows, components)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if fitted is None or not len(fitted.values):
        return vectors.sparkSession.createDataFrame([], schema)
    k, n, sums, mean = len(fitted.values), fitted.n, fitted.sums, fitted.mean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.slice(at, 1000)
                x = _matrix(part.column("x"))
                white = (x - mean) @ fitted.scale
                far = float(np.abs(x - mean).max()) * n
                if far * far * x.shape[1] < 2.0**62:
                    deviation = pa.array(((n * x - sums) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
                else:  # beyond 64 bits: Python's integers
                    exact = ((x.astype(object) * n - sums.astype(object)) ** 2).sum(axis=1)
                    deviation = pa.array([Decimal(t) for t in exact], pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(len(part)), k))
                rows_n = len(part) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))),
                        pa.array(np.full(rows_n, n, dtype=np.int64)),
                        deviation.take(each),
                        pa.array(white.ravel()),
                        pa.array(np.tile(fitted.explained, len(part))),
                        pa.array(np.full(rows_n, fitted.identity_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select(F.col("vec_id").cast("long"), "x").mapInArrow(run, schema)
