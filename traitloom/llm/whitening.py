"""Whitening of vectors: leading principal components by tridiagonal reduction.

Components become whole numbers, ``x = floor(256 * c)``.  The vectors to fit on
are the distinct ones.

1. Their number and their sums by dimension are exact (decimals of 38 digits).
2. The covariance is a sum over tasks: each task centres its vectors, exactly in
   whole numbers as ``n * x - S``, rounds once, and adds one product matrix.
3. The driver holds one matrix of dimensions x dimensions, whatever the number
   of rows: Householder reflections make it tridiagonal, bisection over Sturm
   counts gives the leading eigenvalues, inverse iteration their vectors, which
   are made orthogonal within clusters of close eigenvalues and then turned back.
4. The components are broadcast (dimensions x ``count`` numbers).  One pass over
   the distinct vectors measures how far the whitened covariance is from the
   identity, and one over all rows projects them.

Vectors that are null, empty, or hold null or non-finite components give no
rows; nor do vectors of another length than the commonest (of equally common
lengths, the smallest), as they have no covariance with the others.  Codes
beyond a long are held at its ends.  Repeated rows and rows without id give
rows.  A component without variance has null in ``whitened`` and 0 in
``explained``, and no part in ``identity_error``; without any variance
``explained`` is null, and ``identity_error`` is 0.  ``deviation`` is null where
it does not fit a long.  Other columns do no harm, and an empty table gives an
empty result.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import scratch
from .common import finite, narrowest, whole

#: Numbers that a step inside a task centres together.
STEP_CELLS = 1 << 20
#: Eigenvalues closer than this share of the largest are a cluster.
CLUSTER = 1e-3
MOST = (1 << 63) - 1


# -- eigenvalues and eigenvectors of a symmetric matrix ----------------------------


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, side diagonal and Householder vectors that make *v* tridiagonal."""
    a, reflectors = v.copy(), []
    for k in range(len(a) - 2):
        u = a[k + 1:, k].copy()
        scale = np.abs(u[1:]).max()
        if scale:
            u /= max(scale, abs(u[0]))
            u[0] += np.copysign(np.linalg.norm(u), u[0])
            u /= np.linalg.norm(u)
            rest = a[k + 1:, k + 1:]
            p = rest @ u
            q = p - (u @ p) * u
            rest -= 2 * (np.outer(u, q) + np.outer(q, u))
            a[k + 1:, k] -= 2 * u * (u @ a[k + 1:, k])
        reflectors.append(u if scale else np.zeros(len(a) - k - 1))
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def sturm_count(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each of *at*."""
    small = np.finfo(float).tiny / np.finfo(float).eps
    below, q = np.zeros(len(at), np.int64), np.ones(len(at))
    for i in range(len(d)):
        q = d[i] - at - (e[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < small, -small, q)
        below += q < 0
    return below


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, count: int) -> np.ndarray:
    """The largest eigenvalues, falling, by bisection down to neighbouring doubles."""
    side = np.concatenate([[0.0], np.abs(e), [0.0]])
    radius = side[:-1] + side[1:]
    lo, hi = np.full(count, (d - radius).min()), np.full(count, (d + radius).max())
    slack = np.finfo(float).eps * max(abs(lo[0]), abs(hi[0])) * 4
    lo, hi = lo - slack, hi + slack
    wanted = len(d) - 1 - np.arange(count)  # how many are smaller
    for _ in range(200):
        middle = (lo + hi) / 2
        if ((middle <= lo) | (middle >= hi)).all():
            break
        above = sturm_count(d, e, middle) > wanted  # the eigenvalue is below the middle
        hi, lo = np.where(above, middle, hi), np.where(above, lo, middle)
    return (lo + hi) / 2


def solve_shifted(d: np.ndarray, e: np.ndarray, at: float, b: np.ndarray) -> np.ndarray:
    """x with (T - at) x = b up to scale, by elimination with row exchanges; zero pivots become tiny."""
    n = len(d)
    tiny = np.finfo(float).eps * max(np.abs(d).max(), np.abs(e).max() if n > 1 else 0.0, np.finfo(float).tiny)
    diagonal, first, second, x = d - at, np.append(e, 0.0), np.zeros(n), b.copy()
    for i in range(n - 1):
        below, next_diagonal, next_first = e[i], diagonal[i + 1], first[i + 1]
        if abs(below) > abs(diagonal[i]):
            diagonal[i], below = below, diagonal[i]
            first[i], next_diagonal = next_diagonal, first[i]
            second[i], next_first = next_first, 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        pivot = diagonal[i] = diagonal[i] or tiny
        factor = below / pivot
        diagonal[i + 1] = next_diagonal - factor * first[i]
        first[i + 1] = next_first - factor * second[i]
        x[i + 1] -= factor * x[i]
    diagonal[n - 1] = diagonal[n - 1] or tiny
    for i in range(n - 1, -1, -1):
        x[i] = (x[i] - (first[i] * x[i + 1] if i + 1 < n else 0.0) - (second[i] * x[i + 2] if i + 2 < n else 0.0)) / diagonal[i]
        if abs(x[i]) > 1e150:
            x *= 1e-150
    return x


def components(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    count = min(count, len(v))
    size = np.abs(v).max() if len(v) else 0.0
    if not size:
        return np.zeros(count), np.eye(len(v))[:, :count]
    d, e, reflectors = tridiagonal(v / size)
    values = leading_eigenvalues(d, e, count)
    start = np.random.default_rng(12)
    vectors: list[np.ndarray] = []
    for k in range(count):
        cluster = [j for j in range(k) if values[j] - values[k] <= CLUSTER * max(abs(values[0]), abs(values[-1]))]
        x = start.normal(size=len(d))
        for _ in range(4):
            x = solve_shifted(d, e, values[k], x)
            x /= np.abs(x).max()
            for _ in range(2):  # twice is enough to be orthogonal
                for j in cluster:
                    x -= (vectors[j] @ x) * vectors[j]
            x /= np.linalg.norm(x)
        vectors.append(x)
    back = np.array(vectors).T
    for k in range(len(reflectors) - 1, -1, -1):
        u = reflectors[k]
        back[k + 1:] -= 2 * np.outer(u, u @ back[k + 1:])
    return values * size, back / np.linalg.norm(back, axis=0)


# -- passes over the vectors ---------------------------------------------------------


def matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows and their codes, in steps of bounded size."""
    rows = max(1, STEP_CELLS // dim)
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part, np.array(part.column("codes").flatten()).reshape(-1, dim).astype(np.int64)


def from_sums(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S`` as whole numbers."""
    most = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    fits = n * most + max(map(abs, sums), default=0) <= MOST
    return x * n - np.array(sums, np.int64) if fits else x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - S / n``, rounded once."""
    return from_sums(x, n, sums).astype(np.float64) / n


def whiten(rows: DataFrame, count: int = 4, scale: int = 256) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row of ``vec_id, embedding``."""
    spark = rows.sparkSession
    fit = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fit = fit.where(finite("embedding") & (F.size("embedding") > 0)).select("vec_id", whole("embedding", scale).alias("codes"))
    common = fit.groupBy(F.size("codes").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = common["dim"] if common else 1
    fit = narrowest(fit.where(F.size("codes") == dim), "codes")
    path = scratch(spark, "distinct-vectors")
    fit.select("codes").distinct().write.parquet(path)
    distinct = spark.read.parquet(path)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for _, x in matrices(batches, dim):
            total = x.sum(axis=0) if np.abs(x.astype(float)).max(initial=0) * len(x) < MOST / 2 else x.astype(object).sum(axis=0)
            n, sums = n + len(x), [a + int(b) for a, b in zip(sums, total)]
        yield pa.RecordBatch.from_arrays([
            pa.array(range(dim), pa.int32()), pa.array([decimal.Decimal(s) for s in sums], pa.decimal128(38, 0)), pa.array([n] * dim, pa.int64())], ["i", "s", "n"])

    totals = distinct.mapInArrow(added, "i int, s decimal(38,0), n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    n, sums = (totals[0].n if totals else 0), [int(r.s) for r in totals]

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = np.zeros((dim, dim))
        for _, x in matrices(batches, dim):
            c = centred(x, n, sums)
            v += c.T @ c
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v[i, j])], ["i", "j", "v"])

    covariance = np.zeros((dim, dim))
    if n:
        for r in distinct.mapInArrow(multiplied, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            covariance[r.i, r.j] = covariance[r.j, r.i] = r.v / n
    values, vectors = components(covariance, count)
    trace = float(np.trace(covariance))
    real = values > trace * dim * np.finfo(float).eps
    explained = [float(max(e, 0.0) / trace) if trace else None for e in np.where(real, values, 0.0)]
    # no larger than dimensions x count numbers, whatever the number of rows
    shared = spark.sparkContext.broadcast(vectors / np.sqrt(np.where(real, values, 1.0)))

    def correlated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        first, second = np.zeros(k), np.zeros((k, k))
        for _, x in matrices(batches, dim):
            w = centred(x, n, sums) @ shared.value
            first += w.sum(axis=0)
            second += w.T @ w
        i, j = np.indices((k, k)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(first[i]), pa.array(second[i, j])], ["i", "j", "s", "v"])

    identity_error = 0.0
    if n and real.any():
        got = distinct.mapInArrow(correlated, "i int, j int, s double, v double").groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("v").alias("v")).collect()
        mean = {r.i: r.s / n for r in got}
        identity_error = max(abs(r.v / n - mean[r.i] * mean[r.j] - (r.i == r.j)) for r in got if real[r.i] and real[r.j])

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for batch, x in matrices(batches, dim):
            from_mean = from_sums(x, n, sums)
            w = np.where(real, (from_mean.astype(np.float64) / n) @ shared.value, np.nan)
            size = float(np.abs(from_mean).max(initial=0)) ** 2 * dim
            if size < MOST / 2:
                deviation = (from_mean.astype(np.int64) ** 2).sum(axis=1).tolist()
            else:
                deviation = [d if d <= MOST else None for d in (from_mean.astype(object) ** 2).sum(axis=1).tolist()]
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array([d for d in deviation for _ in range(k)], pa.int64()), pa.array(w.ravel(), mask=np.tile(~real, m)),
                pa.array(explained * m, pa.float64())], ["vec_id", "component", "deviation", "whitened", "explained"])

    out = fit.mapInArrow(projected, "vec_id long, component int, deviation long, whitened double, explained double")
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(float(identity_error)).alias("identity_error"))
