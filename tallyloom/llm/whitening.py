"""Whitening of embeddings by the leading components of their covariance.

1. Vectors become whole numbers on a grid; tasks sum them exactly, dimension by dimension.
2. Tasks centre the vectors and sum their products; the sums of a dimension's row meet by that dimension.
3. The covariance, one row per dimension, is reduced to tridiagonal form by Householder reflections; bisection on Sturm counts
   finds the leading eigenvalues, and inverse iteration, made orthogonal within clusters of eigenvalues, their vectors.
4. The projection, one vector per component, is broadcast, and tasks project the centred vectors.

What reaches the driver has as many numbers as the covariance, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import storage

COMPONENTS = 8
# The grid: a coordinate c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
# Coordinates from this on count as infinite: their place on the grid would be no exact double.
LARGEST = 2.0**40
_EPS = np.finfo(np.float64).eps


def usable(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(key, vector) of the rows that can be fitted, and their dimension: the one that most vectors have, else the larger."""
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST))
    rows = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & ~odd)
    most = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dimension = most["d"] if most else 0
    return rows.where(F.size("vector") == dimension), dimension


def grid(column: pa.Array, dimension: int) -> np.ndarray:
    """Vectors of an Arrow list column as rows of whole numbers."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
    return np.floor(SCALE * values).astype(np.int64) + SHIFT


@dataclass
class Centre:
    """Number of vectors and exact sums; the mean is kept as a whole part and a rest below ``n``."""

    n: int
    sums: list[int]

    def __post_init__(self) -> None:
        self.whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        self.rest = np.array([s % self.n for s in self.sums], dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of ``(n x - sum) ** 2``, exactly; None where it exceeds a long."""
        near = np.square(self.n * self.centred(x)).sum(axis=1)
        if not len(x) or near.max() < 2.0**62:
            return np.square(self.n * (x - self.whole) - self.rest).sum(axis=1).tolist()
        whole, rest = self.whole.tolist(), self.rest.tolist()
        out = [sum((self.n * (c - w) - r) ** 2 for c, w, r in zip(row, whole, rest)) for row in x.tolist()]
        return [s if s < 1 << 63 else None for s in out]


def centre(rows: DataFrame, dimension: int) -> Centre | None:
    """Count and sums of (key, vector); None without rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dimension, np.int64), np.zeros(dimension, np.int64)
        for batch in batches:
            x = grid(batch.column(0), dimension)
            n += len(x)
            # Halves, so that no sum overflows.
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        columns = [np.arange(dimension), np.full(dimension, n), high, low]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["i", "n", "high", "low"])

    parts = rows.select("vector").mapInArrow(work, "i long, n long, high long, low long")
    # One row per dimension.
    found = sorted(parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low"))).collect())
    if not found or not found[0]["n"]:
        return None
    return Centre(found[0]["n"], [(r["high"] << 32) + r["low"] for r in found])


def _products(rows: DataFrame, width: int, project) -> np.ndarray:
    """Sum of the outer products of the rows that ``project`` makes of a batch's vectors, in ``width`` rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            y = project(batch.column(0))
            total += y.T @ y
        columns = [pa.array(np.arange(width)), pa.array(total.tolist(), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["i", "row"])

    parts = rows.select("vector").mapInArrow(work, "i long, row array<double>")
    total = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row"))
    return np.array([r["row"] for r in sorted(total.collect())])


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of the tridiagonal matrix similar to symmetric ``a``, and the Householder vectors."""
    a = a.copy()
    size, mirrors = len(a), []
    for k in range(size - 2):
        v = a[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        if norm > 0:
            v[0] += np.copysign(norm, v[0])
            v /= np.linalg.norm(v)
            part = a[k + 1 :, k + 1 :]
            p = part @ v
            w = p - (v @ p) * v
            part -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1, k] = -np.copysign(norm, a[k + 1, k])
            a[k + 2 :, k] = 0
        mirrors.append(v if norm > 0 else np.zeros(size - k - 1))
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def _below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues are less than each of ``x``."""
    least = max(np.abs(off).max(initial=0.0) ** 2, 1.0) * np.finfo(np.float64).tiny
    q = diagonal[0] - x
    count = (q < 0).astype(np.int64)
    for d, e in zip(diagonal[1:], off):
        q = d - x - e * e / np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling, by bisection to the last bits."""
    size = len(diagonal)
    count = min(count, size)
    reach = np.abs(np.concatenate([[0], off])) + np.abs(np.concatenate([off, [0]]))
    bound = max(np.abs(diagonal).max(), (np.abs(diagonal) + reach).max()) * (1 + 4 * _EPS) + np.finfo(np.float64).tiny
    low, high = np.full(count, -bound), np.full(count, bound)
    # Of the size eigenvalues, size - k - 1 are less than the k-th from the top.
    rank = size - 1 - np.arange(count)
    for _ in range(200):
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high) | (high - low <= _EPS * np.abs(middle))).all():
            break
        less = _below(diagonal, off, middle) <= rank
        low, high = np.where(less, middle, low), np.where(less, high, middle)
    return (low + high) / 2


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges; pivots are at least ``least`` in size."""
    size = len(diagonal)
    main, up, second = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * size
    x = b.tolist()
    for k in range(size - 1):
        lower, below, above = off[k], main[k + 1], up[k + 1]
        if abs(lower) > abs(main[k]):
            f = main[k] / lower
            main[k], up[k], second[k], head = lower, below, above, up[k]
            main[k + 1], up[k + 1] = head - f * below, -f * above
            x[k], x[k + 1] = x[k + 1], x[k] - f * x[k + 1]
        else:
            if abs(main[k]) < least:
                main[k] = least
            f = lower / main[k]
            main[k + 1] = below - f * up[k]
            x[k + 1] -= f * x[k]
    if abs(main[-1]) < least:
        main[-1] = least
    for k in range(size - 1, -1, -1):
        s = x[k]
        if k + 1 < size:
            s -= up[k] * x[k + 1]
        if k + 2 < size:
            s -= second[k] * x[k + 2]
        x[k] = s / main[k]
    return np.array(x)


def eigen(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues of symmetric ``a``, falling, and their unit vectors as rows."""
    diagonal, off, mirrors = tridiagonal(a)
    values = leading(diagonal, off, count)
    scale = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0)) or 1.0
    draw = np.random.default_rng(1)
    vectors: list[np.ndarray] = []
    first = 0  # of the cluster
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * scale:
            first = k
        # Equal eigenvalues are told apart by a few last bits, so that every solution starts elsewhere.
        shift = value - 4 * _EPS * scale * (k - first)
        x = draw.standard_normal(len(diagonal))
        for _ in range(5):
            x = _solve(diagonal, off, shift, x / np.linalg.norm(x), _EPS * scale)
            for _ in range(2):
                for other in vectors[first:k]:
                    x -= (other @ x) * other
            x /= np.linalg.norm(x)
        vectors.append(x)
    out = np.array(vectors)
    for k in range(len(mirrors) - 1, -1, -1):
        v = mirrors[k]
        out[:, k + 1 :] -= 2 * np.outer(out[:, k + 1 :] @ v, v)
    for x in out:  # a direction has two signs; the largest entry is made positive
        x *= np.copysign(1.0, x[np.abs(x).argmax()])
    return values, out


@dataclass
class Whitening:
    """A fit: centre, components as rows with falling eigenvalues, and the trace of the covariance."""

    dimension: int
    centre: Centre
    values: np.ndarray
    components: np.ndarray
    trace: float

    def projection(self) -> np.ndarray:
        return (self.components / np.sqrt(self.values)[:, None]).T


def fit(rows: DataFrame, dimension: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of (key, vector); None without rows. Directions without variance (to rounding) are no components."""
    at = centre(rows, dimension) if dimension else None
    if at is None:
        return None
    covariance = _products(rows, dimension, lambda column: at.centred(grid(column, dimension))) / at.n
    values, vectors = eigen((covariance + covariance.T) / 2, components)
    real = values > 64 * dimension * _EPS * max(values.max(), 0.0)
    return Whitening(dimension, at, values[real], vectors[real], float(np.trace(covariance)))


def identity_error(rows: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity."""
    width = len(fitted.values)
    shared = rows.sparkSession.sparkContext.broadcast((fitted.centre, fitted.projection()))
    dimension = fitted.dimension

    def project(column: pa.Array) -> np.ndarray:
        at, projection = shared.value
        y = at.centred(grid(column, dimension)) @ projection
        return np.column_stack([y, np.ones(len(y))])  # with the sums, whose mean is zero to rounding

    total = _products(rows, width + 1, project) / fitted.centre.n
    mean = total[:width, width]
    return float(np.abs(total[:width, :width] - np.outer(mean, mean) - np.eye(width)).max())


def whiten(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained and identity_error of every usable row and component.

    Rows whose vector is NULL, empty, of another dimension than most, or holds NULL, NaN, infinite or astronomic
    entries (``LARGEST``) are left out. All other rows are fitted; repeated rows count as often as they occur and keep their own
    rows; a NULL key stays NULL. ``deviation`` is NULL where it exceeds a long. There are fewer components where the vectors
    vary in fewer directions, and no rows where all are equal or the table is empty. Further columns are ignored.
    """
    spark = vectors.sparkSession
    storage.prepare(spark)
    kind = vectors.schema[key].dataType.simpleString()
    rows, dimension = usable(vectors, key, vector)
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit(rows, dimension, components)
    if fitted is None or not len(fitted.values):
        return spark.createDataFrame([], schema)
    error, width, n = identity_error(rows, fitted), len(fitted.values), fitted.centre.n
    shared = spark.sparkContext.broadcast((fitted.centre, fitted.projection(), fitted.values / fitted.trace))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, projection, explained = shared.value
        for batch in batches:
            x = grid(batch.column(1), dimension)
            each = pa.array(np.repeat(np.arange(len(x)), width))
            columns = [
                batch.column(0).take(each),
                pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), n)),
                pa.array(at.deviations(x), pa.int64()).take(each),
                pa.array((at.centred(x) @ projection).ravel()),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(each), error)),
            ]
            names = ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = rows.mapInArrow(project, schema.replace(f"`{key}`", "key", 1))
    return out.withColumnRenamed("key", key)
