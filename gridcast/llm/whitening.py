"""Embedding whitening with the covariance recovered by polarisation.

Every component ``c`` of a vector becomes the integer ``x = floor(64 c) +
1000000``.  Three passes over the vectors, each added up task by task:

1. how many there are, and the sum of ``x`` in every dimension;
2. with ``y = x - floor(mean)`` the sums of ``y_i``, ``y_i^2`` and of
   ``(y_i + y_j)^2`` for every dimension and every pair of dimensions.  They are
   exact integers, so are the variances of each dimension and each pair sum,
   and ``cov(i, j) = (var(i + j) - var(i) - var(j)) / 2`` loses nothing.  The
   matrix that ``eigh`` gets is rounded once, at the end;
3. the covariance of the whitened vectors themselves, centred, for the largest
   departure from the identity.

A task hands on one row of bounded size (a number per pair of dimensions).
They are added by a few tasks before the driver reads what is left, so what
travels depends on the dimensions, not on the vectors.

Defined results: rows whose vector is null, empty, holds a null or non-finite
entry, or one whose ``x`` exceeds ``2^50`` (no sum of such is a long) are
dropped; shorter vectors count as padded with entries of zero; every row is a
vector of its own, also where ids repeat or are null; a deviation that does not
fit a long is null; a component along which the vectors do not vary (its
eigenvalue is zero to rounding) has no whitened value (null) and no part in the
identity error; ``explained`` is null if nothing varies; no vectors give no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, shuffle_parts

COMPONENTS = 32
SCALE = 64
SHIFT = 1_000_000

_LARGEST = 2.0 ** 50
_HALF = 26  # bits of the lower part of a number that is squared
_SCHEMA = ("vec_id {id}, component int, n long, deviation long, whitened double, explained double, "
           "identity_error double")


def valid(vec: Column, scale: int = SCALE) -> Column:
    """Whether a vector takes part."""
    fits = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < _LARGEST - SHIFT))
    return F.coalesce((F.size(vec) > 0) & fits, F.lit(False))


def integers(column: pa.Array, dim: int, scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    """A batch of vectors as integers, a row each, padded to ``dim``."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dim).all():
        dense = values.reshape(-1, dim)
    else:
        dense = np.zeros((len(lengths), dim))
        dense[np.arange(dim)[None, :] < lengths[:, None]] = values
    return np.floor(dense * scale).astype(np.int64) + shift


def pair_sums(y: np.ndarray) -> list[int]:
    """Sums of ``y_i`` and, for i <= j, of ``y_i^2`` (i = j) or ``(y_i +
    y_j)^2``, as exact integers, over the rows of one batch."""
    out = [int(v) for v in y.sum(axis=0)]
    for i in range(y.shape[1]):
        s = y[:, i:] + y[:, i:i + 1]
        s[:, 0] = y[:, i]
        high, low = s >> _HALF, s & ((1 << _HALF) - 1)  # high parts stay under 2^26: no sum of a batch overflows
        parts = ((high * high).sum(axis=0), (high * low).sum(axis=0), (low * low).sum(axis=0))
        out += [(int(a) << 2 * _HALF) + (int(b) << _HALF + 1) + int(c) for a, b, c in zip(*parts, strict=True)]
    return out


def covariance(n: int, sums: list[int], dim: int) -> np.ndarray:
    """The covariance matrix (divisor ``n``) out of :func:`pair_sums`."""
    first, squares = sums[:dim], iter(sums[dim:])
    var, mixed = [0] * dim, {}
    for i in range(dim):
        var[i] = n * next(squares) - first[i] ** 2  # n^2 times the variance
        for j in range(i + 1, dim):
            mixed[i, j] = n * next(squares) - (first[i] + first[j]) ** 2
    out = np.diag([v / n ** 2 for v in var]).astype(float)
    for (i, j), v in mixed.items():
        out[i, j] = out[j, i] = (v - var[i] - var[j]) / (2 * n ** 2)
    return out


def merge_moments(a, b):
    """Two (count, mean, centred products) as one."""
    if a is None or b is None:
        return b if a is None else a
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def _add(a, b):
    return (b if a is None else a) if a is None or b is None else [x + y for x, y in zip(a, b, strict=True)]


def summed(df: DataFrame, of_batch: Callable[[pa.RecordBatch], object], add: Callable):
    """``of_batch`` of all batches of ``df``, added up with ``add`` inside the
    tasks, then by the square root of the shuffle's partitions, then here."""
    def rows(totals: Iterable) -> Iterator[pa.RecordBatch]:
        total = None
        for t in totals:
            total = add(total, t)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["part"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return rows(of_batch(b) for b in batches if b.num_rows)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return rows(pickle.loads(p) for b in batches for p in b.column(0).to_pylist())

    bounded_batches(df.sparkSession)
    few = math.isqrt(shuffle_parts(df.sparkSession)) + 1
    parts = df.mapInArrow(first, "part binary").repartition(few).mapInArrow(again, "part binary")
    total = None
    for r in parts.collect():  # a row of each of few tasks
        total = add(total, pickle.loads(r["part"]))
    return total


def _deviations(y: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of ``(n y - sums)^2`` of each row, exact."""
    rough = ((n * y.astype(float) - sums.astype(float)) ** 2).sum(axis=1)
    out: list[int | None] = []
    small = rough < 4e18
    exact = np.zeros(len(y), np.int64)
    exact[small] = ((n * y[small] - sums.astype(np.int64)) ** 2).sum(axis=1) if small.any() else 0
    for ok, v, row in zip(small, exact, y, strict=True):
        if ok:
            out.append(int(v))
            continue
        whole = sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True))
        out.append(whole if whole < 1 << 63 else None)
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding",
           scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained,
    identity_error`` for every vector and its first ``components``."""
    spark = vectors.sparkSession
    rows = (vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
            .where(valid(F.col("vec"), scale)))
    schema = _SCHEMA.format(id=dict(rows.dtypes)["vec_id"])
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    n, dim = size["n"], size["dim"]
    if not n:
        return spark.createDataFrame([], schema)
    slim = rows.select("vec")
    total = summed(slim, lambda b: [int(v) for v in integers(b.column(0), dim, scale, shift).sum(axis=0)], _add)
    centre = np.array([v // n for v in total], np.int64)
    sums = summed(slim, lambda b: pair_sums(integers(b.column(0), dim, scale, shift) - centre), _add)
    v = covariance(n, sums, dim)
    values, axes = np.linalg.eigh(v)
    keep = min(components, dim)
    values, axes = values[::-1][:keep], np.ascontiguousarray(axes[:, ::-1][:, :keep])
    trace = float(np.trace(v))
    varies = values > max(float(values[0]), 0.0) * dim * np.finfo(float).eps
    first = np.array(sums[:dim], object)
    mean = np.array([s / n for s in sums[:dim]])
    root = np.sqrt(np.where(varies, values, 1.0))

    def project(y: np.ndarray) -> np.ndarray:
        return ((y - mean) @ axes) / root

    def moments(b: pa.RecordBatch):
        w = project(integers(b.column(0), dim, scale, shift) - centre)
        m = w.mean(axis=0)
        return len(w), m, (w - m).T @ (w - m)

    count, _, products = summed(slim, moments, merge_moments)
    error = np.abs(products / count - np.eye(keep))[np.ix_(varies, varies)]
    error = float(error.max()) if error.size else None
    explained = [float(x) / trace if trace > 0 else None for x in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            y = integers(b.column(1), dim, scale, shift) - centre
            w = project(y).ravel()
            at = pa.array(np.repeat(np.arange(m), keep))
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(at), pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), m)),
                pa.array(np.full(m * keep, n)), pa.array(_deviations(y, n, first), pa.int64()).take(at),
                pa.array(w, mask=np.tile(~varies, m)), pa.array(explained * m, pa.float64()),
                pa.array([error] * (m * keep), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
