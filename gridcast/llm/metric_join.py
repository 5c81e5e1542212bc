"""Embedding near-duplicates by an exact metric range join.

Unit vectors with cosine ``t`` or more lie within ``eps = sqrt(2 - 2 t)`` of
each other.  Pivots from a bounded sample partition the vectors: each belongs
to the cell of its nearest pivot.  A vector ``x`` of cell ``h`` and a vector
``y`` of cell ``c`` can only link if the triangle inequality allows it:

* ``(d(x,c)^2 - d(x,h)^2) / (2 d(c,h)) + (d(y,h)^2 - d(y,c)^2) / (2 d(c,h))
  <= eps`` (their distances to the plane between the two pivots, each from its
  own side), and
* ``r_min(c) - eps <= d(x,c) <= r_max(c) + eps`` (the cell's radii), and the
  same for ``y`` and ``h``.

The vectors lie in tiles of about ``TILE_BYTES``, sorted by cell and written
once; a pair of tiles is read by the one task that compares it, unless no cell
of one can be reached from the other.  So disk is in proportion to the rows,
however many cells border each other, and a dense cell is many pairs of tiles.
Of two cells the vectors near the plane are sorted by their distance to it and
compared in blocks as far as the sum of both distances allows.  Some principal
components and the length of the rest bound a cosine from above; the pairs
that this leaves get the whole product.

The dot products of unit vectors in single precision only propose;
each proposal near the threshold is decided in double precision.

Equal vectors are one representative with a count, so a common vector costs
one row.  A pair of tiles yields per vector its number of links and a star per
linked group: counts and components stay whole without listing a dense group's
pairs.

The number of pivots comes from the sample: the one for which compared pairs
and planes cost least.  It changes the cost only.  Where vectors have no
clusters, pivots separate only a part of the pairs in high dimension (3 % are
left by 1024 pivots in 64 dimensions), so work still grows with the square of
the rows, in bounded tasks.

Defined results: a vector that is null, empty, zero, or has a null or
non-finite component links with nothing; shorter vectors count as padded with
zeros; every row is a vector of its own, also where ids repeat; a null id is
its own component unless it is linked; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .components import components
from .hmm import let_go

THRESHOLD = 0.95
#: Vectors sampled to choose pivots, and the most pivots.
SAMPLE = 8000
MAX_PIVOTS = 2048
#: Vectors that one product compares, with a quarter of as many others.
BLOCK = 1024
#: Of a tile, two of which a task holds.
TILE_BYTES = 16 << 20
#: Principal components, an eighth of all at least, that bound a cosine.
AXES = 24
#: Cells whose planes are looked at together.
PLANES = 32

_SLACK = 1e-4   # of distances, for single precision
_RADIUS = 3e-3  # of distances near zero, taken from single-precision cosines
_SINGLE = 1e-4  # of single-precision cosines


def choose_pivots(sample: np.ndarray, n: int, eps: float) -> np.ndarray:
    """Farthest-first pivots of a sample of unit vectors; as many as make
    comparing ``n`` vectors cheapest."""
    m, dim = sample.shape
    order, near = [0], np.full(m, np.inf)
    for _ in range(min(MAX_PIVOTS, m, math.isqrt(n) + 1) - 1):
        near = np.minimum(near, 2 - 2 * sample @ sample[order[-1]])
        nxt = int(near.argmax())
        if near[nxt] <= 1e-12:
            break
        order.append(nxt)
    best, cost = order[:1], None
    p = 1
    while p <= len(order):
        pivots = sample[order[:p]]
        rest = np.setdiff1d(np.arange(m), order[:p])[:1000]  # a pivot lies nearer to its pivot than others do
        cos = sample[rest if len(rest) else np.arange(min(m, 1000))] @ pivots.T
        home = cos.argmax(axis=1)
        own = cos[np.arange(len(home)), home]
        apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
        over = own[:, None] - cos[:, home]
        met = (over + over.T <= eps * apart[np.ix_(home, home)] + _SLACK).mean()
        # nanoseconds: pairs that meet, a vector at a plane, a pair of cells
        price = n * n / 2 * met * (0.6 + dim * 0.02) + n * p * (60 + dim * 0.6) + p * p / 2 * 2e5
        if cost is None or price < cost:
            best, cost = order[:p], price
        p *= 2
    return sample[best]


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows as double-precision unit vectors."""
    out = rows.astype(np.float64)
    out /= np.abs(out).max(axis=1)[:, None]
    return out / np.sqrt((out * out).sum(axis=1))[:, None]


def _unit32(rows: np.ndarray) -> np.ndarray:
    """Rows as single-precision unit vectors."""
    out = (rows / np.abs(rows).max(axis=1)[:, None]).astype(np.float32, copy=False)
    out /= np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]
    return out


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """A list column without nulls, padded to ``dim`` with zeros."""
    flat, sizes = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), flat.dtype)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """The bytes of each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    at = np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(rows)])


def _chain(pivots: np.ndarray) -> np.ndarray:
    """Pivots in an order in which near ones follow each other, so that near
    cells share tiles."""
    cos = pivots @ pivots.T
    order, free = [0], np.ones(len(pivots), bool)
    while len(order) < len(pivots):
        free[order[-1]] = False
        order.append(int(np.where(free, cos[order[-1]], -np.inf).argmax()))
    return pivots[order]


def _roots(parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    at = parent[nodes]
    while True:
        up = parent[at]
        if (up == at).all():
            parent[nodes] = at
            return at
        at = up


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hang the groups of ``a`` and ``b`` (links) under their smallest node."""
    while True:
        a, b = _roots(parent, a), _roots(parent, b)
        apart = a != b
        if not apart.any():
            return
        a, b = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
        np.minimum.at(parent, a, b)


@contextmanager
def _batches(spark: SparkSession, rows: int):
    """Arrow batches of so many rows at most, for what runs meanwhile."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key, None)
    spark.conf.set(key, str(max(1, rows)))
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


class _Planes:
    """Pivots, and what bounds a pair of vectors; one a task."""

    def __init__(self, pivots: np.ndarray, axes: np.ndarray, threshold: float):
        self.threshold, self.eps = threshold, float(np.sqrt(max(0.0, 2 - 2 * threshold)))
        self.pivots, self.axes, self.exact = pivots.astype(np.float32), axes.astype(np.float32), pivots

    def room(self, cells: np.ndarray, others: np.ndarray | slice) -> np.ndarray:
        """What the distances to the plane may sum to, times the pivots'."""
        apart = np.sqrt(np.maximum(0, 2 - 2 * self.exact[cells] @ self.exact[others].T))
        return ((self.eps + _SLACK) * apart + _SLACK).astype(np.float32)

    def reach(self, unit: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Cells that a vector of these may link into."""
        out = np.zeros(len(self.pivots), bool)
        for c in np.unique(cell):
            at, room = np.flatnonzero(cell == c), self.room(np.array([c]), slice(None))[0]
            for x in range(0, len(at), BLOCK):
                cos = unit[at[x:x + BLOCK]] @ self.pivots.T
                out |= (cos[:, c, None] - cos).min(axis=0) <= room
            out[c] = True
        return np.flatnonzero(out)


class _Tile:
    """Vectors sorted by cell."""

    def __init__(self, planes: _Planes, no: int, cells: np.ndarray, counts: np.ndarray, m: np.ndarray, rows: np.ndarray):
        self.no, self.cells, self.m, self.rows = no, cells, m, rows
        self.edge = np.concatenate([[0], np.cumsum(counts)])
        self.unit = _unit32(rows)
        part = self.unit @ planes.axes
        rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", part, part)) + np.float32(1e-6))
        self.bound = np.concatenate([part, rest[:, None]], axis=1)  # products of these are cosines or more
        self.own = np.empty(len(rows), np.float32)
        self.low, self.high = np.empty(len(cells)), np.empty(len(cells))
        for k, c in enumerate(cells):
            at = slice(self.edge[k], self.edge[k + 1])
            self.own[at] = self.unit[at] @ planes.pivots[c]
            far, near = float(self.own[at].min()), float(self.own[at].max())
            self.low[k], self.high[k] = math.sqrt(max(0.0, 2 - 2 * near)), math.sqrt(max(0.0, 2 - 2 * far))


class _Links:
    """Links between two tiles, or within one."""

    def __init__(self, planes: _Planes, a: _Tile, b: _Tile):
        self.planes, self.a, self.b, self.one = planes, a, b, a.no == b.no
        self.shift = 0 if self.one else len(a.rows)
        size = len(a.rows) + (0 if self.one else len(b.rows))
        self.count, self.parent = np.zeros(size, np.int64), np.arange(size)
        if self.one:
            self.b = a
        self.step = max(1, BLOCK // 4)
        self.product, self.over = np.empty(BLOCK * self.step, np.float32), np.empty(BLOCK * self.step + 64, bool)
        self._cells()

    def _cells(self) -> None:
        a, b, pivots = self.a, self.b, self.planes.pivots
        for x in range(0, len(a.cells), PLANES):
            mine = range(x, min(x + PLANES, len(a.cells)))
            for y in range(x if self.one else 0, len(b.cells), PLANES):
                yours = range(y, min(y + PLANES, len(b.cells)))
                at, bt = a.edge[mine[0]], b.edge[yours[0]]
                # negative cosines of a's vectors with b's pivots, and of b's with a's
                to_b = -(pivots[b.cells[yours]] @ a.unit[at:a.edge[mine[-1] + 1]].T)
                to_a = -(pivots[a.cells[mine]] @ b.unit[bt:b.edge[yours[-1] + 1]].T)
                room = self.planes.room(a.cells[mine], b.cells[yours])
                for i in mine:
                    for j in yours:
                        if a.cells[i] != b.cells[j]:
                            if not self.one or j > i:
                                self._pair(i, j, room[i - x, j - y], to_b[j - y, a.edge[i] - at:a.edge[i + 1] - at],
                                           to_a[i - x, b.edge[j] - bt:b.edge[j + 1] - bt])
                        else:
                            rows, others = np.arange(a.edge[i], a.edge[i + 1]), np.arange(b.edge[j], b.edge[j + 1])
                            self._sweep(rows, None, others, None)

    def _pair(self, i: int, j: int, room: np.float32, to_b: np.ndarray, to_a: np.ndarray) -> None:
        """Vectors of two cells that may link by their distances to the plane
        between them and by the cells' radii."""
        a, b, eps = self.a, self.b, self.planes.eps + _RADIUS
        over_a, over_b = to_b + a.own[a.edge[i]:a.edge[i + 1]], to_a + b.own[b.edge[j]:b.edge[j + 1]]

        def near(over, other, cos, low, high):
            return np.flatnonzero((over <= room - other) & (cos <= np.float32((high + eps) ** 2 / 2 - 1 + _SLACK))
                                  & (cos >= np.float32(max(0.0, low - eps) ** 2 / 2 - 1 - _SLACK)))

        rows = near(over_a, over_b.min(), to_b, b.low[j], b.high[j])
        if not len(rows):
            return
        over_a = over_a[rows]
        others = near(over_b, over_a.min(), to_a, a.low[i], a.high[i])
        if not len(others):
            return
        # 255 steps make up the room; two vectors of more steps together do not link
        sides = []
        for at, over in ((rows + a.edge[i], over_a), (others + b.edge[j], over_b[others])):
            steps = np.clip(over * (255 / room), 0, 255).astype(np.uint8)
            order = np.argsort(steps, kind="stable")
            sides += [at[order], steps[order]]
        self._sweep(*sides)

    def _sweep(self, rows, steps_a, others, steps_b) -> None:
        """Compare in blocks as far as the distances to the plane allow."""
        if steps_a is None:  # one cell
            left, right = self.a.bound[rows[0]:rows[-1] + 1], self.b.bound[others[0]:others[-1] + 1]
        else:
            left, right = self.a.bound.take(rows, axis=0), self.b.bound.take(others, axis=0)
        step = self.step
        for y in range(0, len(others), step):
            end = len(rows)
            if steps_a is not None:
                end = int(np.searchsorted(steps_a, 255 - steps_b[y], "right"))
            elif self.one:
                end = min(end, y + step)
            if not end:
                break
            for x in range(0, end, BLOCK):
                stop = min(end, x + BLOCK)
                self._block(rows[x:stop], others[y:y + step], left[x:stop], right[y:y + step])

    def _block(self, rows, others, left, right) -> None:
        low = self.planes.threshold - _SINGLE
        size = len(rows) * len(others)
        bound = np.matmul(left, right.T, out=self.product[:size].reshape(len(rows), len(others)))
        np.greater_equal(bound, np.float32(low), out=self.over[:size].reshape(bound.shape))
        # few are true: found by words of 8, then 64
        self.over[size:size + 64] = False
        flags = self.over[:size + -size % 64]
        some = np.flatnonzero((flags.view(np.uint64) != 0).view(np.uint64))
        if not len(some):
            return
        if np.count_nonzero(flags) * 16 > size:
            return self._dense(rows, others)
        may, bit = np.nonzero(flags.reshape(-1, 64)[some])
        may = some[may] * 64 + bit
        i, j = np.divmod(may, len(others))
        i, j = rows[i], others[j]
        cos = np.einsum("ij,ij->i", self.a.unit[i], self.b.unit[j])
        yes = cos >= low
        if self.one:  # rows of a later cell come later
            yes &= i < j
        i, j, cos = i[yes], j[yes], cos[yes]
        yes = self._decided(i, j, cos)
        i, j = i[yes], j[yes]
        if len(i):
            np.add.at(self.count, i, self.b.m[j])
            np.add.at(self.count, j + self.shift, self.a.m[i])
            _union(self.parent, i, j + self.shift)

    def _decided(self, i, j, cos) -> np.ndarray:
        """Which proposed pairs link; near the threshold in double precision."""
        yes = cos >= self.planes.threshold
        at = np.flatnonzero(np.abs(cos - self.planes.threshold) < 2 * _SINGLE)
        if len(at):
            yes[at] = np.einsum("ij,ij->i", _unit(self.a.rows[i[at]]), _unit(self.b.rows[j[at]])) >= self.planes.threshold
        return yes

    def _dense(self, rows, others) -> None:
        """Links of a block with many, as a matrix."""
        cos = self.a.unit[rows] @ self.b.unit[others].T
        yes = cos >= self.planes.threshold
        at = np.flatnonzero((cos >= self.planes.threshold - 2 * _SINGLE) != (cos >= self.planes.threshold + 2 * _SINGLE))
        i, j = np.divmod(at, len(others))
        yes[i, j] = self._decided(rows[i], others[j], cos[i, j])
        if self.one:
            yes &= rows[:, None] < others
        each = yes.astype(np.float64)  # sums below 2 ** 53 are exact
        self.count[rows] += (each @ self.b.m[others]).astype(np.int64)
        self.count[others + self.shift] += (self.a.m[rows] @ each).astype(np.int64)
        met = np.concatenate([rows[yes.any(axis=1)], others[yes.any(axis=0)] + self.shift])
        if len(met) and np.ptp(_roots(self.parent, met)):  # not yet one group
            i, j = np.nonzero(yes)
            _union(self.parent, rows[i], others[j] + self.shift)

    def rows(self) -> pa.RecordBatch | None:
        met = np.flatnonzero(self.count)
        if not len(met):
            return None
        ids = np.concatenate([_ids(self.a.no, len(self.a.rows)), _ids(self.b.no, len(self.b.rows))][:1 if self.one else 2])
        root = _roots(self.parent, met)
        hung = met != root
        u = np.concatenate([ids[met], ids[met[hung]]])
        v, none = np.concatenate([np.zeros(len(met), np.int64), ids[root[hung]]]), np.arange(len(u)) < len(met)
        links = np.concatenate([self.count[met], np.zeros(hung.sum(), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v, mask=none), pa.array(links, mask=~none)],
                                          names=["u", "v", "links"])


def _ids(no: int, n: int) -> np.ndarray:
    return (np.int64(no) << 22) + np.arange(n, dtype=np.int64)


_TILE = "no long, cells array<int>, counts array<int>, reach array<int>, m binary, vecs binary, h1 binary, h2 binary, lows array<long>"


def make_tiles(reps: DataFrame, shared, kind: str, n: int, dim: int) -> DataFrame:
    """``h1, h2, m, low, vec`` (distinct vectors with counts) as rows of
    ``_TILE``, written once."""
    spark, dtype = reps.sparkSession, np.dtype(kind)
    width = dim * dtype.itemsize
    most = max(1, min(TILE_BYTES // (width + 40), 1 << 20))
    tiles = max(math.ceil(1.05 * n / most),
                min(math.ceil(n / BLOCK), math.ceil(math.sqrt(4 * spark.sparkContext.defaultParallelism))))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value[0].astype(np.float32)
        for b in batches:
            if b.num_rows:
                rows = _matrix(b.column(4), dim)
                home = (_unit32(rows) @ pivots.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), *(b.column(k) for k in range(4)), _binary(rows)],
                                                 names=["cell", "h1", "h2", "m", "low", "vec"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, no, held, size = _Planes(*shared.value), TaskContext.get().partitionId() << 10, [], 0

        def tile() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            cell = t.column(0).to_numpy()
            order = np.argsort(cell, kind="stable")
            whole = t.column(5).buffers()[2]
            rows = np.frombuffer(whole, dtype, count=len(cell) * dim).reshape(-1, dim)[order]
            cells, counts = np.unique(cell, return_counts=True)
            h1, h2, m = (t.column(k).to_numpy()[order].tobytes() for k in (1, 2, 3))
            return pa.RecordBatch.from_arrays(
                [pa.array([no], pa.int64()), *(pa.array([x], pa.list_(pa.int32())) for x in
                                               (cells, counts, planes.reach(_unit32(rows), cell[order]))),
                 *(pa.array([x], pa.binary()) for x in (m, rows.tobytes(), h1, h2)),
                 pa.ListArray.from_arrays(pa.array([0, len(cell)], pa.int32()), t.column(4).take(pa.array(order)))],
                names=[f.split()[0] for f in _TILE.split(", ")])

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= 1.5 * most:  # seldom: n and ranges are estimates
                yield tile()
                no, held, size = no + 1, [], 0
        if size:
            yield tile()

    with _batches(spark, min(10_000, (4 << 20) // width)):
        return materialize(reps.select("h1", "h2", "m", "low", "vec")
                           .mapInArrow(homes, "cell int, h1 long, h2 long, m long, low long, vec binary")
                           .repartitionByRange(tiles, "cell", "h1").coalesce(tiles).mapInArrow(pack, _TILE))


def links_and_counts(tiles: DataFrame, shared, kind: str, dim: int) -> DataFrame:
    """Rows ``u, v, links`` of the vectors of all tiles; either ``v`` is set
    and u, v are in one component, or ``links`` vectors link with u."""
    spark = tiles.sparkSession
    sides = [tiles.select(*(F.col(c).alias(c + side) for c in ("no", "cells", "counts", "reach", "m", "vecs"))) for side in "ab"]
    # tiles that a task reads from either side: of many, it reads each less often
    parts, tasks = tiles.rdd.getNumPartitions(), 16 * spark.sparkContext.defaultParallelism
    right = max(1, min(4, int(parts / math.sqrt(tasks))))
    left = max(1, min(16, parts * parts // (tasks * right)))
    sides = [sides[0].coalesce(math.ceil(parts / left)), sides[1].coalesce(math.ceil(parts / right))]
    # of two tiles one, by a fixed rule, meets the other
    meets = ((F.col("noa") == F.col("nob")) | ((F.col("noa") < F.col("nob")) == (
        (F.shiftright("noa", 10) + F.shiftright("nob", 10)) % 2 == 1)))
    pairs = sides[0].hint("shuffle_replicate_nl").join(sides[1].hint("shuffle_replicate_nl"), meets & F.arrays_overlap(
        "reacha", "cellsb") & F.arrays_overlap("reachb", "cellsa"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, held = _Planes(*shared.value), {}

        def tile(b: pa.RecordBatch, row: int, side: int) -> _Tile:
            no, cells, counts, m, rows = (b.column(5 * side + k)[row] for k in range(5))
            if no.as_py() not in held:
                held[no.as_py()] = _Tile(planes, no.as_py(), cells.values.to_numpy(), counts.values.to_numpy(),
                                         np.frombuffer(m.as_buffer(), np.int64),
                                         np.frombuffer(rows.as_buffer(), kind).reshape(-1, dim))
            return held[no.as_py()]

        for b in batches:
            for row in range(b.num_rows):
                nos = {b.column(0)[row].as_py(), b.column(5)[row].as_py()}
                for no in held.keys() - nos:
                    del held[no]
                out = _Links(planes, tile(b, row, 0), tile(b, row, 1)).rows()
                if out is not None:
                    yield out

    with _batches(spark, 1):
        return materialize(pairs.select(*(c + side for side in "ab" for c in ("no", "cells", "counts", "m", "vecs")))
                           .mapInArrow(join, "u long, v long, links long"))


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in range(b.num_rows):
            h1, h2, m = (np.frombuffer(b.column(k)[row].as_buffer(), np.int64) for k in (1, 2, 3))
            yield pa.RecordBatch.from_arrays([pa.array(_ids(b.column(0)[row].as_py(), len(m))), pa.array(h1), pa.array(h2),
                                              pa.array(m), b.column(4)[row].values], names=["rep", "h1", "h2", "m", "low"])


def choose_planes(good: DataFrame, n: int, dim: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pivots and principal axes, from a sample of about ``n`` distinct vectors."""
    # about twice as many rows by hash, then the first of them: few rows move, however many there are
    share = F.lit(math.ceil(min(1.0, 2 * SAMPLE / n) * (1 << 40)))
    sample = (good.where(F.pmod(F.xxhash64("h1"), F.lit(1 << 40)) < share).dropDuplicates(["h1", "h2"])
              .orderBy("h1", "h2").limit(SAMPLE).select("vec").toPandas()["vec"].tolist()
              or good.limit(1).select("vec").toPandas()["vec"].tolist())
    unit = np.zeros((len(sample), dim))
    for i, r in enumerate(sample):
        unit[i, :len(r)] = r
    unit = _unit(unit)
    pivots = _chain(choose_pivots(unit, n, float(np.sqrt(max(0.0, 2 - 2 * threshold)))))  # MAX_PIVOTS rows at most
    return pivots, np.linalg.eigh(unit.T @ unit)[1][:, ::-1][:, :max(AXES, dim // 8)]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id",
                    vec_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    spark = vectors.sparkSession
    kind = "float" if vectors.select(vec_col).dtypes[0][1] == "array<float>" else "double"
    dtype = {"float": "float32", "double": "float64"}[kind]
    # compiled by Spark, unlike functions of elements; array_contains is null where only a null may hide one
    vec, most, least, inf = F.col("vec"), F.array_max("vec"), F.array_min("vec"), F.lit(float("inf"))
    ok = F.coalesce((F.size(vec) > 0) & ~F.array_contains(vec, inf.cast(kind)) & ~F.isnan(most) & (least > -inf)
                    & ((most != 0) | (least != 0)), F.lit(False))
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"))
            .withColumn("ok", ok))
    # equal vectors share a 128-bit hash, for which -0.0 and 0.0 are one number
    good = rows.where("ok").withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(1), "vec"))
    size = good.agg(F.approx_count_distinct("h1").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    bad = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                          F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not size["n"]:
        return bad
    n, dim = size["n"], size["dim"]
    shared = spark.sparkContext.broadcast((*choose_planes(good, n, dim, threshold), threshold))
    tiles = make_tiles(good.groupBy("h1", "h2").agg(F.count("*").alias("m"), F.min("vec_id").alias("low"),
                                                    F.first("vec").alias("vec")), shared, dtype, n, dim)
    let_go(spark)  # the vectors' shuffles
    found = links_and_counts(tiles, shared, dtype, dim)
    counts = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("others"))
    roots = components(found.where("v is not null").select("u", "v"))
    with _batches(spark, 1):
        reps = materialize(tiles.select("no", "h1", "h2", "m", "lows")
                           .mapInArrow(_unpack, "rep long, h1 long, h2 long, m long, low long"))
    label = (reps.join(counts, "rep", "left")
             .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
             .select("h1", "h2", "low", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"),
                     F.coalesce("root", "rep").alias("root")))
    smallest = label.groupBy("root").agg(F.min("low").alias("component_id"))
    label = materialize(label.join(smallest, "root").select("h1", "h2", "n_links", "component_id"))
    let_go(spark)
    out = (good.select("vec_id", "h1", "h2").join(label, ["h1", "h2"])
           .select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")))
    return out.union(bad)
