"""Scores of tree ensembles over many rows: the trees as arrays, walked by
batches of rows, one tree after the other.

``transform`` walks objects, row by row and tree by tree.  Here the nodes of a
tree stay in the cache while a slice of rows passes it.  Where a feature has one
value in all rows of a batch, as the stand-ins of points without history have,
its splits are decided once for the batch and not row by row.  Predictions are
those of ``transform`` up to the order of their sum; as there, a missing feature
is an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .forecast import FLAT_NODES, tree_arrays

#: Rows that pass a tree at a time.
SLICE = 4096
#: Rows from which on deciding a batch's constant splits beforehand pays off.
NARROW_ROWS = 256


class Walker:
    """An ensemble as arrays, of at most ``FLAT_NODES`` nodes."""

    def __init__(self, cols: list[str], trees: Mapping):
        self.cols = cols
        self.roots, self.feature = (np.asarray(trees[k], np.int64) for k in ("roots", "feature"))
        self.threshold, self.value = (np.asarray(trees[k], float) for k in ("threshold", "value"))
        self.child = np.stack([trees["right"], trees["left"]], axis=1).astype(np.int64).ravel()  # of node n: 2n + (goes left)
        self.depth = self._depths(self.roots, self.child)
        self._narrowed = None, (self.roots, self.child, self.depth)

    def _depths(self, roots: np.ndarray, child: np.ndarray) -> list[int]:
        """Steps by tree from its root to its deepest leaf."""
        deep, tree, node, level = np.zeros(len(roots), np.int64), np.arange(len(roots)), roots, 0
        while True:
            inner = child[2 * node] != node
            if not inner.any():
                return deep.tolist()
            tree, node, level = tree[inner], node[inner], level + 1
            deep[tree] = level
            tree, node = np.concatenate([tree, tree]), np.concatenate([child[2 * node], child[2 * node + 1]])

    def _trees(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Roots, children and depths for the rows of ``x``: nodes that split on a
        feature of one value lead straight to where all rows go."""
        first = x[:, 0].copy()
        first[(x != first[:, None]).any(axis=1)] = np.nan
        if self._narrowed[0] != (key := first.tobytes()):
            n = np.arange(len(self.feature))
            one = first[self.feature]
            skip = np.where(np.isnan(one), n, self.child[2 * n + (one <= self.threshold)])
            while not np.array_equal(far := skip[skip], skip):
                skip = far
            roots, child = skip[self.roots], skip[self.child]
            self._narrowed = key, (roots, child, self._depths(roots, child))
        return self._narrowed[1]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Predictions of the columns of ``x`` (features x rows)."""
        trees = self._trees(x) if x.shape[1] >= NARROW_ROWS else (self.roots, self.child, self.depth)
        return np.concatenate([np.zeros(0), *(self._slice(np.ascontiguousarray(x[:, k:k + SLICE]), *trees)
                                              for k in range(0, x.shape[1], SLICE))])

    def _slice(self, x: np.ndarray, roots: np.ndarray, child: np.ndarray, depths: list[int]) -> np.ndarray:
        n = x.shape[1]
        at, flat, first = np.arange(n), x.ravel(), self.feature * n
        total = np.zeros(n)
        for root, depth in zip(roots.tolist(), depths, strict=True):
            node = np.full(n, root)
            for _ in range(depth):
                left = flat.take(first.take(node) + at) <= self.threshold.take(node)
                node = child.take(2 * node + left)
            total += self.value.take(node)
        return total


def walker(model) -> Walker | None:
    """The model's walker; ``None`` if it is not a tree ensemble, or too large
    or of another kind than the arrays hold."""
    if not hasattr(model, "flat") and (not hasattr(model.stages[-1], "treeWeights") or model.stages[-1].totalNumNodes > FLAT_NODES):
        return None
    try:
        trees = tree_arrays(model)
    except ValueError:
        return None
    cols = model.cols if hasattr(model, "flat") else model.stages[0].getInputCols()
    return Walker(list(cols), trees) if len(trees["feature"]) <= FLAT_NODES else None


def walked_rows(df: DataFrame, walkers: Mapping[str, Walker], by: str, kept: list[str], out: str) -> DataFrame:
    """``kept`` columns and ``out``: each row's score by the walker that its
    column ``by`` names, in one pass over the rows."""
    cols = sorted({c for w in walkers.values() for c in w.cols})
    shared = df.sparkSession.sparkContext.broadcast((dict(walkers), cols))
    schema = T.StructType([*[f for f in df.select(*kept).schema.fields], T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walkers, cols = shared.value
        n = len(schema.fields) - 1
        for b in batches:
            named = np.array(b.column(n).to_pylist(), dtype=object)
            score = np.empty(b.num_rows)
            x = dict(zip(cols, (b.column(n + 1 + i).to_numpy(zero_copy_only=False) for i in range(len(cols))), strict=True))
            for name, w in walkers.items():
                mine = np.flatnonzero(named == name)
                if not len(mine):
                    continue
                table = np.stack([x[c][mine] for c in w.cols])
                if np.isnan(table).any():
                    raise ValueError(f"a row for {name} has a missing feature")
                score[mine] = w(table)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(score, pa.float64())], names=[f.name for f in schema.fields])

    held = df.select(*kept, F.col(by).alias("_by"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    return held.mapInArrow(run, schema)
