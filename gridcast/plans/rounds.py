"""Gradient boosting in few jobs (M5): the rounds of Spark's ``GBTRegressor``
(squared error, variance gain, first tree whole and all others times the step
size) on rows that become bin numbers once.

Spark's learner is a job a tree level, some thousands a fit, whose fixed costs
outweigh the work.  Here a level's sums (count, sum and sum of squares by node,
feature and bin) are added up over the blocks of rows, a block of at most
``BLOCK_ROWS`` rows a task.  With several blocks a level is still a job, of one
stage; rows that are one block need no sums of others, so their task goes on
through all rounds.  Both ways run the same steps and give the same trees for any
partitioning: rows are drawn by a hash of the row and the round, features of a
node by the round and the node, and gains that differ in rounding only are ties.

The result is an ordinary ``GBTRegressionModel``, read from the format in which
Spark keeps one.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEYS, TARGET, TS
from ..session import checkpoint_dir, drop_path, scratch_path
from .boosting import bin_cuts

#: Rows that a task holds; as many fit in one block.
BLOCK_ROWS = 100_000
#: Rounds between two reliable checkpoints of the blocks.
WRITE_EVERY = 20
#: Blocks whose sums the driver adds up itself.
READ_BLOCKS = 16
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class Rules:
    """Settings of a fit, of bounded size: they go to every task."""

    def __init__(self, cuts: list[np.ndarray], gbt: GBTRegressor):
        self.cuts, self.width = cuts, max(map(len, cuts)) + 1
        self.rounds, self.depth, self.rate = gbt.getMaxIter(), gbt.getMaxDepth(), gbt.getStepSize()
        self.least, self.least_gain, self.seed = gbt.getMinInstancesPerNode(), gbt.getMinInfoGain(), gbt.getSeed()
        self.row_share = gbt.getSubsamplingRate()
        self.picked = max(1, min(len(cuts), math.ceil(feature_share(gbt.getFeatureSubsetStrategy()) * len(cuts))))


def feature_share(strategy: str) -> float:
    """Share of the features that a node looks at; only "all" and fractions are known."""
    return 1.0 if strategy in ("all", "auto") else float(strategy)


def split_points(rows: DataFrame, cols: Sequence[str], bins: int) -> list[np.ndarray]:
    """Per feature the points to split at: midway between its values if they are at
    most ``bins``, else quantiles of all rows."""
    out = []
    few = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
    small = [c for c in cols if few[c] <= 2 * bins]
    values = rows.agg(*[F.sort_array(F.collect_set(F.col(c).cast("double"))).alias(c) for c in small]).first() if small else {}
    rest = [c for c in cols if c not in small or len(values[c]) > bins]
    cuts = dict(zip(rest, bin_cuts(rows, rest, bins), strict=True)) if rest else {}
    for c in cols:
        v = np.array(cuts[c] if c in cuts else values[c], dtype=float)
        out.append(v if c in cuts else (v[:-1] + v[1:]) / 2)
    return out


class Grown:
    """A tree: nodes as lists, a leaf leads to itself."""

    def __init__(self):
        self.feature, self.bin, self.left, self.right, self.gain, self.sums = [], [], [], [], [], []

    def leaf(self, sums) -> int:
        n = len(self.feature)
        for held, x in ((self.feature, 0), (self.bin, 0), (self.left, n), (self.right, n), (self.gain, -1.0),
                        (self.sums, tuple(map(float, sums)))):
            held.append(x)
        return n

    def values(self) -> np.ndarray:
        return np.array([s / n if n else 0.0 for n, s, _ in self.sums])

    def step(self, bins: np.ndarray, node: np.ndarray, times: int = 1) -> np.ndarray:
        """The nodes that rows in ``node`` reach."""
        feature, cut, left, right = (np.array(x, dtype=np.int32) for x in (self.feature, self.bin, self.left, self.right))
        at = np.arange(len(node))
        for _ in range(times):
            node = np.where(bins[feature[node], at] <= cut[node], left[node], right[node])
        return node


def drawn(rows: np.ndarray, k: int, r: Rules) -> np.ndarray:
    """Places of the rows (hashes) that round ``k`` draws."""
    if r.row_share >= 1:
        return np.arange(len(rows))
    with np.errstate(over="ignore"):
        x = rows + np.uint64((r.seed * 1_000_003 + k + 1) * _MIX[0] % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return np.flatnonzero(((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) < r.row_share * 2.0 ** 53)


def level_sums(bins: np.ndarray, g: np.ndarray, node: np.ndarray, open_: list[int], nodes: int, r: Rules) -> np.ndarray:
    """Count, sum and sum of squares of ``g`` by open node, feature and bin."""
    slot = np.full(nodes, -1)
    slot[open_] = np.arange(len(open_))
    at = slot[node]
    mine = np.flatnonzero(at >= 0)
    base, g = at[mine] * r.width, g[mine]
    out = np.empty((3, len(open_), len(bins), r.width))
    for f in range(len(bins)):
        key = base + bins[f, mine]
        for s, weight in enumerate((None, g, g * g)):
            out[s, :, f] = np.bincount(key, weight, len(open_) * r.width).reshape(len(open_), r.width)
    return out


def tree_of(k: int, sums_of: Callable[[Grown, list[int], int], np.ndarray], r: Rules) -> Grown:
    """The tree of round ``k``; ``sums_of`` gives the sums of a level."""
    tree, open_ = Grown(), [0]
    tree.leaf((0, 0, 0))
    for level in range(r.depth):
        total = sums_of(tree, open_, level)
        if not level:
            tree.sums[0] = tuple(total[:, 0, 0].sum(axis=1).tolist())
        left = np.cumsum(total, axis=3)
        whole = left[:, :, :, -1:]
        right = whole - left
        n, ln, rn = whole[0], left[0], right[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (left[1] ** 2 / ln + right[1] ** 2 / rn - whole[1] ** 2 / n) / n
            spread = whole[2] / n - (whole[1] / n) ** 2  # of the node
            gain[(ln < r.least) | (rn < r.least) | ~(gain >= r.least_gain) | ~(gain > 1e-12 * whole[2] / n)] = -np.inf
            rated = np.round(gain / spread, 10)  # sums in another order give the same split
        last, now, open_ = level == r.depth - 1, open_, []
        for j, node in enumerate(now):
            if r.picked < len(r.cuts):
                some = np.random.default_rng((r.seed, k, node)).permutation(len(r.cuts))[r.picked:]
                rated[j, some] = -np.inf
            f, b = divmod(int(np.argmax(rated[j])), r.width)
            if not rated[j, f, b] > -np.inf:
                continue
            tree.feature[node], tree.bin[node], tree.gain[node] = f, b, float(gain[j, f, b])
            tree.left[node], tree.right[node] = (tree.leaf(x[:, j, f, b]) for x in (left, right))
            open_ += [] if last else [tree.left[node], tree.right[node]]
        if not open_:
            break
    return tree


def target_of(k: int, y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """What the tree of round ``k`` fits: the values, then the negative gradient."""
    return y if not k else 2 * (y - margin)


def after(block: tuple, k: int, tree: Grown, r: Rules) -> tuple:
    """The block with the margins that round ``k`` leaves."""
    bins, y, margin, rows = block
    reached = tree.step(bins, np.zeros(len(y), np.int32), r.depth)
    return bins, y, margin + (1.0 if not k else r.rate) * tree.values()[reached], rows


def all_rounds(block: tuple, r: Rules) -> list[Grown]:
    """All trees of rows that are one block."""
    trees = []
    for k in range(r.rounds):
        bins, y, margin, rows = block
        some = drawn(rows, k, r)
        held, g, node = bins[:, some], target_of(k, y, margin)[some], np.zeros(len(some), np.int32)

        def sums_of(tree, open_, level, held=held, g=g):
            nonlocal node
            node = tree.step(held, node) if level else node
            return level_sums(held, g, node, open_, len(tree.left), r)

        trees.append(tree_of(k, sums_of, r))
        block = after(block, k, trees[-1], r)
    return trees


def block_sums(block: tuple, k: int, tree: Grown, open_: list[int], level: int, r: Rules) -> np.ndarray:
    """A block's part of the sums of a level."""
    bins, y, margin, rows = block
    some = drawn(rows, k, r)
    held = bins[:, some]
    node = tree.step(held, np.zeros(len(some), np.int32), level)
    return level_sums(held, target_of(k, y, margin)[some], node, open_, len(tree.left), r)


def rounds_by_level(blocks, r: Rules) -> list[Grown]:
    """All trees, each level a job over the ``blocks``."""
    trees, waiting = [], None
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    parts = blocks.getNumPartitions()
    for k in range(r.rounds):
        def sums_of(tree, open_, level, blocks=blocks, k=k):
            partial = blocks.map(lambda b: block_sums(b, k, tree, open_, level, r))
            return sum(partial.collect()) if parts <= READ_BLOCKS else partial.treeReduce(np.add)

        tree = tree_of(k, sums_of, r)
        trees.append(tree)
        if waiting is not None:
            waiting.unpersist()  # the blocks of this round are there since its first job
        waiting, blocks = blocks, blocks.map(lambda b, k=k, tree=tree: after(b, k, tree, r)).persist(StorageLevel.MEMORY_AND_DISK)
        if (k + 1) % WRITE_EVERY == 0:
            blocks.checkpoint()
    for held in (waiting, blocks):
        if held is not None:
            held.unpersist()
    return trees


def blocks_of(rows: DataFrame, cols: Sequence[str], target: str, r: Rules, parts: int) -> DataFrame:
    """``rows`` in blocks, one a partition: bins by feature, target, margin and
    hash of every row."""
    known = [c for c in (*KEYS, TS) if c in rows.columns]
    table = rows.select(F.xxhash64(*known, *cols, target).alias("_row"), F.col(target).cast("double").alias("_y"),
                        *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    table = table.coalesce(1) if parts == 1 else table.repartition(parts, "_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, y, bins = [], [], []
        for b in batches:
            held = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            row.append(held[0].astype(np.int64).view(np.uint64))
            y.append(held[1])
            bins.append(np.stack([np.searchsorted(c, x).astype(np.uint16) for c, x in zip(r.cuts, held[2:], strict=True)]))
        if row:
            y = np.concatenate(y)
            block = np.concatenate(bins, axis=1), y, np.zeros(len(y)), np.concatenate(row)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])

    return table.mapInArrow(run, "block binary")


def fit_rounds(rows: DataFrame, n: int, cols: Sequence[str], gbt: GBTRegressor, target: str = TARGET) -> GBTRegressionModel:
    """The model that ``gbt`` describes, on ``n`` rows without nulls."""
    if not n:
        raise ValueError("no rows to fit")
    checkpoint_dir(rows.sparkSession)
    r = Rules(split_points(rows, cols, min(gbt.getMaxBins(), n)), gbt)
    parts = -(-n // BLOCK_ROWS)
    blocks = blocks_of(rows, cols, target, r, parts).rdd.map(lambda row: pickle.loads(row[0]))
    trees = blocks.map(lambda b: all_rounds(b, r)).first() if parts == 1 else rounds_by_level(blocks, r)
    return stored_model(rows.sparkSession, trees, r, gbt)


def stored_model(spark, trees: list[Grown], r: Rules, gbt: GBTRegressor) -> GBTRegressionModel:
    """The trees as Spark's model, by the files in which it is kept."""
    path = scratch_path(spark, "boosted")
    gbt.write().save(f"{path}/settings")
    said = json.loads(spark.read.text(f"{path}/settings/metadata").first()[0])

    def described(kind: str, uid: str, **more) -> str:
        return json.dumps(said | {"class": f"org.apache.spark.ml.regression.{kind}", "uid": uid} | more)

    one = {"paramMap": {}, "defaultParamMap": {}, "numFeatures": len(r.cuts)}
    nodes = []
    for t, tree in enumerate(trees):
        at, order, stack = {}, [], [0]
        while stack:  # Spark's numbers: a node, its left side, its right side
            n = stack.pop()
            at[n] = len(order)
            order.append(n)
            stack += [] if tree.left[n] == n else [tree.right[n], tree.left[n]]
        for n in order:
            leaf = tree.left[n] == n
            count, total, square = tree.sums[n]
            mean = total / count if count else 0.0
            split = {"featureIndex": -1 if leaf else tree.feature[n], "numCategories": -1,
                     "leftCategoriesOrThreshold": [] if leaf else [float(r.cuts[tree.feature[n]][tree.bin[n]])]}
            nodes.append((t, {"id": at[n], "prediction": mean, "impurity": max(0.0, square / count - mean * mean) if count else 0.0,
                              "impurityStats": [count, total, square], "rawCount": int(count), "gain": tree.gain[n],
                              "leftChild": -1 if leaf else at[tree.left[n]], "rightChild": -1 if leaf else at[tree.right[n]],
                              "split": split}))
    ids, data = zip(*nodes, strict=True)
    split = pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])
    kind = pa.struct([("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()),
                      ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64()), ("gain", pa.float64()),
                      ("leftChild", pa.int32()), ("rightChild", pa.int32()), ("split", split)])
    of_trees = [(t, described("DecisionTreeRegressionModel", f"dtr_{gbt.uid}_{t}", **one), 1.0 if not t else r.rate)
                for t in range(len(trees))]
    model = described("GBTRegressionModel", gbt.uid, numFeatures=len(r.cuts), numTrees=len(trees))
    spark.createDataFrame([(model,)], "value string").coalesce(1).write.text(f"{path}/model/metadata")
    spark.createDataFrame(of_trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/model/treesMetadata")
    spark.createDataFrame(pa.table([pa.array(ids, pa.int32()), pa.array(data, kind)], names=["treeID", "nodeData"])
                          ).coalesce(1).write.parquet(f"{path}/model/data")
    out = GBTRegressionModel.load(f"{path}/model")
    drop_path(spark, path)
    return out
