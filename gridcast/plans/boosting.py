"""Histogram boosting with penalties (M5): squared error, second order.

Features become bin numbers once; a tree level is one aggregate, sums of
gradients and Hessians per (node, feature, bin), combined before the shuffle.
What the driver reads of it is bounded by nodes x features x bins, however many
rows there are, and wide levels are read a group of nodes at a time.  There the
split of every node is the one with the largest gain

    T(GL)^2 / (HL + l2) + T(GR)^2 / (HR + l2) - T(G)^2 / (H + l2)

with ``T(G) = sign(G) * max(|G| - l1, 0)`` and a leaf's value ``-T(G) / (H +
l2)``.  Every tree draws its rows (by a hash of the row, so a task that is run
again draws the same) and, once, its columns.

Rows keep their margin: after a tree it is the old one plus the leaf they fall
into; the table is written every few trees, which bounds the lineage.  Trees are
kept as arrays, in the form in which forecasts walk them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import mae
from ..schema import FEATURE_COLS, KEYS, TARGET, TS
from ..session import materialize

# --- fixed values: the reference's hyper-parameters of the boosted model ---------
PENALISED_PARAMS = {"rounds": 500, "depth": 6, "rate": 0.05, "row_share": 0.8, "column_share": 0.8,
                    "min_child_weight": 3.0, "l1": 0.1, "l2": 1.0}
# ---------------------------------------------------------------------------------
BINS = 256
SEED = 42
#: Sums (node, feature, bin) that the driver reads at a time.
READ_SUMS = 1_000_000
#: Trees between two written tables of margins.
WRITE_EVERY = 20


@dataclass
class Tree:
    """Nodes as arrays; a leaf leads to itself."""
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def leaf(self, value: float, cover: float = 0.0) -> int:
        n = len(self.feature)
        for name, x in (("feature", 0), ("threshold", math.inf), ("bin", 1 << 30), ("left", n), ("right", n), ("value", value), ("cover", cover)):
            getattr(self, name).append(x)
        return n

    def depth(self) -> int:
        deep = [0] * len(self.left)
        for n in range(len(self.left)):  # children come after their parent
            for child in {self.left[n], self.right[n]} - {n}:
                deep[child] = deep[n] + 1
        return max(1, max(deep))


def shrunk(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def leaf_value(g, h, l1: float, l2: float):
    return -shrunk(g, l1) / (h + l2)


def bin_cuts(df: DataFrame, cols: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Per feature the upper bounds of all bins but the last: its distinct
    values if there are few enough, else quantiles."""
    few = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
    small = [c for c in cols if few[c] <= bins * 2]
    got = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in small],  # about 2 * bins values
                 *[F.percentile_approx(c, [k / bins for k in range(1, bins)], 100 * bins).alias(c) for c in cols if c not in small]
                 ).first()
    out = []
    for c in cols:
        values = sorted({float(v) for v in got[c] or []})
        if c in small:
            values = values[:-1] if len(values) <= bins else [values[len(values) * k // bins] for k in range(1, bins)]
        out.append(sorted(set(values)))
    return out


def _array(values: Sequence) -> str:
    """A literal array in SQL, as one short expression."""
    kind = "int" if all(isinstance(v, int) for v in values) else "double"
    return f"cast(split('{','.join(map(repr, values))}', ',') as array<{kind}>)"


def binned(column: str, cuts: list[float]) -> Column:
    """Number of the bin of a column's value: how many upper bounds are below
    it, by halving steps over the sorted array of bounds."""
    if not cuts:
        return F.lit(0)
    mid = "cast(floor((st.a + st.b) / 2) as int)"
    right = f"st.a < st.b and get({_array(cuts)}, {mid}) < cast(`{column}` as double)"
    return F.expr(f"""aggregate(sequence(1, {len(cuts).bit_length()}), named_struct('a', 0, 'b', {len(cuts)}), (st, i) ->
        named_struct('a', if({right}, {mid} + 1, st.a), 'b', if({right} or st.a >= st.b, st.b, {mid})), st -> st.a)""")


def _node(tree: Tree) -> str:
    """In SQL, where a row of ``bins`` ends in ``tree``."""
    at = {k: f"get({_array(getattr(tree, k))}, n)" for k in ("feature", "bin", "left", "right")}
    return (f"aggregate(sequence(1, {tree.depth()}), 0, (n, i) -> if(get(bins, {at['feature']}) <= {at['bin']}, "
            f"{at['left']}, {at['right']}))")


def best_splits(sums: dict[str, np.ndarray], n_bins: int, l1: float, l2: float, min_child_weight: float) -> dict[int, tuple]:
    """``node -> (feature, bin, gain, left g, left h, right g, right h)`` out
    of sums by ``node, feature, bin`` with ``g, h``; ties go to the smaller
    feature, then bin."""
    out: dict[int, tuple] = {}
    order = np.lexsort((sums["bin"], sums["feature"], sums["node"]))
    node, feature, b, g, h = (sums[k][order] for k in ("node", "feature", "bin", "g", "h"))
    cut = np.flatnonzero(np.diff(node) | np.diff(feature)) + 1
    for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(node)], strict=True):
        if a == z:
            continue
        gl, hl = np.cumsum(g[a:z]), np.cumsum(h[a:z])
        gt, ht = gl[-1], hl[-1]
        gr, hr = gt - gl, ht - hl
        gain = (shrunk(gl, l1) ** 2 / (hl + l2) + shrunk(gr, l1) ** 2 / (hr + l2) - shrunk(gt, l1) ** 2 / (ht + l2))
        gain[(hl < min_child_weight) | (hr < min_child_weight)] = -np.inf
        gain[-1] = -np.inf
        k = int(gain.argmax())
        n = int(node[a])
        if gain[k] > 1e-6 and (n not in out or gain[k] > out[n][2]):
            out[n] = (int(feature[a]), int(b[a + k]), float(gain[k]), float(gl[k]), float(hl[k]), float(gr[k]), float(hr[k]))
    return out


class BoostedModel:
    """Fitted trees over named features."""

    def __init__(self, cols: Sequence[str], base: float, rate: float, trees: list[Tree]):
        self.cols, self.base, self.rate, self.trees = list(cols), base, rate, trees

    def flat(self) -> dict:
        """All trees as arrays, values times the rate; ``base`` is a tree of
        one leaf."""
        base = Tree()
        base.leaf(self.base / self.rate)
        out = {k: [] for k in ("roots", "feature", "threshold", "left", "right", "value", "cover")}
        for t in [base, *self.trees]:
            first = len(out["feature"])
            out["roots"].append(first)
            out["feature"] += t.feature
            out["threshold"] += t.threshold
            out["cover"] += t.cover
            out["left"] += [first + n for n in t.left]
            out["right"] += [first + n for n in t.right]
            out["value"] += [v * self.rate for v in t.value]
        return out | {"depth": max(t.depth() for t in [base, *self.trees])}

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``."""
        from .forecast import flat_frame, walked
        trees = flat_frame(df.sparkSession, self.flat()).select(F.struct("*").alias("_trees"))
        x = F.transform(F.array(F.array(*[F.col(c).cast("double") for c in self.cols])), lambda v: walked(v))
        out = df.crossJoin(F.broadcast(trees))  # one row of known size
        return out.withColumn("prediction", F.get(x, F.lit(0))).drop("_trees")

    def split_shares(self) -> dict[str, float]:
        """The share of all splits that each feature makes."""
        counts = dict.fromkeys(self.cols, 0)
        for t in self.trees:
            for n, c in enumerate(t.feature):
                counts[self.cols[c]] += t.left[n] != n
        total = max(1, sum(counts.values()))
        return {c: k / total for c, k in counts.items()}


def _grown(rows: DataFrame, chosen: list[int], n_bins: int, depth: int, l1: float, l2: float, min_child_weight: float) -> Tree:
    """One tree from ``bins, g`` (Hessian 1 a row) over the ``chosen`` features."""
    tree = Tree()
    total = rows.agg(F.sum("g"), F.count("*")).first()
    if not total[1]:
        tree.leaf(0.0)
        return tree
    tree.leaf(float(leaf_value(total[0], total[1], l1, l2)), total[1])
    open_, group = [0], max(1, READ_SUMS // (len(chosen) * n_bins))
    cells = f"inline(transform({_array(chosen)}, f -> named_struct('feature', f, 'bin', get(bins, f))))"
    for _ in range(depth):
        found: dict[int, tuple] = {}
        for k in range(0, len(open_), group):
            nodes = open_[k:k + group]
            placed = rows.selectExpr("g", "bins", f"{_node(tree)} as node")
            if len(nodes) < len(tree.left):
                placed = placed.where(f"array_contains({_array(nodes)}, node)")
            sums = (placed.selectExpr("g", "node", cells).groupBy("node", "feature", "bin")
                    .agg(F.sum("g").alias("g"), F.count("*").alias("h")).toArrow())  # READ_SUMS rows at most, or one node's
            cols = {c: sums.column(c).to_numpy() for c in ("node", "feature", "bin", "g", "h")}
            found |= best_splits(cols, n_bins, l1, l2, min_child_weight)
        open_ = []
        for n, (feature, b, _, gl, hl, gr, hr) in sorted(found.items()):
            tree.feature[n], tree.bin[n] = feature, b
            tree.left[n] = tree.leaf(float(leaf_value(gl, hl, l1, l2)), hl)
            tree.right[n] = tree.leaf(float(leaf_value(gr, hr, l1, l2)), hr)
            open_ += [tree.left[n], tree.right[n]]
        if not open_:
            break
    return tree


def fit_penalised(train: DataFrame, cols: Sequence[str] = FEATURE_COLS, rounds: int = PENALISED_PARAMS["rounds"],
                  depth: int = PENALISED_PARAMS["depth"], rate: float = PENALISED_PARAMS["rate"],
                  row_share: float = PENALISED_PARAMS["row_share"], column_share: float = PENALISED_PARAMS["column_share"],
                  min_child_weight: float = PENALISED_PARAMS["min_child_weight"], l1: float = PENALISED_PARAMS["l1"],
                  l2: float = PENALISED_PARAMS["l2"], bins: int = BINS, seed: int = SEED, target: str = TARGET,
                  keys: Sequence[str] = KEYS, ts: str = TS, valid: DataFrame | None = None
                  ) -> BoostedModel | tuple[BoostedModel, list[float]]:
    """Fit on ``train`` (rows with a null feature or target are left out).
    With ``valid`` also the mean absolute error on it after every round, of the
    same fit: any smaller number of rounds has its score too."""
    import random

    from .models import ROWS_PER_TASK
    cols = list(cols)
    draw = random.Random(seed)
    known = train.dropna(subset=[*cols, target])
    cuts = bin_cuts(known, cols, bins)
    n_bins = max(len(c) for c in cuts) + 1

    def table(df: DataFrame, part: int) -> DataFrame:
        return df.select(F.lit(part).alias("part"), F.col(target).cast("double").alias("y"), F.xxhash64(*keys, ts).alias("row"),
                         F.array(*[binned(c, x) for c, x in zip(cols, cuts, strict=True)]).alias("bins"))

    base = known.agg(F.avg(target).alias("b")).first()["b"]
    if base is None:
        raise ValueError("no rows to fit")
    rows = table(known, 0)
    if valid is not None:
        rows = rows.union(table(valid.dropna(subset=[*cols, target]), 1))
    state = materialize(rows.withColumn("m", F.lit(float(base))))
    parts = max(1, -(-state.count() // ROWS_PER_TASK))
    state = materialize(state.repartition(parts))  # a level is a job: no more tasks than the rows can use
    trees, scores = [], []
    picked = max(1, int(round(column_share * len(cols))))
    for k in range(rounds):
        chosen = sorted(draw.sample(range(len(cols)), picked))
        drawn = F.pmod(F.xxhash64("row", F.lit(seed), F.lit(k)), F.lit(1 << 30)) < F.lit(int(row_share * (1 << 30)))
        taking = state.where("part = 0")
        taking = taking.where(drawn) if row_share < 1 else taking
        tree = _grown(taking.select("bins", (F.col("m") - F.col("y")).alias("g")), chosen, n_bins, depth, l1, l2, min_child_weight)
        for n, c in enumerate(tree.feature):
            if tree.left[n] != n:
                tree.threshold[n] = cuts[c][tree.bin[n]]
        trees.append(tree)
        step = f"{rate!r}D * get({_array([float(v) for v in tree.value])}, {_node(tree)})"
        before, state = state, state.selectExpr("part", "y", "row", "bins", f"m + {step} as m")
        state = materialize(state) if (k + 1) % WRITE_EVERY == 0 else state.persist()
        if valid is not None:
            scores.append(state.where("part = 1").agg(mae(F.col("y"), F.col("m"))).first()[0])
        elif (k + 1) % WRITE_EVERY:
            state.count()
        before.unpersist()
    state.unpersist()
    model = BoostedModel(cols, float(base), rate, trees)
    return model if valid is None else (model, scores)
