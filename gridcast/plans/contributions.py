"""Exact Shapley values of tree ensembles (M8).

A leaf is a product over the features of its path: a row agrees with the leaf's
interval of a feature or not, and where the feature is not known the row goes
with the share of training rows that the path's splits on it sent this way (its
*cover share*).  For a set ``S`` of known features a leaf so contributes

    value * product over S of [agrees] * product over the others of share

and the Shapley values of a product need no subsets: with ``A`` the features
that agree, ``B`` the others and ``d`` of them in all, the polynomial
``P(z) = prod over A of (share + z)`` has as coefficients the sums over subsets
of each size, weighted by ``s! (d - s - 1)! / d!``:

    agreeing j:      value * (1 - share_j) * prod_B share * weigh(P / (share_j + z))
    disagreeing j:  -value * prod_B share * weigh(P)

The path table (leaf, feature, interval, cover share) is as large as the model
and goes to the tasks; rows are scored a batch and a tree at a time, so memory
does not grow with the ensemble's leaves times the rows.  The contributions of a
row and :func:`base_value` add up to its prediction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..schema import KEYS, TS
from .forecast import tree_arrays

#: Rows times leaves that a task works on at a time.
CELLS = 1 << 18


def tree_paths(trees: dict, root: int, end: int) -> dict[str, np.ndarray]:
    """Path table of the tree whose nodes are ``root`` up to ``end``: per leaf
    its ``value`` and, padded to the longest path, ``feature`` (-1: none),
    ``low``, ``high`` and ``share``."""
    leaves: list[tuple[float, dict[int, list[float]]]] = []
    open_: list[tuple[int, dict[int, list[float]]]] = [(root, {})]
    while open_:
        n, path = open_.pop()
        if trees["left"][n] == n:
            leaves.append((trees["value"][n], path))
            continue
        f, t = int(trees["feature"][n]), float(trees["threshold"][n])
        for child, left in ((trees["left"][n], True), (trees["right"][n], False)):
            low, high, share = path.get(f, [-math.inf, math.inf, 1.0])
            part = trees["cover"][child] / trees["cover"][n] if trees["cover"][n] else 0.5
            open_.append((int(child), {**path, f: [low if left else max(low, t), min(high, t) if left else high, share * part]}))
    width = max(len(p) for _, p in leaves)
    out = {"value": np.array([v for v, _ in leaves]), "feature": np.full((len(leaves), width), -1),
           "low": np.full((len(leaves), width), -math.inf), "high": np.full((len(leaves), width), math.inf),
           "share": np.ones((len(leaves), width))}
    for i, (_, path) in enumerate(leaves):
        for k, (f, (low, high, share)) in enumerate(sorted(path.items())):
            out["feature"][i, k], out["low"][i, k], out["high"][i, k], out["share"][i, k] = f, low, high, share
    return out


def ensemble_paths(trees: dict) -> list[dict[str, np.ndarray]]:
    ends = [*trees["roots"][1:], len(trees["feature"])]
    return [tree_paths(trees, r, e) for r, e in zip(trees["roots"], ends, strict=True)]


def _weights(d: np.ndarray, size: int) -> np.ndarray:
    """``s! (d - s - 1)! / d!`` by leaf and ``s``, 0 beyond the path."""
    out = np.zeros((len(d), max(1, size)))
    for i, n in enumerate(d.tolist()):
        for s in range(n):
            out[i, s] = math.factorial(s) * math.factorial(n - s - 1) / math.factorial(n)
    return out


def path_contributions(x: np.ndarray, p: dict[str, np.ndarray], n_features: int) -> np.ndarray:
    """Shapley values (rows x features) of one tree for the rows ``x``."""
    out = np.zeros((len(x), n_features))
    leaves, width = p["feature"].shape
    if not width:
        return out
    real = p["feature"] >= 0
    weights = _weights(real.sum(axis=1), width)
    at = np.where(real, p["feature"], 0)
    agree = [real[:, k] & (x[:, at[:, k]] > p["low"][:, k]) & (x[:, at[:, k]] <= p["high"][:, k]) for k in range(width)]
    poly = np.zeros((width + 1, len(x), leaves))
    poly[0] = 1.0
    apart = np.ones((len(x), leaves)) * p["value"]
    for k in range(width):
        share = p["share"][:, k]
        grown = poly * share
        grown[1:] += poly[:-1]
        poly = np.where(agree[k], grown, poly)
        apart = np.where(agree[k] | ~real[:, k], apart, apart * share)
    for k in range(width):
        share = p["share"][:, k]
        # P / (share + z), from the highest coefficient down; it has the size that agreeing features leave
        quotient, above = np.zeros_like(poly), np.zeros((len(x), leaves))
        for s in range(width, 0, -1):
            above = poly[s] - share * above
            quotient[s - 1] = above
        gained = apart * (1 - share) * np.einsum("srl,ls->rl", quotient[:width], weights)
        missed = -apart * np.einsum("srl,ls->rl", poly[:width], weights)
        part = np.where(agree[k], gained, missed) * real[:, k]
        for f in np.unique(at[real[:, k], k]):
            out[:, f] += part[:, (at[:, k] == f) & real[:, k]].sum(axis=1)
    return out


def base_value(model) -> float:
    """Mean prediction by cover: what the contributions of a row add to."""
    return float(sum((p["value"] * p["share"].prod(axis=1)).sum() for p in ensemble_paths(tree_arrays(model))))


def tree_contributions(model, df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """M8 for tree ensembles: long table ``keys, ts, feature, contribution``
    with a row for every feature of every row of ``df``; rows with a null
    feature are left out."""
    cols = model.cols if hasattr(model, "flat") else model.stages[0].getInputCols()
    cols, keys = list(cols), list(keys)
    paths = df.sparkSession.sparkContext.broadcast(ensemble_paths(tree_arrays(model)))  # as large as the model
    rows = df.dropna(subset=cols).select(*keys, ts, *cols)
    named = len(keys) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in b.columns[named:]], axis=1)
            total = np.zeros(x.shape)
            for p in paths.value:
                step = max(1, CELLS // len(p["value"]))
                for a in range(0, len(x), step):
                    total[a:a + step] += path_contributions(x[a:a + step], p, len(cols))
            yield pa.RecordBatch.from_arrays([*b.columns[:named], *(pa.array(total[:, k]) for k in range(len(cols)))],
                                             names=b.schema.names)

    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in (*keys, ts)] + [f"`{c}` double" for c in cols])
    return rows.mapInArrow(run, schema).unpivot([*keys, ts], cols, "feature", "contribution")
