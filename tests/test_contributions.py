"""Shapley values of tree ensembles against all subsets."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from gridcast.plans import boosting as BO
from gridcast.plans import contributions as CO
from gridcast.plans import models as PM
from gridcast.plans.forecast import tree_arrays

COLS = ["a", "b", "c", "d"]


def frame(n=160):
    r = np.random.default_rng(8)
    p = pd.DataFrame({c: r.normal(size=n) if c != "b" else r.integers(0, 4, n).astype(float) for c in COLS})
    t = pd.Timestamp("2024-01-01")
    return p.assign(load_mw=3 * p.a + np.where(p.b > 1, p.c, -p.c) * 2, series_id="s",
                    ts=[t + pd.Timedelta(hours=i) for i in range(n)])


def value(trees, x, known):
    """Mean prediction when only the features ``known`` are known."""
    def down(n):
        left, right = trees["left"][n], trees["right"][n]
        if left == n:
            return trees["value"][n]
        f = trees["feature"][n]
        if f in known:
            return down(left if x[f] <= trees["threshold"][n] else right)
        cover = trees["cover"]
        return (cover[left] * down(left) + cover[right] * down(right)) / cover[n]
    return sum(down(r) for r in trees["roots"])


@pytest.mark.parametrize("kind", ["rf", "xgboost", "penalised"])
def test_contributions_against_all_subsets(spark, kind):
    p = frame()
    df = spark.createDataFrame(p)
    if kind == "penalised":
        m = BO.fit_penalised(df, COLS, rounds=3, depth=4, rate=0.5, row_share=1.0)
    else:
        m = PM.fit(kind, df, COLS, **({"numTrees": 3, "maxDepth": 5} if kind == "rf" else {"maxIter": 3, "maxDepth": 4}))
    got = (CO.tree_contributions(m, df.repartition(3)).toPandas().pivot(index="ts", columns="feature", values="contribution")
           .sort_index()[COLS].to_numpy())
    trees, base = tree_arrays(m), CO.base_value(m)
    pred = m.transform(df).select("ts", "prediction").toPandas().sort_values("ts").prediction.to_numpy()
    assert np.allclose(got.sum(axis=1) + base, pred, atol=1e-9)
    x = p[COLS].to_numpy()
    for i in (0, 7, 50, 159):
        for j in range(4):
            others = [k for k in range(4) if k != j]
            want = sum(math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * (value(trees, x[i], {*s, j}) - value(trees, x[i], set(s)))
                       for n in range(4) for s in itertools.combinations(others, n))
            assert abs(got[i, j] - want) < 1e-9


def test_contributions_of_one_leaf(spark):
    df = spark.createDataFrame(frame().assign(load_mw=2.0))
    m = BO.fit_penalised(df, COLS, rounds=1)
    assert CO.base_value(m) == 2.0
    assert {r["contribution"] for r in CO.tree_contributions(m, df).collect()} == {0.0}
