"""Histogram boosting with penalties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridcast.plans import boosting as BO
from gridcast.plans import forecast as FC

PLAIN = dict(row_share=1.0, column_share=1.0, min_child_weight=1.0)


def table(spark, n=400, seed=3):
    r = np.random.default_rng(seed)
    x = pd.DataFrame({"a": r.integers(0, 12, n).astype(float), "b": r.normal(size=n), "c": r.normal(size=n)})
    y = np.where(x.a > 5, 4.0, 0.0) + x.b + r.normal(0, 0.1, n)
    t = pd.Timestamp("2024-01-01")
    return x.assign(load_mw=y, series_id="s", ts=[t + pd.Timedelta(hours=i) for i in range(n)])


def plain_fit(p, cols, rounds, depth, rate, l1, l2, min_child_weight=1.0):
    """Exact greedy boosting in one process (every value is a bin)."""
    y = p.load_mw.to_numpy()
    m = np.full(len(p), y.mean())
    for _ in range(rounds):
        g = m - y
        step = np.zeros(len(p))

        def grow(rows, d):
            gt, ht = g[rows].sum(), len(rows)
            best = None
            for c in cols:
                x = p[c].to_numpy()[rows]
                for v in np.unique(x)[:-1] if d else []:
                    k = x <= v
                    gl, hl = g[rows][k].sum(), int(k.sum())
                    if min(hl, ht - hl) < min_child_weight:
                        continue
                    gain = sum(BO.shrunk(a, l1) ** 2 / (b + l2) * s for a, b, s in ((gl, hl, 1), (gt - gl, ht - hl, 1), (gt, ht, -1)))
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                        best = gain, k
            if best is None:
                step[rows] = BO.leaf_value(gt, ht, l1, l2)
            else:
                grow(rows[best[1]], d - 1)
                grow(rows[~best[1]], d - 1)

        grow(np.arange(len(p)), depth)
        m = m + rate * step
    return m


@pytest.mark.parametrize("l1,l2", [(0.0, 0.0), (3.0, 5.0)])
def test_boosting_against_one_process(spark, monkeypatch, l1, l2):
    monkeypatch.setattr(BO, "WRITE_EVERY", 2)
    monkeypatch.setattr(BO, "READ_SUMS", 700 if l1 else 1_000_000)  # a node at a time, or all
    p = table(spark)
    df = spark.createDataFrame(p).repartition(4)
    m = BO.fit_penalised(df, ["a", "b", "c"], rounds=3, depth=3, rate=0.4, l1=l1, l2=l2, bins=500, **PLAIN)
    got = m.transform(df).select("ts", "prediction").toPandas().sort_values("ts")
    assert np.allclose(got.prediction, plain_fit(p, ["a", "b", "c"], 3, 3, 0.4, l1, l2), atol=1e-9)


def test_penalties_and_draws_do_what_they_say(spark):
    df = spark.createDataFrame(table(spark)).repartition(3)
    fit = lambda **k: BO.fit_penalised(df, ["a", "b", "c"], **({"rounds": 2, "depth": 2, "rate": 0.3} | PLAIN | k))
    free, l2, l1 = fit(l1=0.0, l2=0.0), fit(l1=0.0, l2=200.0), fit(l1=1e6, l2=0.0)
    top = lambda m: max(abs(v) for v in m.trees[0].value)
    assert top(l2) < top(free) and all(v == 0 for t in l1.trees for v in t.value)
    assert all(len(t.feature) == 1 for t in l1.trees)
    heavy = fit(l1=0.0, l2=0.0, min_child_weight=150.0)
    assert max(len(t.feature) for t in heavy.trees) < max(len(t.feature) for t in free.trees)
    drawn = fit(column_share=0.34, rounds=6)
    assert all(len({c for n, c in enumerate(t.feature) if t.left[n] != n}) <= 1 for t in drawn.trees)
    assert len({c for t in drawn.trees for n, c in enumerate(t.feature) if t.left[n] != n}) > 1
    a, b = (BO.fit_penalised(df.repartition(n), ["a", "b", "c"], rounds=3, depth=2, row_share=0.5, l1=0.0) for n in (1, 7))
    assert [t.feature for t in a.trees] == [t.feature for t in b.trees]
    assert np.allclose([v for t in a.trees for v in t.value], [v for t in b.trees for v in t.value])


def test_scores_after_every_round_are_those_of_shorter_fits(spark):
    p = table(spark)
    df = spark.createDataFrame(p)
    train, valid = df.where(F.col("ts") < "2024-01-12"), df.where(F.col("ts") >= "2024-01-12")
    _, scores = BO.fit_penalised(train, ["a", "b"], rounds=5, depth=3, rate=0.4, valid=valid)
    for k in (1, 3, 5):
        m = BO.fit_penalised(train, ["a", "b"], rounds=k, depth=3, rate=0.4)
        error = m.transform(valid).agg(F.avg(F.abs(F.col("load_mw") - F.col("prediction")))).first()[0]
        assert abs(error - scores[k - 1]) < 1e-9
    assert scores[-1] < scores[0]


def test_bins_and_cuts(spark):
    df = spark.createDataFrame([(float(i % 40), float(i), 1.0, None if i % 2 else 2.0) for i in range(2000)], "a double, b double, k double, z double")
    cuts = BO.bin_cuts(df, ["a", "b", "k", "z"], 64)
    assert cuts[0] == [float(v) for v in range(39)] and 50 <= len(cuts[1]) <= 63 and cuts[2] == [] and cuts[3] == []
    got = df.select("b", BO.binned("b", cuts[1]).alias("n")).collect()
    assert all(r["n"] == sum(c < r["b"] for c in cuts[1]) for r in got)
    one = spark.createDataFrame([(1.0,), (2.0,)], "a double")
    assert sorted(r[0] for r in one.select(BO.binned("a", [1.0])).collect()) == [0, 1]


def test_boosted_forecast_and_nothing(spark):
    from gridcast.plans import features as PF

    from test_forecast_models import history
    h = history(spark, 300)
    f = PF.build_features(h, None)
    m = BO.fit_penalised(f, rounds=4, depth=3)
    a = FC.forecast_models({"xgboost": m}, h, 12).toPandas()
    b = FC.forecast_model(m, h, 12).toPandas()
    j = a.merge(b, on=["series_id", "step"])
    assert len(j) == 24 and np.abs(j.forecast_mw_x - j.forecast_mw_y).max() < 1e-9
    with pytest.raises(ValueError, match="no rows"):
        BO.fit_penalised(f.limit(0), rounds=1)
