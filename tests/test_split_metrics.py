"""Splits, folds and metric edge cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridcast.operators import metrics as M
from gridcast.operators import split as SP


def frame(spark, n, series=("a",)):
    t0 = pd.Timestamp("2024-01-01")
    rows = [(s, t0 + pd.Timedelta(hours=i), float(i)) for s in series for i in range(n)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["series_id", "ts", "load_mw"]))


def test_split_cutoff(spark):
    tr, te = SP.split_cutoff(frame(spark, 100), "2024-01-03")
    assert tr.agg(F.max("ts")).first()[0] < te.agg(F.min("ts")).first()[0]
    assert tr.count() + te.count() == 100


@pytest.mark.parametrize("n,k", [(100, 5), (37, 3), (12, 5)])
def test_folds_match_expanding_window_rule(spark, n, k):
    out = SP.walk_forward_folds(frame(spark, n, ("a", "b")), k).filter(F.col("series_id") == "a").toPandas()
    t = n // (k + 1)
    for i in range(k):
        start = n - (k - i) * t
        val = sorted(out[(out.fold == i) & (out.role == "validate")]["idx"])
        trn = sorted(out[(out.fold == i) & (out.role == "train")]["idx"])
        assert val == list(range(start, start + t))
        assert trn == list(range(0, start))


def preds(spark, y, p):
    return spark.createDataFrame(pd.DataFrame({"model": "m", "y": y, "p": p}))


def test_mape_null_when_all_zero(spark):
    m = M.evaluate_models(preds(spark, [0.0, 0.0], [1.0, 2.0]), rounded=False).first()
    assert m["mape"] is None and m["mae"] == 1.5


def test_r2_constant_actuals(spark):
    assert M.evaluate_models(preds(spark, [3.0, 3.0], [3.0, 3.0]), rounded=False).first()["r2"] == 1.0
    assert M.evaluate_models(preds(spark, [3.0, 3.0], [2.0, 3.0]), rounded=False).first()["r2"] == 0.0


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(100, 10, 500)
    p = y + rng.normal(0, 3, 500)
    y[0] = 0.0
    m = M.evaluate_models(preds(spark, y, p), rounded=False).first()
    e = y - p
    assert abs(m["mae"] - np.mean(np.abs(e))) < 1e-9
    assert abs(m["rmse"] - np.sqrt(np.mean(e ** 2))) < 1e-9
    mask = y != 0
    assert abs(m["mape"] - np.mean(np.abs(e[mask] / y[mask])) * 100) < 1e-9
    assert abs(m["r2"] - (1 - np.sum(e ** 2) / np.sum((y - y.mean()) ** 2))) < 1e-9


def test_histogram_edges(spark):
    h = M.residual_histogram(preds(spark, [0.0, 1.0, 2.0, 10.0], [0.0, 0.0, 0.0, 0.0]), bins=80).toPandas()
    assert h["count"].sum() == 4 and h["bin"].max() == 79
    one = M.residual_histogram(preds(spark, [1.0, 1.0], [0.0, 0.0])).toPandas()
    assert len(one) == 1 and one["count"].iloc[0] == 2


def test_leaderboard(spark):
    met = spark.createDataFrame([("a", 2.0, 3.0, 1.0, 0.5), ("b", 1.0, 4.0, 2.0, 0.6)],
                                "model string, mae double, rmse double, mape double, r2 double")
    lb = M.leaderboard(met).toPandas()
    assert lb["Model"].tolist() == ["b", "a"] and lb["is_best"].tolist() == [True, False]
    assert M.best_model(met).first()["best_model"] == "b"
    best = {r["metric"]: r["model"] for r in M.best_per_metric(met).collect()}
    assert best == {"mae": "b", "rmse": "a", "mape": "a"}
