"""Sparse breaks of the seasonal regression's trend, and its band."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridcast.plans import seasonal as SE

T0 = pd.Timestamp("2024-01-01")


def frame(spark, series):
    rows = [(s, T0 + pd.Timedelta(hours=k), float(v)) for s, y in series.items() for k, v in enumerate(y)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["series_id", "ts", "load_mw"]))


def test_one_planted_break_is_found_and_no_other(spark):
    n = 24 * 50 + 1
    s, rng = np.arange(n) / (n - 1), np.random.default_rng(1)
    knot = SE.knots_of(SE.CHANGEPOINTS)[11]
    day = 1 + 0.2 * np.sin(2 * np.pi * np.arange(n) / 24)
    up = 1000 * (1 + 0.5 * s + 1.5 * np.maximum(0, s - knot)) * day + rng.normal(0, 20, n)
    got = {r["series_id"]: r for r in SE.fit_seasonal(frame(spark, {
        "break": up, "line": 1000 * (1 + 0.5 * s) * day + rng.normal(0, 20, n), "noise": rng.normal(500, 50, n)}),
        regressors=()).collect()}
    assert [k for k in got["break"]["_knots"] if k <= SE.CHANGEPOINT_RANGE] == pytest.approx([knot])
    assert got["break"]["_trend"][2] * got["break"]["_scale"] == pytest.approx(1500, rel=0.1) and got["break"]["_rate"] > 0
    for quiet in ("line", "noise"):
        assert got[quiet]["_knots"] == [] and got[quiet]["_rate"] == 0 and len(got[quiet]["_cov"]) == 4


def test_sparse_solution_is_the_least_squares_of_the_chosen_columns():
    rng = np.random.default_rng(2)
    s = np.sort(rng.random(400))
    x = SE.trend_matrix(s, 10)
    y = 1 + 2 * s - 3 * np.maximum(0, s - SE.knots_of(10)[4]) + rng.normal(0, 0.02, 400)
    coef, cov, noise = SE.solve_sparse(x.T @ x, x.T @ y, y @ y, len(y), slice(2, 12), np.zeros(12))
    assert np.flatnonzero(coef[2:]).tolist() == [4]
    use = [0, 1, 6]
    want = np.linalg.lstsq(x[:, use], y, rcond=None)[0]
    assert np.allclose(coef[use], want, atol=1e-5) and noise == pytest.approx(0.02 ** 2, rel=0.2)
    assert np.allclose(cov[np.ix_(use, use)], noise * np.linalg.inv(x[:, use].T @ x[:, use]), rtol=1e-3)


def test_band_covers_near_and_far_and_widens(spark):
    """120 series whose slope changes at random times, in train and after it."""
    rng, days, ahead, series = np.random.default_rng(3), 30, 72, {}
    n = days * 24
    for k in range(120):
        slope = np.full(n + ahead, rng.normal(0, 0.3))
        for at in np.flatnonzero(rng.random(n + ahead) < 4 / n):
            slope[at:] += rng.laplace(0, 0.8)
        y = 1000 + np.cumsum(slope)
        series[f"s{k}"] = y * (1 + 0.2 * np.sin(2 * np.pi * np.arange(n + ahead) / 24)) + rng.normal(0, 15, n + ahead)
    df = frame(spark, series)
    cut = F.lit(T0 + pd.Timedelta(hours=n))
    coefs = SE.fit_seasonal(df.where(F.col("ts") < cut), regressors=())
    p = SE.predict_seasonal(df.where(F.col("ts") >= cut), coefs, regressors=(), keep=["load_mw"]).toPandas()
    p["h"] = ((p.ts - T0) / pd.Timedelta(hours=1)).astype(int) - n + 1
    p["hit"], p["wide"] = p.load_mw.between(p.yhat_lower, p.yhat_upper), p.yhat_upper - p.yhat_lower
    near, far = p[p.h <= 6], p[p.h > ahead - 6]
    print("coverage", near.hit.mean(), far.hit.mean(), "width", near.wide.mean(), far.wide.mean())
    assert 0.70 <= near.hit.mean() <= 0.90 and 0.70 <= far.hit.mean() <= 0.90
    assert far.wide.mean() > 1.1 * near.wide.mean()


def test_predictions_of_rows_equal_the_matrices(spark):
    rng = np.random.default_rng(4)
    n = 24 * 21
    y = np.concatenate([np.linspace(100, 300, n // 2), np.linspace(300, 150, n - n // 2)]) + rng.normal(0, 3, n)
    df = frame(spark, {"a": y}).withColumn("temp", F.hour("ts") * 1.5)
    coefs = SE.fit_seasonal(df, regressors=("temp",))
    c, p = coefs.first(), SE.predict_seasonal(df, coefs, regressors=("temp",)).orderBy("ts").toPandas()
    hours = (T0 - pd.Timestamp(0)) / pd.Timedelta(hours=1) + np.arange(n)
    s = (hours - c["_h0"]) / (c["_h1"] - c["_h0"])
    x = np.column_stack([np.ones(n), s, *(np.maximum(0, s - k) for k in c["_knots"])])
    temp = ((hours % 24) * 1.5 - c["_m_temp"]) / c["_s_temp"]
    holiday = np.isin(p.ts.dt.date.astype(str), ["2024-01-01", "2024-01-15"]).astype(float)
    season = 1 + SE.season_matrix(hours, holiday, temp[:, None], SE.SEASONS, True) @ np.array(c["_beta"])
    assert len(c["_knots"]) >= 1 and np.allclose(p.yhat, x @ np.array(c["_trend"]) * season * c["_scale"])
    m = x.shape[1]
    var = ((x @ np.array(c["_cov"]).reshape(m, m)) * x).sum(axis=1)
    half = 1.2815515655446004 * np.sqrt(c["sigma"] ** 2 + (c["_scale"] * season) ** 2 * var)
    assert np.allclose(p.yhat_upper - p.yhat, half)


def test_rows_meet_their_series_by_block(spark):
    """No join of rows on the series alone, in the fit and in predictions."""
    df = frame(spark, {"a": np.arange(400.0), "b": np.ones(400)})
    coefs = SE.materialize(SE.fit_seasonal(df, regressors=()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = SE.predict_seasonal(df, coefs, regressors=())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = [x for x in plan.split("\n") if "SortMergeJoin" in x]
    assert any("_blk" in x for x in joins) and "MapInPandas" not in plan
    assert sum("_blk" not in x for x in joins if "holiday" not in x) <= 2  # blocks with their series, days with holidays
