"""Recursive forecasts, sequences, models."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridcast.operators import sequences as SEQ
from gridcast.plans import forecast as FC
from gridcast.plans import models as PM
from gridcast.schema import FEATURE_COLS


def history(spark, n, series=("a", "b")):
    t0 = pd.Timestamp("2024-03-01")
    rows = [(s, t0 + pd.Timedelta(hours=i), 100.0 + 10 * np.sin(i / 3.0) + j)
            for j, s in enumerate(series) for i in range(n)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["series_id", "ts", "load_mw"]))


def python_recursion(values, coef, intercept, n_steps):
    """Plain loop over the documented step rule (lags / rolling only)."""
    hist = list(values)
    out = []
    for _ in range(n_steps):
        h = np.array(hist)
        feats = {
            "lag_1h": h[-1],
            "lag_24h": h[-24] if len(h) >= 24 else h.mean(),
            "lag_168h": h[-168] if len(h) >= 168 else h.mean(),
            "rolling_mean_24h": h[-24:].mean(),
            "rolling_mean_168h": h[-168:].mean(),
            "rolling_std_24h": h[-24:].std(ddof=0),
        }
        p = intercept + sum(coef[k] * feats[k] for k in coef)
        out.append(p)
        hist.append(p)
    return out


@pytest.mark.parametrize("n", [10, 100, 400])
def test_linear_recursion_equals_python_loop(spark, n):
    coef = {"lag_1h": 0.5, "lag_24h": 0.2, "lag_168h": 0.1, "rolling_mean_24h": 0.1,
            "rolling_mean_168h": 0.05, "rolling_std_24h": 0.3}
    h = history(spark, n)
    got = FC.forecast_linear(h, coef, 3.0, 30).toPandas()
    assert len(got) == 60
    for s, g in got.groupby("series_id"):
        vals = h.filter(F.col("series_id") == s).orderBy("ts").toPandas()["load_mw"].tolist()
        exp = python_recursion(vals, coef, 3.0, 30)
        assert np.allclose(g.sort_values("step")["forecast_mw"].to_numpy(), exp, rtol=1e-10)
        ts = g.sort_values("step")["ts"].tolist()
        assert ts[0] == pd.Timestamp("2024-03-01") + pd.Timedelta(hours=n)


def test_unknown_model_is_an_error(spark):
    with pytest.raises(ValueError):
        FC.forecast_models({"linear": None}, history(spark, 30), 5, names=["magic_model"])
    with pytest.raises(ValueError):
        PM.estimator("magic_model")


def test_minmax_roundtrip(spark):
    df = history(spark, 50).withColumn("c", F.lit(7.0))
    sc = SEQ.minmax_fit(df, ["load_mw", "c"])
    back = SEQ.apply_minmax(SEQ.apply_minmax(df, sc, ["load_mw", "c"]), sc, ["load_mw", "c"], inverse=True)
    a = df.orderBy("series_id", "ts").toPandas()
    b = back.orderBy("series_id", "ts").toPandas()
    assert np.allclose(a["load_mw"], b["load_mw"]) and np.allclose(a["c"], b["c"])
    scaled = SEQ.apply_minmax(df, sc, ["load_mw"]).agg(F.min("load_mw"), F.max("load_mw")).first()
    assert scaled[0] == 0.0 and abs(scaled[1] - 1.0) < 1e-12


def test_sequences_count(spark):
    df = history(spark, 60)
    s = SEQ.make_sequences(df, 24, ["load_mw"], "load_mw", chunk_rows=30)
    assert s.count() == 2 * (60 - 24)
    first = s.filter(F.col("series_id") == "a").orderBy("ts").first()
    vals = df.filter(F.col("series_id") == "a").orderBy("ts").toPandas()["load_mw"].tolist()
    assert [x[0] for x in first["seq"]] == vals[:24] and first["y"] == vals[24]


def test_linear_fit_and_tree_forecast(spark):
    from gridcast.plans import features as PF
    h = history(spark, 400)
    f = PF.build_features(h, None)
    m = PM.fit("linear", f)
    coef, b0 = PM.linear_coefficients(m)
    assert set(coef) == set(PM.FEATURE_COLS)
    rf = PM.fit("rf", f, numTrees=5, maxDepth=4)
    fc = FC.forecast_model(rf, f, 8, checkpoint_every=3).toPandas()
    assert len(fc) == 16 and sorted(fc["step"].unique().tolist()) == list(range(1, 9))
    both = FC.forecast_models({"linear": m, "rf": rf}, f, 4).toPandas()
    assert sorted(both["model"].unique()) == ["linear", "rf"] and len(both) == 16


def test_linear_plan_equals_step_loop_with_all_features(spark):
    from gridcast.plans import features as PF
    f = PF.build_features(history(spark, 300), None)
    m = PM.fit("linear", f)
    coef, b0 = PM.linear_coefficients(m)
    a = FC.forecast_linear(f, coef, b0, 10).toPandas()
    b = FC.forecast_model(m, f, 10, checkpoint_every=5).toPandas()
    j = a.merge(b, on=["series_id", "step"])
    assert len(j) == len(a) == 20
    assert np.abs(j.forecast_mw_x - j.forecast_mw_y).max() < 1e-6
    assert (j.ts_x == j.ts_y).all()


def test_forecast_by_shown_name(spark):
    from gridcast.plans import features as PF
    f = PF.build_features(history(spark, 300), None)
    got = FC.forecast_models({"Linear Regression": PM.fit("linear", f)}, f, 3, display=True).toPandas()
    assert got["model"].unique().tolist() == ["Linear Regression"] and len(got) == 6


def test_seasonal_band_and_search(spark):
    from gridcast.plans import features as PF
    from gridcast.plans import search as SR
    from gridcast.plans import seasonal as SE
    f = PF.build_features(history(spark, 400), None)
    train = f.filter(F.col("ts") < F.lit("2024-03-15").cast("timestamp"))
    test = f.filter(F.col("ts") >= F.lit("2024-03-15").cast("timestamp"))
    coefs, tp, fp = SE.seasonal_regression(train, test, 12)
    p = tp.toPandas()
    assert len(p) == test.count()
    assert (p.yhat_lower <= p.yhat).all() and (p.yhat <= p.yhat_upper).all() and (p.yhat > 0).all()
    assert fp.count() == 2 * 12
    # a future frame takes one row of regressors, or one per series
    from gridcast.plans.report import future_frame
    means = test.groupBy("series_id").agg(F.avg("temp").alias("temp"))
    assert future_frame(test, 3, means).where("temp is null").count() == 0
    with pytest.raises(ValueError, match="one row"):
        future_frame(test, 3, means.drop("series_id"))
    space = dict(SR.SEARCH_SPACE, maxIter=("int", 2, 3), maxDepth=("int", 2, 3))
    best, scores, table, model = SR.walk_forward_search(spark, train, n_trials=2, n_splits=2, space=space)
    assert scores.count() == 4 and table.count() == 2
    drawn = SR.draw_candidates(2, 42, space)[table.first()["candidate"]]
    assert {**best, "maxIter": 0} == {**drawn, "maxIter": 0} and best["maxIter"] in (2, 3)
    run = SR.tuned_run(best, table, model, test).first()
    assert run["model"] == "xgboost" and float(run["params"]["cv_best_mae"]) == table.first()["cv_mae"]
    assert run["params"]["maxDepth"] == str(best["maxDepth"]) and run["metrics"]["mae"] > 0
    seasonal = SE.seasonal_run(tp).first()
    assert seasonal["model"] == "prophet" and seasonal["metrics"]["rmse"] >= seasonal["metrics"]["mae"]


def test_future_holiday_flags(spark):
    t0 = pd.Timestamp("2024-01-13 00:00")
    rows = [("a", t0 + pd.Timedelta(hours=i), 1.0) for i in range(48)]
    h = spark.createDataFrame(pd.DataFrame(rows, columns=["series_id", "ts", "load_mw"]))
    st = FC.history_state(h, 30).first()
    # history ends 2024-01-14 23:00; steps 1..24 fall on 2024-01-15 (a federal holiday)
    assert st["_hols"] == [1] * 24 + [0] * 6
    assert len(st["_h"]) == 48


def seasonal_history(spark, days, noise, series=("a", "b")):
    rng = np.random.default_rng(4)
    t0 = pd.Timestamp("2024-01-01")
    n = days * 24
    i = np.arange(n)
    rows = []
    for j, s in enumerate(series):
        temp = rng.normal(10, 5, n)
        y = (1000 * (j + 1) + 0.2 * i) * (1 + 0.3 * np.sin(2 * np.pi * i / 24) + 0.1 * np.cos(2 * np.pi * i / 168)
                                        + 0.01 * (temp - 10)) + rng.normal(0, noise, n)
        rows += [(s, t0 + pd.Timedelta(hours=int(k)), float(v), float(c), 60.0, 8.0) for k, v, c in zip(i, y, temp)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["series_id", "ts", "load_mw", "temp", "rhum", "wspd"]))


def test_seasonal_finds_the_pattern_and_its_band_holds(spark):
    from gridcast.plans import seasonal as SE
    h = seasonal_history(spark, 40, 30.0)
    cut = F.lit("2024-02-05").cast("timestamp")
    _, tp, fp = SE.seasonal_regression(h.where(F.col("ts") < cut), h.where(F.col("ts") >= cut), 72)
    p = tp.toPandas()
    for s, g in p.groupby("series_id"):
        assert (g.y - g.yhat).abs().mean() < 0.25 * (g.y - g.y.mean()).abs().mean()
        assert 0.6 < ((g.y >= g.yhat_lower) & (g.y <= g.yhat_upper)).mean() < 0.95
    f = fp.toPandas()
    assert len(f) == 144 and f.yhat.min() > 0.5 * p.y.min() and f.yhat.max() < 1.3 * p.y.max()


def test_seasonal_shrinks_what_the_data_does_not_show(spark):
    from gridcast.plans import seasonal as SE
    rng = np.random.default_rng(9)
    t0 = pd.Timestamp("2024-01-01")
    h = spark.createDataFrame(pd.DataFrame([("n", t0 + pd.Timedelta(hours=k), float(v)) for k, v in
                                            enumerate(rng.normal(500, 50, 24 * 20))], columns=["series_id", "ts", "load_mw"]))
    cut = F.lit("2024-01-15").cast("timestamp")
    train, test = h.where(F.col("ts") < cut), h.where(F.col("ts") >= cut)
    p = SE.predict_seasonal(test, SE.fit_seasonal(train, regressors=()), regressors=(), keep=["load_mw"]).toPandas()
    assert (p.load_mw - p.yhat).abs().mean() < 1.1 * (p.load_mw - 500).abs().mean()


def test_seasonal_awkward_series(spark):
    from gridcast.plans import seasonal as SE
    rows = [("one", "2024-01-01 00:00:00", 5.0), ("zero", "2024-01-01 00:00:00", 0.0), ("zero", "2024-01-01 01:00:00", 0.0),
            ("gap", "2024-01-01 00:00:00", None), ("gap", "2024-01-02 00:00:00", 3.0)]
    h = spark.createDataFrame(rows, "series_id string, ts string, load_mw double").withColumn("ts", F.col("ts").cast("timestamp"))
    p = SE.predict_seasonal(h, SE.fit_seasonal(h, regressors=()), regressors=()).toPandas()
    assert len(p) == 5 and np.isfinite(p.yhat).all()


def test_score_points_answers_every_request(spark):
    from gridcast.plans import features as PF
    from gridcast.plans import report as RP
    f = PF.build_features(history(spark, 300), None)
    models = {"linear": PM.fit("linear", f, ["lag_1h"]), "xgboost": PM.fit("linear", f, ["lag_24h"]), "rf": None}
    rq = spark.createDataFrame([(1, "2025-06-01 14:00", "linear"), (2, "2025-06-01 14:00", None), (3, "not_a_date", "linear"),
                                (4, "2025-06-01 14:00", "magic_model"), (5, None, "linear"), (6, "2025-06-01 14:00", "rf")],
                               "request_id int, datetime string, model string")
    got = {r["request_id"]: r for r in RP.score_points(rq, models).collect()}
    assert len(got) == 6
    want = {n: PM.linear_coefficients(models[n], c) for n, c in (("linear", ["lag_1h"]), ("xgboost", ["lag_24h"]))}
    for i, n in ((1, "linear"), (2, "xgboost")):
        coef, b0 = want[n]
        assert abs(got[i]["forecast_mw"] - (b0 + 32000.0 * sum(coef.values()))) < 1e-6
        assert got[i]["error"] is None and got[i]["model"] == n
    for i in (3, 4, 5, 6):
        assert got[i]["forecast_mw"] is None and got[i]["error"]
    assert "magic_model" in got[4]["error"] and "not_a_date" in got[3]["error"]


def test_permutation_importance_is_the_same_for_any_partitioning(spark):
    from gridcast.plans import features as PF
    f = PF.build_features(history(spark, 300), None)
    m = PM.fit("linear", f, ["lag_1h", "lag_24h"])
    cols = ["lag_1h", "lag_24h"]
    got = [{r["feature"]: r["importance"] for r in PM.permutation_importance(m, f.repartition(n), cols).collect()} for n in (1, 8, 211)]
    # the permutation itself, in one process
    p = f.toPandas()
    coef, b0 = PM.linear_coefficients(m, cols)
    name = p.series_id + "/" + (p.ts.astype("datetime64[us]").astype("int64")).astype(str)
    i, j = (np.argsort([hashlib.md5(f"{s}/{x}".encode()).hexdigest() for x in name]) for s in (PM.SEED, PM.SEED + 1))
    error = lambda d: (p.load_mw - b0 - sum(coef[c] * d[c] for c in cols)).abs().mean()
    for c in cols:
        d = p.copy()
        d.loc[d.index[i], c] = p[c].to_numpy()[j]
        assert all(abs(g[c] - (error(d) - error(p))) < 1e-9 for g in got)


def test_hash_rank_is_the_global_rank(spark, monkeypatch):
    from pyspark.sql import Window

    from gridcast.operators import ordered
    df = spark.range(3000).withColumn("h", F.md5(F.col("id").cast("string"))).withColumn("_before", F.lit(1))
    want = {r["id"]: r["n"] for r in df.withColumn("n", F.row_number().over(Window.orderBy("h"))).collect()}
    for rows in (1_000_000, 3):
        monkeypatch.setattr(ordered, "RANK_ROWS", rows)
        for n in (1, 8, 211):
            got = ordered.hash_rank(df.drop("_before").repartition(n), "h", "n")
            assert {r["id"]: r["n"] for r in got.collect()} == want
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    assert ordered.hash_rank(df.limit(0), "h", "n").collect() == []


@pytest.mark.parametrize("kind", ["rf", "xgboost"])
def test_flattened_trees_forecast_like_the_step_loop(spark, kind):
    from gridcast.plans import features as PF
    h = history(spark, 320).union(history(spark, 30, ("short",)))
    f = PF.build_features(h, None)
    m = PM.fit(kind, f, **({"numTrees": 7, "maxDepth": 8} if kind == "rf" else {"maxIter": 6, "maxDepth": 4}))
    a = FC.forecast_trees(m, h, 30).toPandas()
    b = FC.forecast_model(m, h, 30).toPandas()
    j = a.merge(b, on=["series_id", "step", "ts"])
    assert len(j) == len(a) == len(b) == 90
    assert np.abs(j.forecast_mw_x - j.forecast_mw_y).max() < 1e-9


def test_flattened_trees_of_one_leaf_and_the_limit(spark, monkeypatch):
    from gridcast.plans import features as PF
    h = history(spark, 200)
    f = PF.build_features(h, None)
    m = PM.fit("rf", f.withColumn("load_mw", F.lit(5.0)), numTrees=2, maxDepth=3)
    assert {r["forecast_mw"] for r in FC.forecast_trees(m, h, 3).collect()} == {5.0}
    monkeypatch.setattr(FC, "FLAT_NODES", 1)
    assert FC.flat_trees(m) is None and FC.forecast_trees(m, h, 2).count() == 4


def test_fit_queries_fit_though_a_model_is_kept(spark, monkeypatch):
    """``fit_boosted`` and ``train_all`` fit again, ``score_test`` does not."""
    from gridcast import queries_models as QM
    calls, plain = [], PM.fit
    monkeypatch.setattr(QM, "_FITTED", {})
    monkeypatch.setattr(PM, "fit", lambda name, train, *a, **k: calls.append(name) or plain("linear", train, ["lag_24h"]))
    frame = QM._features(spark, "/root/testdata/sf0.01")
    monkeypatch.setattr(QM, "_features", lambda spark, sf: frame)
    for name in PM.MODEL_NAMES:
        QM._fitted(spark, "/root/testdata/sf0.01", name)
    for query, fitted in ((QM.fit_boosted, ["xgboost"]), (QM.train_all, list(PM.MODEL_NAMES)), (QM.score_test, [])):
        calls.clear()
        query(spark, "/root/testdata/sf0.01")
        assert calls == fitted


def test_permutation_importance_of_all_features_plans_in_bounded_memory(spark):
    """Donors renamed above a hash of all columns made the planner keep 2 ** 22
    facts: the query ended for want of driver memory."""
    from gridcast.plans import features as PF
    f = PF.build_features(history(spark, 220), None).localCheckpoint()
    m = PM.fit("linear", f)
    got = {r["feature"]: r["importance"] for r in PM.permutation_importance(m, f).collect()}
    coef, _ = PM.linear_coefficients(m)
    assert set(got) == set(FEATURE_COLS) and max(got.values()) > 0
    assert all(abs(got[c]) < 1e-9 for c, b in coef.items() if b == 0.0)
