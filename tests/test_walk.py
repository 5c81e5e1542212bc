"""Tree ensembles walked by batches of rows."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridcast.plans import models as PM
from gridcast.plans import report as RP
from gridcast.plans import walk as WA
from gridcast.schema import FEATURE_COLS


@pytest.fixture(scope="module")
def fitted(spark):
    r = np.random.default_rng(3)
    n = 400
    x = pd.DataFrame({c: r.normal(20, 12, n) for c in FEATURE_COLS})
    x["hour"], x["day_of_week"], x["temp"] = r.integers(0, 24, n), r.integers(0, 7, n), r.normal(10, 6, n)
    df = spark.createDataFrame(x.assign(load_mw=100 * x.hour - 30 * x.day_of_week + 9 * x.temp, series_id="s",
                                        ts=[pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i) for i in range(n)]))
    return df, {"linear": PM.fit("linear", df), "rf": PM.fit("rf", df, numTrees=9, maxDepth=12),
                "xgboost": PM.fit("xgboost", df, maxIter=12, maxDepth=5)}


def test_walked_is_what_transform_gives(fitted):
    df, models = fitted
    x = df.toPandas()
    for n in ("rf", "xgboost"):
        w = WA.walker(models[n])
        want = models[n].transform(df).orderBy("ts").toPandas()["prediction"]
        table = x.sort_values("ts")[w.cols].to_numpy().T
        assert np.allclose(w(table), want, rtol=0, atol=1e-9)
        assert np.array_equal(w(np.tile(table, 30))[-400:], w(table)) and len(w(table[:, :0])) == 0
    assert WA.walker(models["linear"]) is None


def test_score_points_walks_all_ensembles_in_one_pass(spark, fitted):
    _, models = fitted
    names = ["rf", "xgboost", "linear", None, "magic"]
    rq = spark.range(500).select(
        F.col("id").alias("request_id"),
        F.when(F.col("id") % 50 == 49, "no time").otherwise(F.date_format(F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(id * 7 as int))"),
                                                                          "yyyy-MM-dd HH:mm")).alias("datetime"),
        F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("id") % 5 + 1).cast("int")).alias("model"),
        (F.col("id") % 40).cast("double").alias("temp"))
    out = RP.score_points(rq, models)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r["request_id"]: r for r in out.collect()}
    asked = rq.withColumn("model", F.coalesce("model", F.lit("xgboost")))
    feats = RP.cold_start_features(asked).where("error is null")
    assert len(got) == 500
    seen = 0
    for n, m in models.items():
        for r in m.transform(feats.where(F.col("model") == n)).collect():
            assert abs(got[r["request_id"]]["forecast_mw"] - r["prediction"]) < 1e-8 and got[r["request_id"]]["ts"] == r["ts"]
            seen += 1
    assert seen == sum(r["error"] is None for r in got.values()) > 300


def test_a_missing_feature_is_an_error(spark, fitted):
    df, models = fitted
    rows = df.limit(5).withColumn("m", F.lit("rf")).withColumn("temp", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="missing feature"):
        WA.walked_rows(rows, {"rf": WA.walker(models["rf"])}, "m", ["ts"], "p").collect()


def test_splits_on_features_of_one_value_are_decided_once(fitted, monkeypatch):
    df, models = fitted
    rows = df.toPandas()
    for n in ("rf", "xgboost"):
        w = WA.walker(models[n])
        table = rows[w.cols].to_numpy().T
        wanted = WA.walker(models[n])
        one = [i for i, c in enumerate(w.cols) if c != "hour"]
        batches = [table.copy() for _ in range(4)]
        batches[1][one] = batches[1][one, :1]
        batches[2][one] = batches[2][one, 7:8]  # other values: not the trees of the batch before
        batches[3][:] = batches[3][:, 5:6]
        with monkeypatch.context() as m:
            m.setattr(WA, "NARROW_ROWS", 10 ** 9)
            want = [wanted(x) for x in batches]
        assert all(np.array_equal(w(x), p) for x, p in zip(batches, want, strict=True))
        assert w._trees(batches[0])[2] == w.depth and max(w._trees(batches[3])[2]) == 0
        assert sum(w._trees(batches[1])[2]) < sum(w.depth)


def test_models_of_a_query_are_fitted_on_one_frame(spark, monkeypatch):
    from gridcast import queries_models as QM
    sf, built, plain = "/root/testdata/sf0.01", [], PM.fit
    frame = QM._features(spark, sf)
    monkeypatch.setattr(QM, "_features", lambda spark, sf: built.append(sf) or frame)
    monkeypatch.setattr(PM, "fit", lambda name, train, *a, **k: plain("linear", train, ["lag_24h"]))
    for query in (QM.score_points, QM.score_test, QM.forecast_models):
        monkeypatch.setattr(QM, "_FITTED", {})
        built.clear()
        query(spark, sf)
        assert built == [sf]


def test_stages_too_large_for_the_jvm_to_compile_run_in_parts(spark, capsys):
    from gridcast import queries as Q
    from gridcast.session import HUGE_METHOD
    from gridcast.sources import fixtures as FX
    s = spark.newSession()
    s.conf.unset(HUGE_METHOD[0])
    RP.cold_start_features(FX.requests(s, "/root/testdata/sf0.01")).explain("codegen")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out))) > 8000  # the reason for the setting
    Q.ensure_compiled(s)
    assert s.conf.get(HUGE_METHOD[0]) == "8000"
    s.conf.set(HUGE_METHOD[0], "6000")
    Q.ensure_compiled(s)
    assert s.conf.get(HUGE_METHOD[0]) == "6000"
