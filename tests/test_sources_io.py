"""Sources and persistence: CSV load, missing weather, metrics documents,
model save / load, run records."""

import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridcast.operators import metrics as M
from gridcast.plans import models as PM
from gridcast.sources import load as LD
from gridcast.sources import metrics_io as MIO
from gridcast.sources import runs as RU


def test_read_load_csv_and_missing_weather(spark):
    d = tempfile.mkdtemp(prefix="gridcast-csv-")
    p = os.path.join(d, "load.csv")
    pd.DataFrame({"Datetime": ["2024-01-01 00:00:00", "2024-01-01 01:00:00", "bad"],
                  "PJME_MW": [1.5, 2.5, 3.0]}).to_csv(p, index=False)
    with pytest.raises(Exception, match="malformed load row"):
        LD.read_load(spark, p).collect()
    assert [r["Datetime"] for r in LD.rejected_load(spark, p).collect()] == ["bad"]
    df = LD.read_load(spark, p, bad="drop").orderBy("ts").toPandas()
    assert df["series_id"].tolist() == ["PJME_MW"] * 2 and df["load_mw"].tolist() == [1.5, 2.5]
    assert LD.read_weather(spark, os.path.join(d, "absent.csv")) is None
    w = os.path.join(d, "weather.csv")
    pd.DataFrame({"Datetime": ["2024-01-01 00:00:00"], "temp": [3.0], "rhum": [None], "wspd": [4.0]}).to_csv(w, index=False)
    got = LD.read_weather(spark, w).first()
    assert got["temp"] == 3.0 and got["rhum"] is None and got["wspd"] == 4.0


def test_normalize_adds_absent_columns(spark):
    raw = spark.createDataFrame(pd.DataFrame({"time": pd.to_datetime(["2024-01-01"]), "temp": [1.0], "pres": [1000.0]}))
    out = LD.normalize_weather(raw)
    assert out.columns == ["ts", "temp", "rhum", "wspd"]
    r = out.first()
    assert r["temp"] == 1.0 and r["rhum"] is None and r["wspd"] is None


def _metrics(spark):
    return spark.createDataFrame([("rf", 306.6, 430.0, 0.97, 0.9952), ("linear", 784.4, 1050.0, 2.5, 0.9731)],
                                 "model string, mae double, rmse double, mape double, r2 double")


def test_metrics_json_csv_and_source(spark):
    d = tempfile.mkdtemp(prefix="gridcast-metrics-")
    met = _metrics(spark)
    doc = MIO.metrics_document(met).first()["metrics_json"]
    assert doc.startswith('{"linear":{"MAE":784.4') and '"rf":{"MAE":306.6' in doc
    jp, cp = os.path.join(d, "metrics.json"), os.path.join(d, "metrics.csv")
    src = MIO.metrics_source(spark, jp, cp)
    assert src.count() == 0 and src.columns[-1] == "source"
    MIO.write_metrics_csv(M.leaderboard(met), cp)
    from_csv = MIO.metrics_source(spark, jp, cp).orderBy("model").toPandas()
    assert from_csv["source"].iloc[0] == cp and from_csv["mae"].tolist() == [784.4, 306.6]
    MIO.write_metrics_json(met, jp)
    from_json = MIO.metrics_source(spark, jp, cp).orderBy("model").toPandas()
    assert from_json["source"].iloc[0] == jp and from_json["r2"].tolist() == [0.9731, 0.9952]
    new = spark.createDataFrame([("rf", 300.0, 420.0, 0.9, 0.996), ("xgboost", 260.0, 370.0, 0.82, 0.996)],
                                "model string, mae double, rmse double, mape double, r2 double")
    merged = MIO.upsert_metrics_json(spark, new, jp)
    got = {r["model"]: r["mae"] for r in MIO.read_metrics_json(spark, jp).collect()}
    assert got == {"linear": 784.4, "rf": 300.0, "xgboost": 260.0} and merged.count() == 3


def test_model_save_load_and_missing(spark):
    d = tempfile.mkdtemp(prefix="gridcast-model-")
    df = spark.createDataFrame(pd.DataFrame({"a": [1.0, 2.0, 3.0, 4.0], "load_mw": [2.0, 4.1, 5.9, 8.0]}))
    m = PM.fit("linear", df, ["a"])
    PM.save_model(m, os.path.join(d, "linear"))
    back = PM.load_model(spark, os.path.join(d, "linear"))
    a = m.transform(df).select("prediction").toPandas()
    b = back.transform(df).select("prediction").toPandas()
    assert a.equals(b)
    with pytest.raises(FileNotFoundError):
        PM.load_model(spark, os.path.join(d, "rf"))
    ms = PM.load_models(spark, d)
    assert ms["rf"] is None and ms["xgboost"] is None and ms["linear"] is not None


def test_runs_listing(spark):
    d = tempfile.mkdtemp(prefix="gridcast-runs-")
    runs = RU.run_records(_metrics(spark).withColumn("nm", F.when(F.col("model") == "rf", F.lit("forest-1"))),
                          "exp", {"seed": 42}, name_col="nm")
    RU.log_runs(runs, d)
    RU.log_runs(runs, d)
    lst = RU.list_runs(RU.read_runs(spark, d)).toPandas()
    assert len(lst) == 4
    names = set(lst["name"])
    assert "forest-1" in names and any(len(n) == 8 for n in names)
    assert set(lst["status"]) == {"FINISHED"}


def test_csv_columns_by_name(spark, tmp_path):
    w = tmp_path / "w.csv"
    w.write_text("Datetime,rhum,temp,wspd\n2024-01-01 00:00:00,60,10,8\n")
    got = LD.read_weather(spark, str(w)).first()
    assert (got["temp"], got["rhum"], got["wspd"]) == (10.0, 60.0, 8.0)
    p = tmp_path / "p.csv"
    p.write_text("PJME_MW,zone,Datetime\n5.5,x,2024-01-01 00:00:00\n,y,2024-01-01 01:00:00\n")
    rows = [tuple(r) for r in LD.read_load(spark, str(p), series_col="zone").select("series_id", "load_mw").orderBy("ts").collect()]
    assert rows == [("x", 5.5), ("y", None)]
    with pytest.raises(ValueError, match="no column AEP_MW"):
        LD.read_load(spark, str(p), value_col="AEP_MW")
    m = tmp_path / "m.csv"
    m.write_text("R2,MAE (MW),Model,RMSE (MW),MAPE (%)\n0.9,1.239,XGBoost,2.0,3.0\n")
    r = MIO.read_metrics_csv(spark, str(m)).first()
    assert (r["model"], r["mae"], r["r2"]) == ("xgboost", 1.24, 0.9)


def test_forecast_records_round_trip(spark, tmp_path):
    from gridcast.plans import report as RP
    fc = spark.createDataFrame([("a", 1, pd.Timestamp("2024-01-01 05:00:00").to_pydatetime(), 1.2367)], "series_id string, step int, ts timestamp, forecast_mw double")
    for fmt, stamp, v in (("json", "2024-01-01 05:00:00", 1.24), ("csv", "2024-01-01 05:00", 1.2)):
        RP.write_forecast(fc, str(tmp_path / fmt), fmt)
        r = RP.read_forecast(spark, str(tmp_path / fmt), fmt).first()
        assert (r["series_id"], r["datetime"], r["forecast_mw"]) == ("a", stamp, v)
