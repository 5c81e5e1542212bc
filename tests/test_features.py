"""Feature contract, no look-ahead, calendar and holidays."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridcast.functions import calendar as CAL
from gridcast.plans import features as PF
from gridcast.schema import FEATURE_COLS, FEATURE_SCHEMA
from gridcast.sources import fixtures as FX
from tests.conftest import SF01


def test_contract(spark):
    f = PF.select_features(PF.build_features(FX.dense_panel(spark, SF01), FX.weather(spark, SF01)))
    assert f.columns == [*FEATURE_COLS, "load_mw"]
    assert [x.dataType for x in f.schema.fields] == [x.dataType for x in FEATURE_SCHEMA.fields]
    assert len(FEATURE_COLS) == 22


def test_no_future_leak(spark):
    load = FX.dense_panel(spark, SF01)
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp")
    perturbed = load.withColumn("load_mw", F.when(F.col("ts") >= cut, F.col("load_mw") * 7 + 1000)
                                .otherwise(F.col("load_mw")))
    a = PF.build_features(load, None).filter(F.col("ts") < F.lit("2024-01-20 00:00:00").cast("timestamp"))
    b = PF.build_features(perturbed, None).filter(F.col("ts") < F.lit("2024-01-20 00:00:00").cast("timestamp"))
    cols = [c for c in FEATURE_COLS]
    pa = a.toPandas().sort_values(["series_id", "ts"])[cols].to_numpy(float)
    pb = b.toPandas().sort_values(["series_id", "ts"])[cols].to_numpy(float)
    assert pa.shape == pb.shape and np.allclose(pa, pb)
    # the first perturbed hour's lag_1h must see the old value, not the new one
    c = PF.build_features(perturbed, None).filter(F.col("ts") >= cut)
    assert c.count() > 0


def test_constant_weather_when_absent(spark):
    f = PF.build_features(FX.dense_panel(spark, SF01), None)
    row = f.agg(F.min("temp"), F.max("temp"), F.min("rhum"), F.min("wspd"), F.max("temp_sq")).first()
    assert tuple(row) == (10.0, 10.0, 60.0, 8.0, 100.0)


def test_calendar_matches_pandas(spark):
    days = pd.date_range("2000-12-25", periods=4000, freq="D") + pd.Timedelta(hours=13)
    df = spark.createDataFrame(pd.DataFrame({"ts": days}))
    got = CAL.add_calendar(df).toPandas().sort_values("ts").reset_index(drop=True)
    idx = pd.DatetimeIndex(got["ts"])
    assert (got["hour"] == idx.hour).all()
    assert (got["day_of_week"] == idx.dayofweek).all()
    assert (got["month"] == idx.month).all()
    assert (got["quarter"] == idx.quarter).all()
    assert (got["day_of_year"] == idx.dayofyear).all()
    assert (got["week_of_year"] == idx.isocalendar().week.to_numpy()).all()
    assert (got["is_weekend"] == (idx.dayofweek >= 5).astype(int)).all()
    assert np.allclose(got["hour_sin"], np.sin(2 * np.pi * idx.hour / 24))
    assert np.allclose(got["month_cos"], np.cos(2 * np.pi * idx.month / 12))


def test_holiday_edges(spark):
    dim = {r["holiday_date"] for r in CAL.holiday_dimension(spark).collect()}
    for d in ["2010-12-31", "2011-01-01", "2021-06-18", "2021-06-19", "2021-07-05", "2022-12-26",
              "2024-01-15", "2024-05-27", "2024-11-28", "1976-10-25", "2020-06-19"]:
        want = d != "2020-06-19"
        assert (dt.date.fromisoformat(d) in dim) == want, d
    # pandas' federal calendar: every observed date present, no extra weekday
    from pandas.tseries.holiday import USFederalHolidayCalendar
    ref = {x.date() for x in USFederalHolidayCalendar().holidays("1996-01-01", "2020-12-31")}
    ours = {d for d in dim if dt.date(1996, 1, 1) <= d <= dt.date(2020, 12, 31)}
    assert ref - ours == set()
    assert {d for d in ours - ref if d.weekday() < 5} == set()


def test_holiday_expression_equals_dimension(spark):
    days = spark.sql("SELECT explode(sequence(DATE'1971-01-01', DATE'2100-12-31', INTERVAL 1 DAY)) AS d")
    dim = CAL.holiday_dimension(spark).select(F.col("holiday_date").alias("d"), F.lit(True).alias("in_dim"))
    j = days.join(F.broadcast(dim), "d", "left").select(
        "d", F.coalesce("in_dim", F.lit(False)).alias("a"), CAL.is_holiday_expr(F.col("d")).alias("b"))
    assert j.filter(F.col("a") != F.col("b")).count() == 0
    assert j.filter("a").count() > 1500


def test_holiday_join_variant_equals_expression(spark):
    from gridcast.sources import fixtures as FX
    d = FX.daily_orders(spark, SF01)
    a = CAL.add_is_holiday(d).select("ts", F.col("is_holiday").alias("a"))
    b = CAL.add_is_holiday(d, holidays=CAL.holiday_dimension(spark)).select("ts", F.col("is_holiday").alias("b"))
    j = a.join(b, "ts")
    assert j.count() == d.count() and j.filter(F.col("a") != F.col("b")).count() == 0
