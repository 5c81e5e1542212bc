"""Chunk + halo windows equal plain per-series windows."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridcast.operators import ordered as O
from gridcast.operators import windows as W
from gridcast.plans import features as PF
from gridcast.sources import fixtures as FX
from tests.conftest import SF01


def test_positions_match_row_number(spark):
    d = FX.dense_panel(spark, SF01)
    got = O.with_positions(d, ["series_id"], "ts", block_hours=5)
    ref = d.withColumn("rn", F.row_number().over(Window.partitionBy("series_id").orderBy("ts")) - 1)
    j = got.join(ref, ["series_id", "ts"])
    assert j.filter(F.col("_pos") != F.col("rn")).count() == 0
    assert j.count() == d.count()


def test_halo_lags_equal_plain_window(spark):
    d = FX.dense_panel(spark, SF01)
    small = W.lag_features(d, chunk_rows=200).join(
        W.rolling_features(d, chunk_rows=200).drop("load_mw"), ["series_id", "ts"])
    w = Window.partitionBy("series_id").orderBy("ts")
    ref = d.select("series_id", "ts",
                   *[F.lag("load_mw", n).over(w).alias(f"r_lag_{n}h") for n in (1, 24, 168)],
                   F.when(F.count("load_mw").over(w.rowsBetween(-24, -1)) == 24,
                          F.avg("load_mw").over(w.rowsBetween(-24, -1))).alias("r_mean24"),
                   F.when(F.count("load_mw").over(w.rowsBetween(-24, -1)) == 24,
                          F.stddev_samp("load_mw").over(w.rowsBetween(-24, -1))).alias("r_std24"))
    pdf = small.join(ref, ["series_id", "ts"]).toPandas()
    assert len(pdf) == d.count()
    for a, b in [("lag_1h", "r_lag_1h"), ("lag_24h", "r_lag_24h"), ("lag_168h", "r_lag_168h"),
                 ("rolling_mean_24h", "r_mean24"), ("rolling_std_24h", "r_std24")]:
        x, y = pdf[a].to_numpy(dtype=float), pdf[b].to_numpy(dtype=float)
        assert np.array_equal(np.isnan(x), np.isnan(y))
        assert np.nanmax(np.abs(x - y)) < 1e-9


def test_chunked_features_equal_unchunked(spark):
    load, wx = FX.dense_panel(spark, SF01), FX.weather(spark, SF01)
    a = PF.build_features(load, wx, chunk_rows=300).toPandas().sort_values(["series_id", "ts"])
    b = PF.build_features(load, wx).toPandas().sort_values(["series_id", "ts"])
    assert len(a) == len(b) > 0
    num = a.select_dtypes("number").columns
    assert np.nanmax(np.abs(a[num].to_numpy(float) - b[num].to_numpy(float))) < 1e-9


def test_fill_over_long_gaps(spark):
    rows = [("s", i, (float(i) if i in (3, 250) else None)) for i in range(600)]
    df = spark.createDataFrame(rows, "series_id string, h int, v double") \
        .withColumn("ts", F.timestamp_seconds(F.col("h") * 3600))
    out = W.fill_gaps(df, ["v"]).orderBy("h").toPandas()
    exp = [3.0] * 4 + [3.0] * (250 - 4) + [250.0] * (600 - 250)
    assert out["v"].tolist() == exp
