"""Cleaning equals an independent pandas statement of the same rules."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridcast.operators import clean as C


def pandas_clean(pdf: pd.DataFrame) -> pd.DataFrame:
    """The documented rules written in pandas for one series."""
    s = pdf.sort_values("ts").set_index("ts")["load_mw"]
    s = s.groupby(level=0).mean()
    grid = pd.date_range(s.index.min(), s.index.max(), freq="h")
    s = s.reindex(grid).interpolate(method="time", limit=6)
    mu, sd = s.mean(), s.std()
    z = (s - mu) / sd
    flag = (z.abs() > 5).astype(int)
    s = s.clip(lower=mu - 5 * sd, upper=mu + 5 * sd)
    out = pd.DataFrame({"ts": s.index, "load_mw": s.values, "outlier_flag": flag.values}).dropna(subset=["load_mw"])
    return out.reset_index(drop=True)


def series(hours, values, start="2024-01-01"):
    t0 = pd.Timestamp(start)
    return pd.DataFrame({"series_id": "a", "ts": [t0 + pd.Timedelta(hours=h) for h in hours], "load_mw": values})


def run(spark, pdf):
    df = spark.createDataFrame(pdf, "series_id string, ts timestamp, load_mw double")
    got = C.regularize(df).toPandas().sort_values("ts").reset_index(drop=True)
    return got


CASES = {
    "gap6": series([0, 1, 2, 9, 10, 11], [10.0, 11, 12, 20, 21, 22]),
    "gap7": series([0, 1, 2, 10, 11], [10.0, 11, 12, 20, 21]),
    "gap20": series(list(range(5)) + list(range(25, 30)), [float(i) for i in range(10)]),
    "dups": series([0, 0, 1, 2, 2, 2, 3], [1.0, 3, 5, 6, 7, 8, 9]),
    "spike": series(list(range(400)), [100.0 + (i % 7) for i in range(399)] + [100000.0]),
    "constant": series(list(range(30)), [5.0] * 30),
    "offgrid": pd.concat([series([0, 1, 2, 3], [1.0, 2, 3, 4]),
                          series([0], [99.0], start="2024-01-01 01:30")]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_regularize_matches_pandas(spark, name):
    pdf = CASES[name]
    got = run(spark, pdf)
    exp = pandas_clean(pdf)
    assert got["ts"].tolist() == [t.to_pydatetime() for t in exp["ts"]] or list(got["ts"]) == list(exp["ts"])
    assert np.allclose(got["load_mw"].to_numpy(float), exp["load_mw"].to_numpy(float), atol=1e-9)
    assert got["outlier_flag"].tolist() == exp["outlier_flag"].tolist()


def test_spike_is_flagged_and_clipped(spark):
    got = run(spark, CASES["spike"])
    assert got["outlier_flag"].sum() == 1
    assert got["load_mw"].max() < 100000.0


def test_empty(spark):
    df = spark.createDataFrame([], "series_id string, ts timestamp, load_mw double")
    assert C.regularize(df).count() == 0


def test_grid_interpolation_equals_sparse_fill(spark):
    pdf = pd.concat([CASES["gap20"], CASES["gap7"].assign(series_id="b")])
    df = spark.createDataFrame(pdf, "series_id string, ts timestamp, load_mw double")
    grid = C.interpolate_gaps(C.reindex_hourly(C.dedupe_mean(df))).filter(F.col("load_mw").isNotNull())
    fill = C.fill_series(df)
    a = grid.toPandas().sort_values(["series_id", "ts"]).reset_index(drop=True)
    b = fill.toPandas().sort_values(["series_id", "ts"]).reset_index(drop=True)
    assert len(a) == len(b)
    assert np.allclose(a["load_mw"], b["load_mw"])


def test_fixture_counts(spark):
    from gridcast.sources import fixtures as FX
    from tests.conftest import SF01
    out = C.regularize(FX.sparse_panel(spark, SF01))
    assert out.count() == 50721
    assert out.agg(F.sum("outlier_flag")).first()[0] == 52


def test_one_row_series(spark):
    got = run(spark, series([0], [42.0]))
    assert got["load_mw"].tolist() == [42.0] and got["outlier_flag"].tolist() == [0]


def test_repartitioning_does_not_change_results(spark):
    from gridcast.sources import fixtures as FX
    from tests.conftest import SF01
    src = FX.sparse_panel(spark, SF01)
    a = C.regularize(src).toPandas().sort_values(["series_id", "ts"]).reset_index(drop=True)
    b = C.regularize(src.repartition(13, "ts")).toPandas().sort_values(["series_id", "ts"]).reset_index(drop=True)
    assert a[["series_id", "ts", "outlier_flag"]].equals(b[["series_id", "ts", "outlier_flag"]])
    assert np.allclose(a["load_mw"], b["load_mw"], rtol=0, atol=1e-9)


def test_no_row_shuffle_by_series_alone(spark):
    """What is exchanged by series alone are aggregates (partial sums, block
    summaries), never rows."""
    import re
    from pyspark.sql import functions as F
    from gridcast.operators import clean as C
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("series_id"),
                                  F.timestamp_seconds(F.col("id") * 3600 + 1700000000).alias("ts"),
                                  F.col("id").cast("double").alias("load_mw"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (C.fill_series(df), C.regularize(df, materialize=False), C.interpolate_gaps(C.reindex_hourly(df))):
            plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
            found = [plan[n + 1] for n, line in enumerate(plan)
                     if re.search(r"Exchange hashpartitioning\(series_id#\d+, \d+\)", line)]
            assert found and all("Aggregate(" in below for below in found), found
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
