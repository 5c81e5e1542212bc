"""Rolling statistics joined from blocks, and sequences stored without copies."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridcast.operators import ordered as O
from gridcast.operators import sequences as SEQ
from gridcast.operators import windows as W

SIZES = [1, 2, 3, 4, 5, 16, 23, 24, 64, 85, 168]


def series(n: int, level: float, seed: int = 5) -> pd.DataFrame:
    """Steps on a high level, a constant stretch and a few nulls."""
    rng = np.random.default_rng(seed)
    y = level + rng.normal(0, 50, n).cumsum()
    y[n // 3:n // 3 + 200] = level
    v = pd.Series(y)
    v[rng.integers(0, n, 3)] = np.nan
    return pd.DataFrame({"ts": pd.date_range("2021-01-01", periods=n, freq="h"), "load_mw": v})


def frame(spark, parts: dict):
    rows = [(k, r.ts.to_pydatetime(), None if np.isnan(r.load_mw) else float(r.load_mw)) for k, p in parts.items() for r in p.itertuples()]
    return spark.createDataFrame(rows, "series_id string, ts timestamp, load_mw double")


def same(got: np.ndarray, want: np.ndarray, tolerance: float) -> None:
    assert np.array_equal(np.isnan(got), np.isnan(want))
    both = ~np.isnan(got)
    assert both.any() and np.abs(got[both] - want[both]).max() < tolerance


@pytest.mark.parametrize("chunk_rows", [200, 1 << 20])
def test_rolling_equals_a_plain_loop_on_a_high_level(spark, chunk_rows):
    parts = {"a": series(900, 1e6), "b": series(700, 1e3, 6), "short": series(10, 5.0)[:3]}
    got = W.rolling_features(frame(spark, parts), means=SIZES, stds=SIZES, chunk_rows=chunk_rows).toPandas()
    for k in ("a", "b"):
        g, p = got[got.series_id == k].sort_values("ts"), parts[k]["load_mw"]
        assert len(g) == len(p)
        v = p.to_numpy()
        for n in SIZES:
            frames = [v[max(0, i - n):i] for i in range(len(v))]
            full = [len(f) == n and not np.isnan(f).any() for f in frames]
            same(g[f"rolling_mean_{n}h"].to_numpy(float), np.array([f.mean() if ok else np.nan for f, ok in zip(frames, full)]), 1e-6)
            if n == 1:
                assert g["rolling_std_1h"].isna().all()
            else:
                same(g[f"rolling_std_{n}h"].to_numpy(float), np.array([f.std(ddof=1) if ok else np.nan for f, ok in zip(frames, full)]), 1e-6)
    assert got[got.series_id == "short"]["rolling_mean_4h"].isna().all()


def test_a_constant_stretch_has_no_deviation(spark):
    p = series(900, 1e6)
    p["load_mw"] = p["load_mw"].fillna(1e6)
    p.loc[300:499, "load_mw"] = 1e6 + 0.1
    g = W.rolling_features(frame(spark, {"a": p}), means=[24], stds=[24, 168]).toPandas().sort_values("ts")
    assert g["rolling_std_24h"].to_numpy()[324:500].max() < 1e-8
    assert g["rolling_std_168h"].to_numpy()[468:500].max() < 1e-8


def test_time_mode_needs_every_hour(spark):
    p = series(600, 1e4).drop(index=[100, 101, 350])  # hours that are absent
    got = W.time_lag_features(frame(spark, {"a": p}), means=[24, 168], stds=[24], chunk_hours=200).toPandas().sort_values("ts")
    v = p.set_index("ts")["load_mw"].reindex(pd.date_range("2021-01-01", periods=600, freq="h"))
    before = v.shift(1)
    want = pd.DataFrame({"rolling_mean_24h": before.rolling(24).mean(), "rolling_mean_168h": before.rolling(168).mean(),
                         "rolling_std_24h": before.rolling(24).std(), "lag_24h": v.shift(24)}).loc[p["ts"]]
    for c in want.columns:
        same(got[c].to_numpy(float), want[c].to_numpy(float), 1e-6)


def test_rolling_plan_has_no_sliding_sums(spark):
    d = O.with_halo(O.with_positions(frame(spark, {"a": series(50, 1.0)}), ["series_id"]), lookback=168)
    w = O.chunk_window(["series_id"])
    plan = W.add_rolling(d, w)._jdf.queryExecution().executedPlan().toString()
    lags = d.withColumns(W.lag_columns(w))._jdf.queryExecution().executedPlan().toString()
    assert "avg(" not in plan and "stddev" not in plan
    assert plan.count("Exchange hashpartitioning") == lags.count("Exchange hashpartitioning")
    assert plan.count("Sort [") == lags.count("Sort [")


def test_empty_table_and_bad_sizes(spark):
    empty = frame(spark, {"a": series(900, 1.0)}).where("false")
    assert W.rolling_features(empty).count() == 0
    assert SEQ.expand_sequences(SEQ.compact_sequences(empty, 24, ["load_mw"]), 24).count() == 0
    with pytest.raises(ValueError):
        W.rolling_features(empty, means=[0], stds=[])


def rows_of(df):
    return sorted((r["series_id"], r["ts"], [tuple(x) for x in r["seq"]], r["y"]) for r in df.collect())


@pytest.mark.parametrize("seq_len,chunk_rows", [(1, 1), (24, 50), (24, 1024), (168, 1024)])
def test_expansion_equals_make_sequences(spark, seq_len, chunk_rows):
    parts = {"a": series(1500, 1e4), "b": series(400, 10.0, 7), "short": series(30, 5.0)[:20]}
    d = frame(spark, parts).fillna(0.0).withColumn("c", F.hour("ts"))
    compact = SEQ.compact_sequences(d, seq_len, ["load_mw", "c"], chunk_rows=chunk_rows)
    want = rows_of(SEQ.make_sequences(d, seq_len, ["load_mw", "c"]))
    assert len(want) == sum(max(0, len(p) - seq_len) for p in parts.values())
    assert rows_of(SEQ.expand_sequences(compact, seq_len)) == want
    size = compact.agg(F.max(F.size("matrix"))).first()[0]
    assert size <= seq_len + max(chunk_rows, 8 * seq_len)


def test_written_sequences_are_about_the_size_of_the_input(spark, tmp_path):
    d = frame(spark, {"a": series(4000, 1e4), "b": series(4000, 10.0, 7)}).fillna(0.0)
    cols = [f"c{i}" for i in range(20)]
    d = d.withColumns({c: F.pmod(F.xxhash64("series_id", "ts", F.lit(i)), F.lit(1 << 50)) / F.lit(1 << 50) for i, c in enumerate(cols)})
    train, test = d.where("ts < '2021-05-01'"), d.where("ts >= '2021-05-01'")

    def written(path):
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, fs in os.walk(path) for f in fs)

    _, tr, te = SEQ.sequence_dataset(train, test, 24, cols, path=str(tmp_path / "set"))
    train.write.parquet(str(tmp_path / "in"))
    assert written(tmp_path / "set" / "train") < 1.2 * written(tmp_path / "in")
    held = spark.read.parquet(str(tmp_path / "set" / "train")).agg(F.sum(F.size("matrix"))).first()[0]
    copied = SEQ.make_sequences(train, 24, cols).agg(F.sum(F.size("seq"))).first()[0]
    assert held < 1.05 * train.count() and copied > 20 * held
    _, tr2, te2 = SEQ.sequence_dataset(train, test, 24, cols)
    assert rows_of(tr) == rows_of(tr2) and rows_of(te) == rows_of(te2)
