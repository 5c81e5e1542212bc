"""Driver contract and a sample of SQL oracles at sf0.001."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from tests.conftest import SF001

SAMPLE = ["build_features", "regularize", "regularize_duplicates", "quality_report", "evaluate_models",
          "walk_forward_folds", "holiday_join", "forward_fill", "residual_histogram", "make_sequences", "compact_sequences",
          "cold_start_features", "future_frame", "forecast_users", "seasonal_trend"]


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "lag_168h" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 80


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else float(v)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=repr)


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle_sample(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    a = _rows(E.queries()[name](spark, SF001).toPandas())
    b = _rows(con.execute(E.oracle_sql()[name]).df())
    assert a[0] == b[0]
    assert a[1] == b[1]
