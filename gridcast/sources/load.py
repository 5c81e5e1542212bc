"""Series and weather sources.

Columns by name, no inference pass over 100 TB, no global sort:
order is re-established per series by the ordered operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from ..schema import WEATHER_DEFAULTS

WEATHER_COLS = ("temp", "rhum", "wspd")


def read_named(spark: SparkSession, path: str, fmt: str, needed: tuple[str, ...]) -> DataFrame:
    """A table whose columns are taken by name.  A headed CSV is read as text
    in its header's order (no inference pass); a missing column is an error."""
    df = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df


def _stamp(df: DataFrame, time_col: str, timestamp_format: str | None):
    c = F.col(time_col)
    if dict(df.dtypes)[time_col] == "string" and timestamp_format:
        return F.try_to_timestamp(c, F.lit(timestamp_format))
    return c.try_cast("timestamp")


def _load_columns(df: DataFrame, time_col, value_col, series_col, series_id, timestamp_format):
    sid = F.col(series_col).cast("string") if series_col else F.lit(series_id or value_col)
    return sid, _stamp(df, time_col, timestamp_format), F.col(value_col).try_cast("double")


def read_load(spark: SparkSession, path: str, fmt: str = "csv", time_col: str = "Datetime",
              value_col: str = "PJME_MW", series_col: str | None = None, series_id: str | None = None,
              timestamp_format: str | None = None, bad: str = "fail") -> DataFrame:
    """Hourly load → ``series_id, ts, load_mw``; columns by name.

    A single-series file gets ``series_id`` as a literal (default: the value
    column's name); a panel file names its ``series_col``.  ``bad``: a stamp
    that is missing or malformed, or a malformed number, fails the job
    ("fail"), or drops its row ("drop"; :func:`rejected_load` lists them)."""
    if bad not in ("fail", "drop"):
        raise ValueError("bad is 'fail' or 'drop'")
    df = read_named(spark, path, fmt, (time_col, value_col, *([series_col] if series_col else [])))
    sid, ts, value = _load_columns(df, time_col, value_col, series_col, series_id, timestamp_format)
    wrong = ts.isNull() | (value.isNull() & F.col(value_col).isNotNull())
    if bad == "drop":
        df = df.where(~wrong)
    else:
        told = F.concat(F.lit("malformed load row: "), F.to_json(F.struct(F.col(time_col).cast("string").alias(time_col),
                                                                          F.col(value_col).cast("string").alias(value_col))))
        ts = F.when(wrong, F.raise_error(told).cast("timestamp")).otherwise(ts)
    return df.select(sid.alias("series_id"), ts.alias("ts"), value.alias("load_mw"))


def rejected_load(spark: SparkSession, path: str, fmt: str = "csv", time_col: str = "Datetime",
                  value_col: str = "PJME_MW", timestamp_format: str | None = None) -> DataFrame:
    """The rows that :func:`read_load` drops with ``bad="drop"``, as read."""
    df = read_named(spark, path, fmt, (time_col, value_col))
    _, ts, value = _load_columns(df, time_col, value_col, None, None, timestamp_format)
    return df.where(ts.isNull() | (value.isNull() & F.col(value_col).isNotNull()))


def normalize_weather(raw: DataFrame, time_col: str = "time",
                      keep: tuple[str, ...] = WEATHER_COLS) -> DataFrame:
    """S3: keep the time and weather columns; an absent weather column
    becomes a typed null column; the time column is renamed ``ts``."""
    cols = [F.col(time_col).try_cast("timestamp").alias("ts")]
    for c in keep:
        cols.append(F.col(c).try_cast("double").alias(c) if c in raw.columns
                    else F.lit(None).cast("double").alias(c))
    return raw.select(*cols)


def read_weather(spark: SparkSession, path: str | None, fmt: str = "csv",
                 time_col: str = "Datetime") -> DataFrame | None:
    """Weather table ``ts, temp, rhum, wspd`` or ``None`` when the
    source does not exist (the feature builder then uses the constants).
    Columns by name; an absent weather column becomes nulls."""
    if path is None:
        return None
    try:
        raw = read_named(spark, path, fmt, (time_col,))
    except Exception as exc:  # missing path → constants
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return None
        raise
    return normalize_weather(raw, time_col)


def constant_weather(df: DataFrame) -> DataFrame:
    """S2 fallback: attach the fixed weather constants to every row."""
    return df.withColumns({c: F.lit(v).cast("double") for c, v in WEATHER_DEFAULTS.items()})
