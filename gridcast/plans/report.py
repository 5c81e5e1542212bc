"""Report tables replacing the dashboard pages (A4, P7, P8, S8, F9-F11,
M12's feature side).  Each is a DataFrame; nothing is served or drawn."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import add_calendar, add_is_holiday
from ..functions.scalar import format_mw, format_timestamp, parse_request_time
from ..operators.metrics import load_kpis
from ..schema import COLD_LOAD_MEAN, COLD_LOAD_STD, DEFAULT_MODEL, FEATURE_COLS, KEYS, TS, WEATHER_DEFAULTS
from .walk import walked_rows, walker


def kpi_cards(df: DataFrame, value: str = "load_mw", by: Sequence[str] = ()) -> DataFrame:
    """A4 + F9: the four KPI cards as numbers and as display strings."""
    k = load_kpis(df, value, by)
    return k.select(*by, "total_hours", "avg_load", "peak_load", "min_load",
                    F.format_number("total_hours", 0).alias("total_hours_text"),
                    format_mw(F.col("avg_load")).alias("avg_load_text"),
                    format_mw(F.col("peak_load")).alias("peak_load_text"),
                    format_mw(F.col("min_load")).alias("min_load_text"))


def future_frame(df: DataFrame, hours: int, regressors: DataFrame | None = None,
                 keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """The next ``hours`` hourly stamps after each series' last stamp,
    with regressor values held at ``regressors``: a table with the key columns
    (one row per series, joined) or a single row for all series; more rows
    without keys are an error."""
    keys = list(keys)
    last = df.groupBy(*keys).agg(F.max(ts).alias("_last"))
    fut = last.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(hours))).alias("step"), "_last")
    fut = fut.select(*keys, "step", F.timestamp_add("HOUR", F.col("step"), F.col("_last")).alias(ts))
    if regressors is not None:
        if set(keys) <= set(regressors.columns):
            return fut.join(regressors, keys, "left")
        rows = regressors.limit(2).collect()
        if len(rows) != 1:
            raise ValueError("regressors without the key columns must be one row")
        fut = fut.withColumns({c: F.lit(rows[0][c]).cast(t) for c, t in regressors.dtypes})
    return fut


def select_series(actual: DataFrame, preds: DataFrame, selected: Sequence[str],
                  keys: Sequence[str] = KEYS, ts: str = TS, value: str = "load_mw") -> DataFrame:
    """Actual and model predictions as one long table ``keys, ts,
    series, value``, keeping only the selected series names ('actual' or a
    model name).  Filters are pushed into each side before the union."""
    sel = list(selected)
    parts = []
    if "actual" in sel:
        parts.append(actual.select(*keys, ts, F.lit("actual").alias("series"), F.col(value).alias("value")))
    models = [s for s in sel if s != "actual"]
    if models:
        parts.append(preds.filter(F.col("model").isin(models))
                          .select(*keys, ts, F.col("model").alias("series"), F.col("p").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def forecast_records(fc: DataFrame, api: bool = True, ts: str = TS, value: str = "forecast_mw") -> DataFrame:
    """Forecast rows as records — API style (seconds, 2 decimals) or
    table style (minutes, 1 decimal)."""
    return fc.withColumn("datetime", format_timestamp(F.col(ts), seconds=api)) \
             .withColumn(value, F.round(F.col(value), 2 if api else 1))


def write_forecast(fc: DataFrame, path: str, fmt: str = "json", ts: str = TS, value: str = "forecast_mw") -> None:
    """Write forecast records, JSON lines (API style) or headed CSV
    (table style)."""
    recs = forecast_records(fc, fmt == "json", ts, value).drop(ts)
    w = recs.write.mode("overwrite")
    w.json(path) if fmt == "json" else w.option("header", True).csv(path)


def read_forecast(spark, path: str, fmt: str = "json", value: str = "forecast_mw") -> DataFrame:
    """Forecast records back, ``datetime`` as written and ``value`` as a
    number; the other columns are text in a CSV."""
    df = spark.read.json(path) if fmt == "json" else spark.read.option("header", True).csv(path)
    return df.withColumn(value, F.col(value).cast("double"))


def score_points(requests: DataFrame, models, col: str = "datetime", model_col: str = "model") -> DataFrame:
    """Each request scored by the model it names (none: the default).
    ``request columns, ts, error, forecast_mw``: an unparsable time or a model
    that is unknown or not fitted gives a row with its reason and no number."""
    names = [n for n, m in models.items() if m is not None]
    asked = requests.withColumn(model_col, F.coalesce(model_col, F.lit(DEFAULT_MODEL)))
    feats = cold_start_features(asked, col=col)
    unknown = F.when(~F.col(model_col).isin(names), F.concat(
        F.lit("no model named '"), F.col(model_col), F.lit("'; known: " + ", ".join(names))))
    feats = feats.withColumn("error", F.coalesce("error", unknown))
    kept = [*asked.columns, "ts", "error"]
    out = feats.where(F.col("error").isNotNull()).select(*kept, F.lit(None).cast("double").alias("forecast_mw"))
    asked_of = F.col("error").isNull()
    walkers = {n: w for n in names if (w := walker(models[n]))}
    if walkers:  # all tree ensembles in one pass
        out = out.unionByName(walked_rows(feats.where(asked_of & F.col(model_col).isin(list(walkers))), walkers, model_col, kept, "forecast_mw"))
    for n in [n for n in names if n not in walkers]:
        mine = feats.where(asked_of & (F.col(model_col) == n))
        out = out.unionByName(models[n].transform(mine).select(*kept, F.col("prediction").alias("forecast_mw")))
    return out


def cold_start_features(requests: DataFrame, weather: dict | None = None, col: str = "datetime") -> DataFrame:
    """A feature row for arbitrary times without history.  Lags and
    rolling means take the population stand-in (32,000 MW), the rolling std
    6,500 MW; weather columns in the request win over the defaults (the
    reference drops user weather, T15).  Unparsable times keep an ``error``
    and null features."""
    d = parse_request_time(requests, col, "ts")
    d = add_calendar(d, "ts")
    d = add_is_holiday(d, "ts")
    d = d.withColumn("is_holiday", F.when(F.col("ts").isNotNull(), F.col("is_holiday")))
    lag_cols = {c: F.lit(COLD_LOAD_MEAN) for c in
                ("lag_1h", "lag_24h", "lag_168h", "rolling_mean_24h", "rolling_mean_168h")}
    lag_cols["rolling_std_24h"] = F.lit(COLD_LOAD_STD)
    d = d.withColumns({c: F.when(F.col("ts").isNotNull(), v) for c, v in lag_cols.items()})
    defaults = dict(WEATHER_DEFAULTS, **(weather or {}))
    wx = {c: F.when(F.col("ts").isNotNull(),
                    F.coalesce(F.col(c).cast("double"), F.lit(v)) if c in requests.columns else F.lit(v))
          for c, v in defaults.items()}
    d = d.withColumns(wx).withColumn("temp_sq", F.col("temp") * F.col("temp"))
    return d.select(*[c for c in requests.columns if c not in FEATURE_COLS], "ts", "error", *FEATURE_COLS)
