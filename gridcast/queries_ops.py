"""Registered queries, part 2: sources, projections, joins, windows,
scalars and report tables (with DuckDB oracles)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracle as S
from .functions import calendar as CAL
from .functions import scalar as SC
from .operators import joins as J
from .operators import metrics as M
from .operators import sequences as SEQ
from .operators import split as SP
from .operators import windows as W
from .plans import evaluate as PE
from .plans import features as PF
from .plans import report as RP
from .queries import _features, _preds, register
from .schema import FEATURE_COLS, TARGET
from .sources import fixtures as FX
from .session import kept, scratch_path
from .sources import load as LD
from .testing import stable

_PRED = S.predictions_sql()
_CAL_INT = ["hour", "day_of_week", "month", "quarter", "day_of_year", "week_of_year", "is_weekend"]


# --- sources: S1-S3 -------------------------------------------------------------

@register("read_load", f"""SELECT o_orderpriority AS series_id, CAST(o_orderdate AS TIMESTAMP) AS ts,
{S.rnd('o_totalprice', 'load_mw')} FROM orders WHERE o_orderdate IS NOT NULL""")
def read_load(spark, sf):
    return stable(LD.read_load(spark, f"{sf}/orders.parquet", fmt="parquet", time_col="o_orderdate",
                               value_col="o_totalprice", series_col="o_orderpriority", bad="drop"))


@register("read_weather", f"SELECT ts, {S.rnd('temp', 'temp')}, {S.rnd('rhum', 'rhum')}, {S.rnd('wspd', 'wspd')} FROM ({S.WEATHER}) w")
def read_weather(spark, sf):
    """Written as a CSV whose columns are in another order, read by name."""
    path = scratch_path(spark, "weather-csv")
    w = FX.weather(spark, sf)
    w.select("rhum", "wspd", F.col("ts").alias("Datetime"), "temp").write.option("header", True).csv(path)
    return kept(stable(LD.read_weather(spark, path)), path)


@register("read_load_csv", f"""SELECT o_orderpriority AS series_id, CAST(o_orderdate AS TIMESTAMP) AS ts,
{S.rnd('o_totalprice', 'load_mw')} FROM orders WHERE o_orderdate IS NOT NULL""")
def read_load_csv(spark, sf):
    """A headed CSV of all orders, columns swapped, one stamp unreadable per
    order without a date: read by name, malformed rows dropped."""
    path = scratch_path(spark, "load-csv")
    (FX.table(spark, sf, "orders").select("o_totalprice", "o_orderpriority", F.col("o_orderdate").cast("string").alias("o_orderdate"))
       .write.option("header", True).csv(path))
    return kept(stable(LD.read_load(spark, path, time_col="o_orderdate", value_col="o_totalprice",
                                    series_col="o_orderpriority", bad="drop")), path)


@register("constant_weather", f"SELECT series_id, ts, {S.rnd('load_mw', 'load_mw')}, CAST(10.0 AS DOUBLE) AS temp, CAST(60.0 AS DOUBLE) AS rhum, CAST(8.0 AS DOUBLE) AS wspd FROM ({S.DENSE}) d")
def constant_weather(spark, sf):
    return stable(LD.constant_weather(FX.dense_panel(spark, sf)))


@register("normalize_weather", f"""SELECT date_trunc('hour', ts) AS ts,
{S.rnd("avg(CASE WHEN event_type = 'view' THEN value END)", 'temp')},
{S.rnd("avg(CASE WHEN event_type = 'click' THEN value END)", 'rhum')},
CAST(NULL AS DOUBLE) AS wspd FROM events GROUP BY 1""")
def normalize_weather(spark, sf):
    return stable(LD.normalize_weather(FX.raw_weather(spark, sf)))


# --- projections: P4, P6, P7, P8 ---------------------------------------------------

@register("rename_ds_y", f"""WITH {S.features_sql()}
SELECT series_id, ts AS ds, {S.rnd('load_mw', 'y')}, {S.rnd('temp', 'temp')}, {S.rnd('rhum', 'rhum')}, {S.rnd('wspd', 'wspd')} FROM feat""")
def rename_ds_y(spark, sf):
    return stable(SC.rename_ds_y(_features(spark, sf, materialize=False)))


@register("slice_range", f"""SELECT series_id, ts, {S.rnd('load_mw', 'load_mw')} FROM ({S.DENSE}) d
WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 23:00:00'""")
def slice_range(spark, sf):
    return stable(SP.slice_range(FX.dense_panel(spark, sf), "2024-01-10", "2024-01-12", whole_last_day=True))


@register("slice_range_midnight", f"""SELECT series_id, ts, {S.rnd('load_mw', 'load_mw')} FROM ({S.DENSE}) d
WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'""")
def slice_range_midnight(spark, sf):
    return stable(SP.slice_range(FX.dense_panel(spark, sf), "2024-01-10", "2024-01-12", whole_last_day=False))


@register("future_frame", f"""WITH {S.features_sql()},
mx AS (SELECT series_id, max(ts) AS t FROM feat GROUP BY 1),
ex AS (SELECT avg(temp) AS temp, avg(rhum) AS rhum, avg(wspd) AS wspd FROM feat WHERE ts >= {S.CUTOFF}),
st AS (SELECT series_id, t, CAST(unnest(range(1, 73)) AS INTEGER) AS step FROM mx)
SELECT series_id, step, t + step * INTERVAL 1 HOUR AS ts, {S.rnd('temp', 'temp')}, {S.rnd('rhum', 'rhum')}, {S.rnd('wspd', 'wspd')}
FROM st CROSS JOIN ex""")
def future_frame(spark, sf):
    f = _features(spark, sf)
    _, test = SP.split_cutoff(f, FX.CUTOFF)
    return stable(RP.future_frame(f, 72, M.exog_means(test)))


@register("select_series", f"""WITH {_PRED}
SELECT series_id, ts, 'actual' AS series, {S.rnd('load_mw', 'value')} FROM feat
UNION ALL SELECT series_id, ts, model AS series, {S.rnd('p', 'value')} FROM preds WHERE model IN ('lag24')""")
def select_series(spark, sf):
    f = _features(spark, sf)
    return stable(RP.select_series(f, PE.lag_predictions(f), ["actual", "lag24"]))


# --- joins: J1, J3-J7 ----------------------------------------------------------------

@register("join_weather", f"""SELECT d.series_id, d.ts, {S.rnd('d.load_mw', 'load_mw')}, {S.rnd('w.temp', 'temp')},
{S.rnd('w.rhum', 'rhum')}, {S.rnd('w.wspd', 'wspd')} FROM ({S.DENSE}) d LEFT JOIN ({S.WEATHER}) w ON d.ts = w.ts""")
def join_weather(spark, sf):
    return stable(PF.join_weather(FX.dense_panel(spark, sf), FX.weather(spark, sf)))


@register("holiday_join", f"""WITH base AS ({S.DAILY_ORDERS}), {S.holidays_ctes('base')}
SELECT series_id, ts, {S.rnd('load_mw', 'load_mw')}, CAST(CASE WHEN hol.d IS NULL THEN 0 ELSE 1 END AS INTEGER) AS is_holiday
FROM base LEFT JOIN hol ON CAST(base.ts AS DATE) = hol.d""")
def holiday_join(spark, sf):
    return stable(CAL.add_is_holiday(FX.daily_orders(spark, sf)))


@register("semi_align", f"""WITH {_PRED}
SELECT model, series_id, ts, {S.rnd('y', 'y')}, {S.rnd('p', 'p')} FROM preds
WHERE (series_id, ts) IN (SELECT (series_id, ts) FROM feat
                          WHERE ts BETWEEN TIMESTAMP '2024-01-23 00:00:00' AND TIMESTAMP '2024-01-25 23:00:00')""")
def semi_align(spark, sf):
    f = _features(spark, sf)
    act = SP.slice_range(f, "2024-01-23", "2024-01-25", whole_last_day=True)
    return stable(J.semi_align(PE.lag_predictions(f), act))


@register("align_actual_pred", f"""WITH {_PRED},
a AS (SELECT series_id, ts, load_mw AS y, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn FROM feat
      WHERE ts >= {S.CUTOFF})
SELECT a.series_id, a.ts, {S.rnd('a.y', 'y')}, preds.model, {S.rnd('preds.p', 'p')}
FROM a JOIN preds ON a.series_id = preds.series_id AND a.ts = preds.ts WHERE a.rn > 24""")
def align_actual_pred(spark, sf):
    f = _features(spark, sf)
    _, test = SP.split_cutoff(f, FX.CUTOFF)
    p = PE.lag_predictions(f).select("model", "series_id", "ts", "p")
    return stable(J.align_actual_pred(test, p, skip_first=24))


@register("broadcast_stats", f"""WITH d AS ({S.DENSE}),
st AS (SELECT series_id, avg(load_mw) AS mean, stddev_samp(load_mw) AS std FROM d GROUP BY 1)
SELECT d.series_id, d.ts, {S.rnd('d.load_mw', 'load_mw')}, {S.rnd('st.mean', 'mean')}, {S.rnd('st.std', 'std')}
FROM d LEFT JOIN st ON d.series_id = st.series_id""")
def broadcast_stats(spark, sf):
    from .operators.clean import series_stats
    d = FX.dense_panel(spark, sf)
    return stable(J.attach_stats(d, series_stats(d)))


@register("upsert_metrics", f"""WITH {_PRED}, {S.metrics_cte(where='ts < ' + S.CUTOFF)},
{S.metrics_cte(name='mn', where="ts >= " + S.CUTOFF + " AND model = 'lag24'")}
SELECT model, {S.snapped_metrics()}, n FROM m WHERE model NOT IN (SELECT model FROM mn)
UNION ALL SELECT model, {S.snapped_metrics()}, n FROM mn""")
def upsert_metrics(spark, sf):
    p = _preds(spark, sf)
    old = M.evaluate_models(p.filter(F.col("ts") < F.lit(FX.CUTOFF).cast("timestamp")), rounded=False)
    new = M.evaluate_models(p.filter((F.col("ts") >= F.lit(FX.CUTOFF).cast("timestamp")) & (F.col("model") == "lag24")),
                            rounded=False)
    return stable(J.upsert_metrics(old, new))


# --- aggregates: A4, A12, A16 ---------------------------------------------------------

@register("load_kpis", f"""SELECT series_id, count(*) AS total_hours, {S.rnd('avg(load_mw)', 'avg_load')},
{S.rnd('max(load_mw)', 'peak_load')}, {S.rnd('min(load_mw)', 'min_load')} FROM ({S.DENSE}) d GROUP BY 1""")
def load_kpis(spark, sf):
    return stable(M.load_kpis(FX.dense_panel(spark, sf), by=["series_id"]))


@register("exog_means", f"""WITH {S.features_sql()}
SELECT {S.rnd('avg(temp)', 'temp')}, {S.rnd('avg(rhum)', 'rhum')}, {S.rnd('avg(wspd)', 'wspd')} FROM feat WHERE ts >= {S.CUTOFF}""")
def exog_means(spark, sf):
    _, test = SP.split_cutoff(_features(spark, sf, materialize=False), FX.CUTOFF)
    return stable(M.exog_means(test))


_MM_COLS = [*FEATURE_COLS, TARGET]


@register("minmax_fit", f"""WITH {S.features_sql()}
SELECT {', '.join(f"{S.rnd(f'min({c})', c + '_min')}, {S.rnd(f'max({c})', c + '_max')}" for c in _MM_COLS)}
FROM feat WHERE ts < {S.CUTOFF}""")
def minmax_fit(spark, sf):
    train, _ = SP.split_cutoff(_features(spark, sf, materialize=False), FX.CUTOFF)
    return stable(SEQ.minmax_fit(train, _MM_COLS).select(
        *[F.col(f"{c}_{s}").cast("double").alias(f"{c}_{s}") for c in _MM_COLS for s in ("min", "max")]))


def _mm_sql(inverse: bool) -> str:
    sel = []
    for c in _MM_COLS:
        lo, hi = f"s.{c}_min", f"s.{c}_max"
        rng = f"(CASE WHEN {hi} - {lo} = 0 THEN 1.0 ELSE {hi} - {lo} END)"
        x = f"((f.{c} - {lo}) / {rng})"
        if inverse:
            x = f"({x} * {rng} + {lo})"
        sel.append(S.rnd(x, c))
    return f"""WITH {S.features_sql()},
s AS (SELECT {', '.join(f'min({c}) AS {c}_min, max({c}) AS {c}_max' for c in _MM_COLS)} FROM feat WHERE ts < {S.CUTOFF})
SELECT f.series_id, f.ts, {', '.join(sel)} FROM feat f CROSS JOIN s"""


@register("minmax_transform", _mm_sql(False))
def minmax_transform(spark, sf):
    f = _features(spark, sf)
    train, _ = SP.split_cutoff(f, FX.CUTOFF)
    sc = SEQ.minmax_fit(train, _MM_COLS)
    return stable(SEQ.apply_minmax(f.select("series_id", "ts", *_MM_COLS), sc, _MM_COLS)
                  .select("series_id", "ts", *[F.col(c).cast("double").alias(c) for c in _MM_COLS]))


@register("minmax_inverse", _mm_sql(True))
def minmax_inverse(spark, sf):
    f = _features(spark, sf)
    train, _ = SP.split_cutoff(f, FX.CUTOFF)
    sc = SEQ.minmax_fit(train, _MM_COLS)
    scaled = SEQ.apply_minmax(f.select("series_id", "ts", *_MM_COLS), sc, _MM_COLS)
    return stable(SEQ.apply_minmax(scaled, sc, _MM_COLS, inverse=True)
                  .select("series_id", "ts", *[F.col(c).cast("double").alias(c) for c in _MM_COLS]))


# --- windows: W1-W5, W7, W9 -------------------------------------------------------------

@register("lag_features", f"""SELECT series_id, ts, {', '.join(S.rnd(f'lag(load_mw, {n}) OVER (PARTITION BY series_id ORDER BY ts)', f'lag_{n}h') for n in (1, 24, 168))}
FROM ({S.DENSE}) d""")
def lag_features(spark, sf):
    return stable(W.lag_features(FX.dense_panel(spark, sf)).drop("load_mw"))


def _roll_sql(src: str) -> str:
    out = []
    for n in (24, 168):
        fr = f"(PARTITION BY series_id ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        out.append(S.rnd(f"CASE WHEN count(load_mw) OVER {fr} = {n} THEN avg(load_mw) OVER {fr} END", f"rolling_mean_{n}h"))
    fr = "(PARTITION BY series_id ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"
    out.append(S.rnd(f"CASE WHEN count(load_mw) OVER {fr} = 24 THEN stddev_samp(load_mw) OVER {fr} END", "rolling_std_24h"))
    return f"SELECT series_id, ts, {', '.join(out)} FROM ({src}) d"


@register("rolling_features", _roll_sql(S.DENSE))
def rolling_features(spark, sf):
    return stable(W.rolling_features(FX.dense_panel(spark, sf)).drop("load_mw"))


@register("forward_fill", f"""WITH j AS (SELECT d.series_id, d.ts, w.temp, w.rhum, w.wspd FROM ({S.DENSE}) d LEFT JOIN ({S.WEATHER}) w ON d.ts = w.ts)
SELECT series_id, ts, {', '.join(S.rnd(f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))", c) for c in ('temp', 'rhum', 'wspd'))}
FROM j""")
def forward_fill(spark, sf):
    j = PF.join_weather(FX.dense_panel(spark, sf), FX.weather(spark, sf)).drop("load_mw")
    return stable(W.fill_gaps(j, ["temp", "rhum", "wspd"], backfill=True))


@register("forward_fill_only", f"""WITH j AS (SELECT d.series_id, d.ts, w.temp, w.rhum, w.wspd FROM ({S.DENSE}) d LEFT JOIN ({S.WEATHER}) w ON d.ts = w.ts)
SELECT series_id, ts, {', '.join(S.rnd(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", c) for c in ('temp', 'rhum', 'wspd'))}
FROM j""")
def forward_fill_only(spark, sf):
    j = PF.join_weather(FX.dense_panel(spark, sf), FX.weather(spark, sf)).drop("load_mw")
    return stable(W.fill_gaps(j, ["temp", "rhum", "wspd"], backfill=False))


@register("recent_window", f"""SELECT series_id, ts, {S.rnd('load_mw', 'load_mw')} FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rk FROM ({S.DENSE}) d) t WHERE rk <= 168""")
def recent_window(spark, sf):
    return stable(W.recent_window(FX.dense_panel(spark, sf), 168))


# sums of squares of two-decimal values often end on a rounding tie: moved off it on both sides
_OFF_TIES = 0.0000123


def _sequences_sql() -> str:
    fr = "(PARTITION BY series_id ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"
    sums = ", ".join(S.rnd(f"sum({c}) OVER {fr} + {_OFF_TIES}", f"{c}_sum", 4) for c in FEATURE_COLS)
    return f"""WITH {S.features_sql()},
s AS (SELECT series_id, ts, load_mw, count(*) OVER {fr} AS n, {sums},
        {S.rnd(f"first_value(lag_1h) OVER {fr}", 'first_lag_1h', 4)}, {S.rnd(f"last_value(hour_sin) OVER {fr}", 'last_hour_sin', 4)}
      FROM feat)
SELECT series_id, ts, CAST(n AS INTEGER) AS seq_len, first_lag_1h, last_hour_sin, {', '.join(f'{c}_sum' for c in FEATURE_COLS)},
       {S.rnd('load_mw', 'y', 4)} FROM s WHERE n = 24"""


def _column_sums(seq: str = "seq") -> list:
    """The sum of each feature over a sequence (compared column by column)."""
    def total(i: int):
        return F.aggregate(seq, F.lit(0.0), lambda a, r: a + r[i]) + F.lit(_OFF_TIES)
    return [total(i).alias(f"{c}_sum") for i, c in enumerate(FEATURE_COLS)]


@register("make_sequences", _sequences_sql())
def make_sequences(spark, sf):
    return _sequence_sums(SEQ.make_sequences(_features(spark, sf), 24, list(FEATURE_COLS)))


@register("compact_sequences", _sequences_sql())
def compact_sequences(spark, sf):
    return _sequence_sums(SEQ.expand_sequences(SEQ.compact_sequences(_features(spark, sf), 24, list(FEATURE_COLS)), 24))


def _sequence_sums(s):
    first, last = FEATURE_COLS.index("lag_1h"), FEATURE_COLS.index("hour_sin")
    return stable(s.select("series_id", "ts", F.size("seq").alias("seq_len"), F.col("seq")[0][first].alias("first_lag_1h"),
                           F.col("seq")[23][last].alias("last_hour_sin"), *_column_sums(), "y"), 4)


@register("sort_time", f"SELECT series_id, ts, {S.rnd('load_mw', 'load_mw')} FROM ({S.DENSE}) d ORDER BY ts, series_id")
def sort_time(spark, sf):
    return stable(FX.dense_panel(spark, sf).orderBy("ts", "series_id"))


# --- set operations: U1, U2 -------------------------------------------------------------

@register("append_history", f"""WITH {_PRED}
SELECT series_id, ts, {S.rnd('load_mw', 'load_mw')}, 'actual' AS kind FROM feat WHERE ts < {S.CUTOFF}
UNION ALL SELECT series_id, ts, {S.rnd('p', 'load_mw')}, 'predicted' AS kind FROM preds WHERE model = 'lag24' AND ts >= {S.CUTOFF}""")
def append_history(spark, sf):
    f = _features(spark, sf)
    cut = F.lit(FX.CUTOFF).cast("timestamp")
    hist = f.filter(F.col("ts") < cut).select("series_id", "ts", "load_mw", F.lit("actual").alias("kind"))
    pred = (PE.lag_predictions(f).filter((F.col("model") == "lag24") & (F.col("ts") >= cut))
            .select("series_id", "ts", F.col("p").alias("load_mw"), F.lit("predicted").alias("kind")))
    return stable(J.append_history(hist, pred))


@register("stack_predictions", f"WITH {_PRED} SELECT model, series_id, ts, {S.rnd('y', 'y')}, {S.rnd('p', 'p')} FROM preds")
def stack_predictions(spark, sf):
    return stable(_preds(spark, sf))


# --- scalar functions: F1-F4, F8-F11 -----------------------------------------------------

@register("calendar_features", f"""SELECT series_id, ts, {', '.join(S.calendar_select()[:7])} FROM ({S.DAILY_ORDERS}) d""")
def calendar_features(spark, sf):
    d = FX.daily_orders(spark, sf)
    return d.select("series_id", "ts", *[v.alias(k) for k, v in CAL.calendar_columns("ts").items()])


@register("is_weekend", f"SELECT series_id, ts, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend FROM ({S.DAILY_ORDERS}) d")
def is_weekend(spark, sf):
    return FX.daily_orders(spark, sf).select("series_id", "ts", CAL.calendar_columns("ts")["is_weekend"].alias("is_weekend"))


@register("cyclical_features", f"""SELECT series_id, ts, {', '.join(S.rnd(e.rsplit(' AS ', 1)[0], e.rsplit(' AS ', 1)[1]) for e in S.calendar_select()[7:])}
FROM ({S.DAILY_ORDERS}) d""")
def cyclical_features(spark, sf):
    d = CAL.add_calendar(FX.daily_orders(spark, sf))
    return stable(d.select("series_id", "ts", "hour_sin", "hour_cos", "month_sin", "month_cos"))


@register("weather_features", f"""WITH {S.features_sql()} SELECT series_id, ts, {S.rnd('temp_sq', 'temp_sq')} FROM feat""")
def weather_features(spark, sf):
    return stable(_features(spark, sf, materialize=False).select("series_id", "ts", "temp_sq"))


_REQ = """SELECT event_id AS request_id,
  CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN props ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS datetime,
  CASE event_type WHEN 'view' THEN 'xgboost' WHEN 'click' THEN 'rf' WHEN 'purchase' THEN 'linear'
    WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'xgboost' ELSE 'magic_model' END END AS model
FROM events"""


@register("parse_request_time", f"""SELECT request_id, datetime, model, TRY_CAST(datetime AS TIMESTAMP) AS ts,
CASE WHEN TRY_CAST(datetime AS TIMESTAMP) IS NULL THEN 'unreadable time ''' || coalesce(datetime, '') || '''' END AS error
FROM ({_REQ}) r""")
def parse_request_time(spark, sf):
    return SC.parse_request_time(FX.requests(spark, sf))


@register("format_output", f"""SELECT series_id, strftime(ts, '%Y-%m-%d %H:%M') AS datetime,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS api_datetime, round(load_mw, 2) AS forecast_mw,
  upper(substr(series_id, 1, 1)) || lower(substr(series_id, 2)) AS display_name
FROM ({S.DENSE}) d""")
def format_output(spark, sf):
    d = FX.dense_panel(spark, sf)
    return d.select("series_id", SC.format_timestamp(F.col("ts")).alias("datetime"),
                    SC.format_timestamp(F.col("ts"), seconds=True).alias("api_datetime"),
                    F.round("load_mw", 2).alias("forecast_mw"), F.initcap(F.col("series_id")).alias("display_name"))


@register("load_band", """SELECT o_orderkey, CASE WHEN o_totalprice >= 0 AND o_totalprice < 20000 THEN '0-20k'
  WHEN o_totalprice >= 20000 AND o_totalprice < 40000 THEN '20-40k'
  WHEN o_totalprice >= 40000 AND o_totalprice <= 60000 THEN '40-60k' END AS band FROM orders""")
def load_band(spark, sf):
    o = FX.table(spark, sf, "orders")
    return o.select("o_orderkey", SC.load_band(F.col("o_totalprice")).alias("band"))


@register("write_forecast", f"""WITH {_PRED}
SELECT model, series_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS datetime, round(p, 2) AS forecast_mw
FROM preds WHERE ts >= {S.CUTOFF}""")
def write_forecast(spark, sf):
    p = _preds(spark, sf).filter(F.col("ts") >= F.lit(FX.CUTOFF).cast("timestamp"))
    path = scratch_path(spark, "forecast-json")
    RP.write_forecast(p.withColumnRenamed("p", "forecast_mw"), path)
    return kept(RP.read_forecast(spark, path).select("model", "series_id", "datetime", "forecast_mw"), path)


@register("kpi_cards", f"""WITH k AS (SELECT series_id, count(*) AS total_hours, avg(load_mw) AS avg_load, max(load_mw) AS peak_load,
  min(load_mw) AS min_load FROM ({S.DENSE}) d GROUP BY 1)
SELECT series_id, total_hours, format('{{:,}}', total_hours) AS total_hours_text,
  format('{{:,.0f}}', avg_load) || ' MW' AS avg_load_text, format('{{:,.0f}}', peak_load) || ' MW' AS peak_load_text,
  format('{{:,.0f}}', min_load) || ' MW' AS min_load_text FROM k""")
def kpi_cards(spark, sf):
    return RP.kpi_cards(FX.dense_panel(spark, sf), by=["series_id"]).drop("avg_load", "peak_load", "min_load")


# --- P2 ---------------------------------------------------------------------------------

@register("drop_incomplete", f"""WITH {S.features_sql()} SELECT series_id, ts, {S.rounded_features()} FROM feat""")
def drop_incomplete(spark, sf):
    f = PF.build_features(FX.dense_panel(spark, sf), FX.weather(spark, sf), dropna=False)
    return stable(f.dropna(how="any"))


# --- T3: lags by time on the cleaned sparse panel ----------------------------------------

def _time_lag_sql() -> str:
    out = []
    for n in (1, 24, 168):
        fr = f"(PARTITION BY series_id ORDER BY ts RANGE BETWEEN INTERVAL {n} HOUR PRECEDING AND INTERVAL {n} HOUR PRECEDING)"
        out.append(S.rnd(f"first_value(load_mw) OVER {fr}", f"lag_{n}h"))
    for n in (24, 168):
        fr = f"(PARTITION BY series_id ORDER BY ts RANGE BETWEEN INTERVAL {n} HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING)"
        out.append(S.rnd(f"CASE WHEN count(load_mw) OVER {fr} = {n} THEN avg(load_mw) OVER {fr} END", f"rolling_mean_{n}h"))
    fr = "(PARTITION BY series_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING)"
    out.append(S.rnd(f"CASE WHEN count(load_mw) OVER {fr} = 24 THEN stddev_samp(load_mw) OVER {fr} END", "rolling_std_24h"))
    return f"WITH {S.clean_ctes(S.DENSE)} SELECT series_id, ts, {', '.join(out)} FROM cl"


@register("time_lag_features", _time_lag_sql())
def time_lag_features(spark, sf):
    from .operators.clean import regularize
    clean = regularize(FX.dense_panel(spark, sf)).drop("outlier_flag")
    return stable(W.time_lag_features(clean, chunk_hours=200).drop("load_mw"))


@register("build_features_time", f"WITH {S.features_sql(load='SELECT series_id, ts, load_mw FROM cl')} SELECT series_id, ts, {S.rounded_features()} FROM feat".replace("WITH \nbase AS", f"WITH {S.clean_ctes(S.DENSE)},\nbase AS"))
def build_features_time(spark, sf):
    from .operators.clean import regularize
    clean = regularize(FX.dense_panel(spark, sf)).drop("outlier_flag")
    f = PF.build_features(clean, FX.weather(spark, sf), lag_mode="time", chunk_hours=200)
    return stable(f)
