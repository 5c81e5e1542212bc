"""DuckDB SQL fragments that state each operator independently, for the
oracle check (tables are views named after the parquet files).

Doubles are compared after ``round(x, 6)`` on both sides: the two engines
sum in different orders and differ around 1e-13; the stand-in inputs have
two decimals, so 6-digit rounding does not meet ties on window means.
"""

from __future__ import annotations

from .schema import FEATURE_COLS, INT_FEATURES

R = 6  # digits kept for doubles in oracle comparisons

DENSE = ("SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, sum(value) AS load_mw "
         "FROM events GROUP BY 1, 2")
SPARSE = ("SELECT CAST(user_id AS VARCHAR) AS series_id, date_trunc('hour', ts) AS ts, sum(value) AS load_mw "
          "FROM events GROUP BY 1, 2")
DUP = "SELECT CAST(user_id AS VARCHAR) AS series_id, date_trunc('hour', ts) AS ts, value AS load_mw FROM events"
OFFGRID = ("SELECT CAST(user_id AS VARCHAR) AS series_id, date_trunc('minute', ts) AS ts, value AS load_mw "
           "FROM events")
WEATHER = ("SELECT date_trunc('hour', ts) AS ts, "
           "avg(CASE WHEN event_type = 'view' THEN value END) AS temp, "
           "avg(CASE WHEN event_type = 'click' THEN value END) AS rhum, "
           "avg(CASE WHEN event_type = 'signup' THEN value END) AS wspd FROM events GROUP BY 1")
DAILY_ORDERS = ("SELECT 'orders' AS series_id, CAST(o_orderdate AS TIMESTAMP) AS ts, "
                "sum(o_totalprice) AS load_mw FROM orders GROUP BY 2")
CUTOFF = "TIMESTAMP '2024-01-22 00:00:00'"


def snap(expr: str, digits: int = R) -> str:
    scale = f"{10 ** digits}.0"
    return f"(floor(({expr}) * {scale} + 0.5) / {scale})"


def rnd(expr: str, alias: str, digits: int = R) -> str:
    return f"{snap(expr, digits)} AS {alias}"


def _first_dow(y: str, m: int, isodow: int) -> str:
    d = f"make_date({y}, {m}, 1)"
    return f"({d} + CAST((({isodow} - isodow({d})) + 7) % 7 AS INTEGER))"


def holidays_ctes(base: str) -> str:
    """CTEs ``hy`` (years) and ``hol`` (distinct holiday dates ``d``) for the
    years of ``base.ts`` plus one."""
    mon = lambda m, n: f"({_first_dow('y', m, 1)} + {7 * (n - 1)})"
    thu = lambda m, n: f"({_first_dow('y', m, 4)} + {7 * (n - 1)})"
    may25 = "make_date(y, 5, 25)"
    memorial = f"({may25} + CAST(((1 - isodow({may25})) + 7) % 7 AS INTEGER))"
    return f"""
hy AS (SELECT CAST(range AS INTEGER) AS y FROM range(
        (SELECT min(year(ts)) FROM {base}), (SELECT max(year(ts)) FROM {base}) + 2)),
hfix AS (
  SELECT make_date(y, 1, 1) AS d FROM hy
  UNION ALL SELECT make_date(y, 6, 19) FROM hy WHERE y >= 2021
  UNION ALL SELECT make_date(y, 7, 4) FROM hy
  UNION ALL SELECT CASE WHEN y BETWEEN 1971 AND 1977 THEN {mon(10, 4)} ELSE make_date(y, 11, 11) END FROM hy
  UNION ALL SELECT make_date(y, 12, 25) FROM hy),
hol AS (SELECT DISTINCT d FROM (
  SELECT d FROM hfix
  UNION ALL SELECT CASE isodow(d) WHEN 6 THEN d - 1 WHEN 7 THEN d + 1 END FROM hfix
  UNION ALL SELECT {mon(1, 3)} FROM hy WHERE y >= 1986
  UNION ALL SELECT {mon(2, 3)} FROM hy
  UNION ALL SELECT {memorial} FROM hy
  UNION ALL SELECT {mon(9, 1)} FROM hy
  UNION ALL SELECT {mon(10, 2)} FROM hy
  UNION ALL SELECT {thu(11, 4)} FROM hy) t WHERE d IS NOT NULL)"""


def calendar_select(ts: str = "ts") -> list[str]:
    two_pi = "(2 * pi())"
    return [
        f"CAST(hour({ts}) AS INTEGER) AS hour",
        f"CAST(isodow({ts}) - 1 AS INTEGER) AS day_of_week",
        f"CAST(month({ts}) AS INTEGER) AS month",
        f"CAST(quarter({ts}) AS INTEGER) AS quarter",
        f"CAST(dayofyear({ts}) AS INTEGER) AS day_of_year",
        f"CAST(weekofyear({ts}) AS INTEGER) AS week_of_year",
        f"CAST(isodow({ts}) >= 6 AS INTEGER) AS is_weekend",
        f"sin({two_pi} * hour({ts}) / 24.0) AS hour_sin",
        f"cos({two_pi} * hour({ts}) / 24.0) AS hour_cos",
        f"sin({two_pi} * month({ts}) / 12.0) AS month_sin",
        f"cos({two_pi} * month({ts}) / 12.0) AS month_cos",
    ]


def _w(frame: str = "") -> str:
    return f"(PARTITION BY series_id ORDER BY ts {frame})"


def lag_select(value: str = "load_mw") -> list[str]:
    out = [f"lag({value}, {n}) OVER {_w()} AS lag_{n}h" for n in (1, 24, 168)]
    for n in (24, 168):
        fr = _w(f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING")
        out.append(f"CASE WHEN count({value}) OVER {fr} = {n} THEN avg({value}) OVER {fr} END AS rolling_mean_{n}h")
    fr = _w("ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING")
    out.append(f"CASE WHEN count({value}) OVER {fr} = 24 THEN stddev_samp({value}) OVER {fr} END AS rolling_std_24h")
    return out


def features_sql(load: str = DENSE, weather: str | None = WEATHER) -> str:
    """M2 as one statement: CTE ``feat`` with keys, ts, 22 features, load_mw
    (unrounded).  Callers select from ``feat``."""
    if weather is None:
        fill = "CAST(10.0 AS DOUBLE) AS temp, CAST(60.0 AS DOUBLE) AS rhum, CAST(8.0 AS DOUBLE) AS wspd"
        joined = "SELECT series_id, ts, load_mw FROM base"
    else:
        up = _w("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
        down = _w("ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING")
        fill = ", ".join(
            f"coalesce(last_value({c} IGNORE NULLS) OVER {up}, first_value({c} IGNORE NULLS) OVER {down}) AS {c}"
            for c in ("temp", "rhum", "wspd"))
        joined = ("SELECT b.series_id, b.ts, b.load_mw, w.temp, w.rhum, w.wspd "
                  "FROM base b LEFT JOIN wx w ON b.ts = w.ts")
    wx = f"wx AS ({weather})," if weather is not None else ""
    cal = ",\n    ".join(calendar_select())
    lags = ",\n    ".join(lag_select())
    cols = ", ".join(FEATURE_COLS)
    not_null = " AND ".join(f"{c} IS NOT NULL" for c in [*FEATURE_COLS, "load_mw"])
    return f"""
base AS ({load}),
{wx}
{holidays_ctes('base')},
j AS ({joined}),
f AS (SELECT series_id, ts, load_mw, {fill} FROM j),
fg AS (SELECT f.*,
    {cal},
    CAST(CASE WHEN hol.d IS NULL THEN 0 ELSE 1 END AS INTEGER) AS is_holiday,
    {lags},
    temp * temp AS temp_sq
  FROM f LEFT JOIN hol ON CAST(f.ts AS DATE) = hol.d),
feat AS (SELECT series_id, ts, {cols}, load_mw FROM fg WHERE {not_null})"""


def rounded_features(prefix: str = "") -> str:
    """Select list of ``feat`` columns with doubles rounded."""
    out = []
    for c in FEATURE_COLS:
        out.append(f"{prefix}{c}" if c in INT_FEATURES else rnd(f"{prefix}{c}", c))
    out.append(rnd(f"{prefix}load_mw", "load_mw"))
    return ", ".join(out)


def predictions_sql() -> str:
    """CTE ``preds``: (model, series_id, ts, y, p) from lag_24h / lag_168h."""
    return (features_sql() + """,
preds AS (
  SELECT 'lag24' AS model, series_id, ts, load_mw AS y, lag_24h AS p FROM feat
  UNION ALL
  SELECT 'lag168' AS model, series_id, ts, load_mw AS y, lag_168h AS p FROM feat)""")


def clean_ctes(src: str) -> str:
    """M1 stated on the full grid, as the reference does it: ``d`` dedupe,
    ``b`` bounds, ``g`` grid ⟕ data, ``k`` grid with fills (``iv``),
    ``i`` filled rows only (``v``), ``st`` per-series mean / std."""
    up = _w("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    down = _w("ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING")
    return f"""
d AS (SELECT series_id, ts, avg(load_mw) AS v FROM ({src}) s WHERE ts IS NOT NULL GROUP BY 1, 2),
b AS (SELECT series_id, min(ts) AS t0, max(ts) AS t1 FROM d GROUP BY 1),
grid AS (SELECT series_id, unnest(generate_series(t0, t1, INTERVAL 1 HOUR)) AS ts FROM b),
g AS (SELECT grid.series_id, grid.ts, d.v FROM grid LEFT JOIN d ON grid.series_id = d.series_id AND grid.ts = d.ts),
k0 AS (SELECT series_id, ts, v,
    last_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER {up} AS pt,
    last_value(v IGNORE NULLS) OVER {up} AS pv,
    first_value(CASE WHEN v IS NOT NULL THEN ts END IGNORE NULLS) OVER {down} AS nt,
    first_value(v IGNORE NULLS) OVER {down} AS nv
  FROM g),
k AS (SELECT series_id, ts, CASE
    WHEN v IS NOT NULL THEN v
    WHEN pt IS NULL THEN NULL
    WHEN epoch(ts - pt) / 3600 > 6 THEN NULL
    WHEN nt IS NULL THEN pv
    ELSE pv + (nv - pv) * epoch(ts - pt) / epoch(nt - pt) END AS iv
  FROM k0),
i AS (SELECT series_id, ts, iv AS v FROM k WHERE iv IS NOT NULL),
st AS (SELECT series_id, avg(v) AS mu, stddev_samp(v) AS sd FROM i GROUP BY 1),
cl AS (SELECT i.series_id, i.ts,
    CASE WHEN st.sd IS NULL OR st.sd = 0 THEN i.v
         ELSE least(greatest(i.v, st.mu - 5 * st.sd), st.mu + 5 * st.sd) END AS load_mw,
    CAST(CASE WHEN st.sd IS NOT NULL AND st.sd <> 0 AND abs((i.v - st.mu) / st.sd) > 5 THEN 1 ELSE 0 END AS INTEGER)
      AS outlier_flag
  FROM i JOIN st ON i.series_id = st.series_id)"""


def metric_exprs(y: str = "y", p: str = "p") -> dict[str, str]:
    e = f"({y} - {p})"
    sst = f"(var_pop({y}) * count({y}))"
    sse = f"sum({e} * {e})"
    return {
        "mae": f"avg(abs({e}))",
        "rmse": f"sqrt(avg({e} * {e}))",
        "mape": f"avg(CASE WHEN {y} <> 0 THEN abs({e} / {y}) END) * 100.0",
        "r2": f"CASE WHEN {sst} = 0 THEN CASE WHEN {sse} = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 - {sse} / {sst} END",
    }


def metrics_cte(src: str = "preds", name: str = "m", where: str = "TRUE") -> str:
    """CTE ``name``: unrounded model metrics over ``src``."""
    ex = metric_exprs()
    cols = ", ".join(f"{v} AS {k}" for k, v in ex.items())
    return (f"{name} AS (SELECT model, {cols}, count(*) AS n FROM {src} "
            f"WHERE y IS NOT NULL AND p IS NOT NULL AND ({where}) GROUP BY model)")


def snapped_metrics(prefix: str = "") -> str:
    return ", ".join(rnd(f"{prefix}{k}", k) for k in ("mae", "rmse", "mape", "r2"))
