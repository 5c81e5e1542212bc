"""Registered queries, part 3: models, scoring, explanation, forecasts,
search, seasonal regression and persistence.

Models are fitted with the operators' own settings (200 trees, 500 rounds).
``fit_*`` queries and ``train_all`` fit; scoring and forecasting queries share
one fitted model per session and input, as an application would load it from its store.  Only the search draws
fewer candidates and rounds than its operator's defaults (``SEARCH_TRIALS``,
``SEARCH_ROUNDS``): the full search is hundreds of fits.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracle as S
from .functions import scalar as SC
from .operators import metrics as M
from .operators import sequences as SEQ
from .operators import split as SP
from .plans import boosting as BO
from .plans import contributions as CO
from .plans import features as PF
from .plans import forecast as FC
from .plans import models as PM
from .plans import report as RP
from .plans import search as SR
from .plans import seasonal as SE
from .queries import _features, register
from .schema import FEATURE_COLS
from .session import kept, materialize, scratch_path
from .sources import fixtures as FX
from .sources import metrics_io as MIO
from .sources import runs as RU
from .testing import stable

D4 = 4  # digits for outputs that go through a least-squares solve (solvers differ ~1e-9 relative)
_ONE = ["lag_24h"]
SEARCH_TRIALS = 2
SEARCH_ROUNDS = ("int", 5, 15)
_FITTED: dict = {}


def _fitted(spark, sf, name, train=None):
    """The named model of this session and input, fitted once (on ``train``, if
    the caller has that frame)."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _FITTED:
        _FITTED[key] = PM.fit(name, _split(spark, sf)[0] if train is None else train)
    return _FITTED[key]


def _models(spark, sf, train=None):
    """All models; those not yet fitted share one feature frame."""
    if train is None and any((spark.sparkContext.applicationId, sf, n) not in _FITTED for n in PM.MODEL_NAMES):
        train = _split(spark, sf)[0]
    return {n: _fitted(spark, sf, n, train) for n in PM.MODEL_NAMES}


def _split(spark, sf):
    return SP.split_cutoff(_features(spark, sf), FX.CUTOFF)


def _lr1(spark, sf):
    train, test = _split(spark, sf)
    return PM.fit("linear", train, _ONE), train, test


_FIT = f"fit AS (SELECT regr_intercept(load_mw, lag_24h) AS a, regr_slope(load_mw, lag_24h) AS b FROM feat WHERE ts < {S.CUTOFF})"


# --- M3 one predictor (SQL-checkable through regr_*) --------------------------------

@register("fit_linear", f"""WITH {S.features_sql()}, {_FIT}
SELECT 'lag_24h' AS term, {S.rnd('b', 'value', D4)} FROM fit UNION ALL SELECT 'intercept', {S.rnd('a', 'value', D4)} FROM fit""")
def fit_linear(spark, sf):
    m, _, _ = _lr1(spark, sf)
    coef, b0 = PM.linear_coefficients(m, _ONE)
    rows = [("lag_24h", coef["lag_24h"]), ("intercept", b0)]
    return stable(spark.createDataFrame(rows, "term string, value double"), D4)


@register("score_linear", f"""WITH {S.features_sql()}, {_FIT}
SELECT series_id, ts, {S.rnd('load_mw', 'y', D4)}, {S.rnd('a + b * lag_24h', 'p', D4)} FROM feat, fit WHERE ts >= {S.CUTOFF}""")
def score_linear(spark, sf):
    m, _, test = _lr1(spark, sf)
    return stable(PM.predict(m, test), D4)


@register("linear_contributions", f"""WITH {S.features_sql()}, {_FIT},
mu AS (SELECT avg(lag_24h) AS m FROM feat WHERE ts >= {S.CUTOFF})
SELECT series_id, ts, 'lag_24h' AS feature, {S.rnd('b * (lag_24h - m)', 'contribution', D4)}
FROM feat, fit, mu WHERE ts >= {S.CUTOFF}""")
def linear_contributions(spark, sf):
    m, _, test = _lr1(spark, sf)
    coef, _ = PM.linear_coefficients(m, _ONE)
    return stable(PM.linear_contributions(test, coef), D4)


@register("mean_abs_contribution", f"""WITH {S.features_sql()}, {_FIT},
mu AS (SELECT avg(lag_24h) AS m FROM feat WHERE ts >= {S.CUTOFF})
SELECT 'lag_24h' AS feature, {S.rnd('avg(abs(b * (lag_24h - m)))', 'mean_abs_contribution', D4)}
FROM feat, fit, mu WHERE ts >= {S.CUTOFF}""")
def mean_abs_contribution(spark, sf):
    m, _, test = _lr1(spark, sf)
    coef, _ = PM.linear_coefficients(m, _ONE)
    return stable(M.mean_abs_contribution(PM.linear_contributions(test, coef)), D4)


_REC = f"""WITH RECURSIVE {S.features_sql()}, {_FIT},
rk AS (SELECT series_id, ts, load_mw, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rn FROM feat),
h0 AS (SELECT series_id, max(ts) AS t, list(load_mw ORDER BY ts) AS h FROM rk WHERE rn <= 168 GROUP BY series_id),
r AS (SELECT series_id, 0 AS step, t, h, CAST(NULL AS DOUBLE) AS p FROM h0
      UNION ALL
      SELECT r.series_id, r.step + 1, r.t + INTERVAL 1 HOUR,
             list_append(r.h, fit.a + fit.b * (CASE WHEN len(r.h) >= 24 THEN r.h[-24] ELSE list_avg(r.h) END)),
             fit.a + fit.b * (CASE WHEN len(r.h) >= 24 THEN r.h[-24] ELSE list_avg(r.h) END)
      FROM r CROSS JOIN fit WHERE r.step < 72)
SELECT series_id, CAST(step AS INTEGER) AS step, t AS ts, {S.rnd('p', 'forecast_mw', D4)} FROM r WHERE step >= 1"""


@register("forecast_linear", _REC)
def forecast_linear(spark, sf):
    m, _, _ = _lr1(spark, sf)
    coef, b0 = PM.linear_coefficients(m, _ONE)
    return stable(FC.forecast_linear(_features(spark, sf), coef, b0, 72), D4)


# --- M12 cold-start feature rows and scoring ----------------------------------------

_REQ = """SELECT event_id AS request_id,
  CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN props ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS datetime,
  CASE event_type WHEN 'view' THEN 'xgboost' WHEN 'click' THEN 'rf' WHEN 'purchase' THEN 'linear'
    WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'xgboost' ELSE 'magic_model' END END AS model
FROM events"""


def _cold_sql() -> str:
    cal = ",\n  ".join(S.calendar_select())
    return f"""WITH rq AS (SELECT *, TRY_CAST(datetime AS TIMESTAMP) AS ts FROM ({_REQ}) q),
base AS (SELECT ts FROM rq WHERE ts IS NOT NULL), {S.holidays_ctes('base')},
c AS (SELECT rq.*, {cal},
  CASE WHEN rq.ts IS NULL THEN NULL WHEN hol.d IS NULL THEN 0 ELSE 1 END AS is_holiday
  FROM rq LEFT JOIN hol ON CAST(rq.ts AS DATE) = hol.d)
SELECT request_id, datetime, model, ts,
  CASE WHEN ts IS NULL THEN 'unreadable time ''' || coalesce(datetime, '') || '''' END AS error,
  hour, day_of_week, month, quarter, day_of_year, week_of_year, is_weekend, CAST(is_holiday AS INTEGER) AS is_holiday,
  {S.rnd('hour_sin', 'hour_sin')}, {S.rnd('hour_cos', 'hour_cos')}, {S.rnd('month_sin', 'month_sin')}, {S.rnd('month_cos', 'month_cos')},
  {', '.join(f"CASE WHEN ts IS NOT NULL THEN CAST(32000.0 AS DOUBLE) END AS {c}" for c in ('lag_1h', 'lag_24h', 'lag_168h', 'rolling_mean_24h', 'rolling_mean_168h'))},
  CASE WHEN ts IS NOT NULL THEN CAST(6500.0 AS DOUBLE) END AS rolling_std_24h,
  CASE WHEN ts IS NOT NULL THEN CAST(10.0 AS DOUBLE) END AS temp, CASE WHEN ts IS NOT NULL THEN CAST(60.0 AS DOUBLE) END AS rhum,
  CASE WHEN ts IS NOT NULL THEN CAST(8.0 AS DOUBLE) END AS wspd, CASE WHEN ts IS NOT NULL THEN CAST(100.0 AS DOUBLE) END AS temp_sq
FROM c"""


@register("cold_start_features", _cold_sql())
def cold_start_features(spark, sf):
    return stable(RP.cold_start_features(FX.requests(spark, sf)))


_SERVER_TS = "2026-01-01T00:00:00+00:00"


# three models with one predictor each: a mix-up between them would show
_BY_NAME = {"linear": "lag_24h", "rf": "lag_168h", "xgboost": "lag_1h"}


def _each(template: str) -> str:
    return " UNION ALL ".join(template.format(n=n, c=c) for n, c in _BY_NAME.items())


@register("response_record", f"""WITH {S.features_sql()},
fits AS ({_each("SELECT '{n}' AS m, regr_intercept(load_mw, {c}) + regr_slope(load_mw, {c}) * 32000.0 AS v FROM feat WHERE ts < " + S.CUTOFF)}),
rq AS (SELECT request_id, datetime, coalesce(model, 'xgboost') AS model, TRY_CAST(datetime AS TIMESTAMP) AS ts FROM ({_REQ}) q)
SELECT request_id, CASE
  WHEN rq.ts IS NULL THEN CAST(to_json({{'detail': 'unreadable time ''' || coalesce(datetime, '') || ''''}}) AS VARCHAR)
  WHEN m IS NULL THEN CAST(to_json({{'detail': 'no model named ''' || model || '''; known: {", ".join(_BY_NAME)}'}}) AS VARCHAR)
  ELSE CAST(to_json({{'forecast_mw': round(v, 2), 'model': model, 'input_datetime': datetime,
    'server_timestamp': '{_SERVER_TS}', 'feature_count': 22, 'note': '{SC.NOTE}'}}) AS VARCHAR) END AS response
FROM rq LEFT JOIN fits ON fits.m = rq.model""")
def response_record(spark, sf):
    train = _features(spark, sf).filter(F.col("ts") < F.lit(FX.CUTOFF).cast("timestamp"))
    models = {n: PM.fit("linear", train, [c]) for n, c in _BY_NAME.items()}
    scored = RP.score_points(FX.requests(spark, sf), models)
    return scored.select("request_id", SC.response_record(F.col("forecast_mw"), F.col("model"), F.col("datetime"),
                                                          F.lit(_SERVER_TS), F.col("error")).alias("response"))


@register("score_points")
def score_points(spark, sf):
    """M12 end to end: every request by the 22-feature model it names."""
    return RP.score_points(FX.requests(spark, sf), _models(spark, sf)).select(
        "request_id", "datetime", "model", F.round("forecast_mw", 2).alias("forecast_mw"), "error")


# --- M3-M5, M7, M9, M10, M15, M16, S7 (rows-only: trees / full fits) ----------------

@register("fit_linear_full")
def fit_linear_full(spark, sf):
    train, _ = _split(spark, sf)
    coef, b0 = PM.linear_coefficients(PM.fit("linear", train))
    return spark.createDataFrame(list(coef.items()) + [("intercept", b0)], "term string, value double")


def _gradient(train, cols):
    """Per column the cosine between it and the residuals of the full fit: all
    are 0 exactly where the squared error is least (the normal equations)."""
    scored = PM.fit("linear", train, cols).transform(train)
    r = F.col("load_mw") - F.col("prediction")
    terms = {"intercept": F.lit(1.0), **{c: F.col(c).cast("double") for c in cols}}
    sums = scored.agg(F.count("*").alias("n"), *[
        (F.sum(x * r) / F.nullif(F.sqrt(F.sum(x * x) * F.sum(r * r)), F.lit(0.0))).alias(c) for c, x in terms.items()])
    cells = [F.struct(F.lit(c).alias("term"), F.coalesce(F.col(c), F.lit(0.0)).alias("gradient")) for c in terms]
    return sums.select("n", F.inline(F.array(*cells))).select("term", "n", "gradient")


def _gradient_sql(load: str, cols, where: str) -> str:
    terms = ", ".join(f"('{c}')" for c in ("intercept", *cols))
    return f"""WITH {load}, k AS (SELECT count(*) AS n FROM {where})
SELECT term, n, CAST(0.0 AS DOUBLE) AS gradient FROM k, (VALUES {terms}) t(term)"""


@register("fit_linear_gradient", _gradient_sql(S.features_sql(), FEATURE_COLS, f"feat WHERE ts < {S.CUTOFF}"))
def fit_linear_gradient(spark, sf):
    """M3 with all 22 features, checked by its normal equations."""
    return stable(_gradient(_split(spark, sf)[0], FEATURE_COLS), D4)


# the user-level panel: rows grow with the events; features over a day at most, as few users have 168 stamps
_USER_COLS = [c for c in FEATURE_COLS if "168h" not in c]
_USER_ROWS = " AND ".join(f"{c} IS NOT NULL" for c in _USER_COLS)


def _user_features(spark, sf):
    return PF.build_features(FX.sparse_panel(spark, sf), FX.weather(spark, sf), dropna=False)


@register("fit_linear_users", _gradient_sql(S.features_sql(load=S.SPARSE), _USER_COLS, f"fg WHERE ts < {S.CUTOFF} AND {_USER_ROWS}"))
def fit_linear_users(spark, sf):
    """M3 over the series of all users, 20 features, checked by its normal equations."""
    train = SP.split_cutoff(_user_features(spark, sf), FX.CUTOFF)[0]
    return stable(_gradient(materialize(train.dropna(subset=_USER_COLS)), _USER_COLS), D4)


_USER_REC = f"""WITH RECURSIVE {S.features_sql(load=S.SPARSE)},
rk AS (SELECT series_id, ts, load_mw, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rn FROM fg),
h0 AS (SELECT series_id, max(ts) AS t, list(load_mw ORDER BY ts) AS h FROM rk WHERE rn <= 168 GROUP BY series_id),
r AS (SELECT series_id, 0 AS step, t, h, CAST(NULL AS DOUBLE) AS p FROM h0
      UNION ALL
      SELECT series_id, step + 1, t + INTERVAL 1 HOUR, list_append(h, q)[-168:], q
      FROM (SELECT *, 7.0 + 0.8 * (CASE WHEN len(h) >= 24 THEN h[-24] ELSE list_avg(h) END) AS q FROM r WHERE step < 72) x)
SELECT series_id, CAST(step AS INTEGER) AS step, t AS ts, {S.rnd('p', 'forecast_mw', D4)} FROM r WHERE step >= 1"""


@register("forecast_users", _USER_REC)
def forecast_users(spark, sf):
    """M11, M13 for every user's series at once."""
    return stable(FC.forecast_linear(_user_features(spark, sf), {"lag_24h": 0.8}, 7.0, 72), D4)


@register("fit_forest")
def fit_forest(spark, sf):
    train, test = _split(spark, sf)
    return PM.predict(PM.fit("rf", train), test, name="rf")


@register("fit_boosted")
def fit_boosted(spark, sf):
    train, test = _split(spark, sf)
    return PM.predict(PM.fit("xgboost", train), test, name="xgboost")


# one round of depth 1 over two features, with both penalties on
_L1, _L2, _RATE = 5.0, 2.0, 0.5
_T1 = f"(sign({{g}}) * greatest(abs({{g}}) - {_L1}, 0))"


def _stump_sql() -> str:
    def term(g, h):
        return f"power({_T1.format(g=g)}, 2) / ({h} + {_L2})"
    sides = " UNION ALL ".join(f"""SELECT {k} AS f, v, sum(CASE WHEN {c} <= v THEN g ELSE 0 END) AS gl,
        sum(CASE WHEN {c} <= v THEN 1 ELSE 0 END) AS hl, sum(g) AS gt, count(*) AS ht
        FROM t, (SELECT DISTINCT {c} AS v FROM t) d GROUP BY v""" for k, c in enumerate(("hour", "day_of_week")))
    left = f"-{_T1.format(g='gl')} / (hl + {_L2})"
    right = f"-{_T1.format(g='(gt - gl)')} / (ht - hl + {_L2})"
    return f"""WITH {S.features_sql()},
b AS (SELECT avg(load_mw) AS base FROM feat WHERE ts < {S.CUTOFF}),
t AS (SELECT hour, day_of_week, base - load_mw AS g FROM feat, b WHERE ts < {S.CUTOFF}),
s AS ({sides}),
w AS (SELECT f, v, {left} AS lw, {right} AS rw FROM s WHERE hl >= 3 AND ht - hl >= 3
    ORDER BY {term('gl', 'hl')} + {term('(gt - gl)', '(ht - hl)')} - {term('gt', 'ht')} DESC, f, v LIMIT 1)
SELECT series_id, ts, {S.rnd(f"base + {_RATE} * (CASE WHEN (CASE WHEN f = 0 THEN hour ELSE day_of_week END) <= v THEN lw ELSE rw END)", 'prediction', D4)}
FROM feat, b, w WHERE ts >= {S.CUTOFF}"""


@register("boosted_round", _stump_sql())
def boosted_round(spark, sf):
    """M5: gradient and Hessian sums, both penalties, one tree."""
    train, test = _split(spark, sf)
    m = BO.fit_penalised(train, ["hour", "day_of_week"], rounds=1, depth=1, rate=_RATE, row_share=1.0, column_share=1.0, l1=_L1, l2=_L2)
    return stable(m.transform(test).select("series_id", "ts", "prediction"), D4)


@register("feature_importance")
def feature_importance(spark, sf):
    return PM.feature_importance(spark, _fitted(spark, sf, "rf"))


@register("top_features")
def top_features(spark, sf):
    return M.top_features(PM.feature_importance(spark, _fitted(spark, sf, "rf")), 20)


_ABS = " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(abs(CAST({float(k + 1)} AS DOUBLE) / 7.0 * (t.{c} - mu.{c}))) "
                          "AS importance FROM t, mu" for k, c in enumerate(FEATURE_COLS))


@register("top_contributions", f"""WITH {S.features_sql()},
t AS (SELECT * FROM feat WHERE ts >= {S.CUTOFF}),
mu AS (SELECT {', '.join(f'avg({c}) AS {c}' for c in FEATURE_COLS)} FROM t),
l AS ({_ABS})
SELECT feature, {S.rnd('importance', 'importance')} FROM (SELECT * FROM l ORDER BY importance DESC, feature LIMIT 20) x""")
def top_contributions(spark, sf):
    """M8, A13, K3 over all 22 features, with fixed coefficients."""
    _, test = _split(spark, sf)
    coef = {c: (k + 1) / 7.0 for k, c in enumerate(FEATURE_COLS)}
    return stable(M.top_features(M.mean_abs_contribution(PM.linear_contributions(test, coef))
                                 .withColumnRenamed("mean_abs_contribution", "importance"), 20))


_PERM_ORDER = "md5('{seed}/' || series_id || '/' || epoch_us(ts))"


@register("permutation_importance_one", f"""WITH {S.features_sql()}, {_FIT},
t AS (SELECT series_id, ts, load_mw, lag_24h FROM feat WHERE ts >= {S.CUTOFF}),
i AS (SELECT *, row_number() OVER (ORDER BY {_PERM_ORDER.format(seed=PM.SEED)}) AS i,
        row_number() OVER (ORDER BY {_PERM_ORDER.format(seed=PM.SEED + 1)}) AS j FROM t),
p AS (SELECT x.load_mw, x.lag_24h, z.lag_24h AS other FROM i x JOIN i z ON x.i = z.j)
SELECT 'lag_24h' AS feature, {S.rnd('avg(abs(load_mw - (a + b * other))) - avg(abs(load_mw - (a + b * lag_24h)))', 'importance', D4)} FROM p, fit""")
def permutation_importance_one(spark, sf):
    m, _, test = _lr1(spark, sf)
    return stable(PM.permutation_importance(m, test, _ONE), D4)


@register("permutation_importance")
def permutation_importance(spark, sf):
    return PM.permutation_importance(_fitted(spark, sf, "xgboost"), _split(spark, sf)[1])


@register("linear_contributions_full")
def linear_contributions_full(spark, sf):
    coef, _ = PM.linear_coefficients(_fitted(spark, sf, "linear"))
    return M.top_features(M.mean_abs_contribution(PM.linear_contributions(_split(spark, sf)[1], coef))
                          .withColumnRenamed("mean_abs_contribution", "importance"), 20)


@register("tree_contributions")
def tree_contributions(spark, sf):
    """M8, A13, K3 for the boosted model: exact Shapley values of every row."""
    rows = CO.tree_contributions(_fitted(spark, sf, "xgboost"), _split(spark, sf)[1])
    return M.top_features(M.mean_abs_contribution(rows).withColumnRenamed("mean_abs_contribution", "importance"), 20)


@register("score_test_one", f"""WITH {S.features_sql()},
fits AS ({_each("SELECT '{n}' AS model, regr_intercept(load_mw, {c}) AS a, regr_slope(load_mw, {c}) AS b FROM feat WHERE ts < " + S.CUTOFF)}),
preds AS ({_each("SELECT f.model, load_mw AS y, f.a + f.b * {c} AS p FROM feat, fits f WHERE f.model = '{n}' AND ts >= " + S.CUTOFF)}),
{S.metrics_cte()}
SELECT model, {', '.join(S.rnd(k, k, D4) for k in ('mae', 'rmse', 'mape', 'r2'))}, n FROM m""")
def score_test_one(spark, sf):
    """Three one-predictor fits, scored on one test frame."""
    train, test = _split(spark, sf)
    models = {n: PM.fit("linear", train, [c]) for n, c in _BY_NAME.items()}
    return stable(M.evaluate_models(PM.score_test(models, test), rounded=False), D4)


@register("score_test")
def score_test(spark, sf):
    train, test = _split(spark, sf)
    return M.evaluate_models(PM.score_test(_models(spark, sf, train), test))


@register("train_all")
def train_all(spark, sf):
    train, test = _split(spark, sf)
    _, _, metrics = PM.train_all(train, test)
    return M.leaderboard(metrics)


@register("retrain_baseline")
def retrain_baseline(spark, sf):
    train, test = _split(spark, sf)
    _, metrics = PM.retrain_baseline(train, test)
    path = scratch_path(spark, "metrics-json")
    MIO.write_metrics_json(M.evaluate_models(M.residuals(_lag_preds(spark, sf)), rounded=True), path)
    return kept(MIO.upsert_metrics_json(spark, metrics, path), path)


def _lag_preds(spark, sf):
    from .plans.evaluate import lag_predictions
    return lag_predictions(_features(spark, sf))


@register("save_load_model")
def save_load_model(spark, sf):
    path = PM.save_model(_fitted(spark, sf, "linear"), scratch_path(spark, "model-linear"))
    return kept(PM.predict(PM.load_model(spark, path), _split(spark, sf)[1], name="linear"), path)


@register("save_load_model_one", f"""WITH {S.features_sql()}, {_FIT}
SELECT series_id, ts, {S.rnd('load_mw', 'y', D4)}, {S.rnd('a + b * lag_24h', 'p', D4)} FROM feat, fit WHERE ts >= {S.CUTOFF}""")
def save_load_model_one(spark, sf):
    m, _, test = _lr1(spark, sf)
    path = PM.save_model(m, scratch_path(spark, "model-one"))
    return kept(stable(PM.predict(PM.load_model(spark, path), test), D4), path)


# --- M11 trees, M13 -----------------------------------------------------------------

@register("forecast_tree")
def forecast_tree(spark, sf):
    return FC.forecast_trees(_fitted(spark, sf, "rf"), _features(spark, sf), 72, name="rf")


@register("forecast_models")
def forecast_models(spark, sf):
    frame = _features(spark, sf)
    return FC.forecast_models(_models(spark, sf, SP.split_cutoff(frame, FX.CUTOFF)[0]), frame, 72, display=True)


# all 22 coefficients, fixed: small for the calendar, a contraction for the lags
_FIXED = {c: 0.25 + 0.125 * k for k, c in enumerate(FEATURE_COLS)} | {
    "lag_1h": 0.25, "lag_24h": 0.25, "lag_168h": 0.125, "rolling_mean_24h": 0.125, "rolling_mean_168h": 0.0625,
    "rolling_std_24h": 0.125}


def _fixed_sql() -> str:
    tail = "r.h[greatest(len(r.h) - 23, 1):]"
    lag = {"lag_1h": "r.h[-1]", "lag_24h": "(CASE WHEN len(r.h) >= 24 THEN r.h[-24] ELSE list_avg(r.h) END)",
           "lag_168h": "(CASE WHEN len(r.h) >= 168 THEN r.h[-168] ELSE list_avg(r.h) END)",
           "rolling_mean_24h": f"list_avg({tail})", "rolling_mean_168h": "list_avg(r.h[greatest(len(r.h) - 167, 1):])",
           "rolling_std_24h": f"list_stddev_pop({tail})", "temp": "10.0", "rhum": "60.0", "wspd": "8.0", "temp_sq": "100.0"}
    cal = {e.rsplit(" AS ", 1)[1]: e.rsplit(" AS ", 1)[0] for e in S.calendar_select("fut.ts")}
    base = " + ".join([f"{_FIXED[c]} * ({x})" for c, x in cal.items()]
                      + [f"{_FIXED['is_holiday']} * (CASE WHEN hol.d IS NULL THEN 0 ELSE 1 END)"])
    pred = "w.base + " + " + ".join(f"{_FIXED[c]} * {x}" for c, x in lag.items())
    return f"""WITH RECURSIVE {S.features_sql()},
rk AS (SELECT series_id, ts, load_mw, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rn FROM feat),
h0 AS (SELECT series_id, max(ts) AS t, list(load_mw ORDER BY ts) AS h FROM rk WHERE rn <= 168 GROUP BY series_id),
fut AS (SELECT series_id, CAST(s AS INTEGER) AS step, t + s * INTERVAL 1 HOUR AS ts FROM h0, range(1, 73) x(s)),
w AS (SELECT fut.series_id, fut.step, fut.ts, CAST(5.0 AS DOUBLE) + {base} AS base
      FROM fut LEFT JOIN hol ON CAST(fut.ts AS DATE) = hol.d),
r AS (SELECT series_id, 0 AS step, h, CAST(NULL AS DOUBLE) AS p FROM h0
      UNION ALL
      SELECT r.series_id, r.step + 1, list_append(r.h, {pred})[-168:], {pred}
      FROM r JOIN w ON w.series_id = r.series_id AND w.step = r.step + 1)
SELECT r.series_id, CAST(r.step AS INTEGER) AS step, w.ts, {S.rnd('r.p', 'forecast_mw', D4)}
FROM r JOIN w ON w.series_id = r.series_id AND w.step = r.step WHERE r.step >= 1"""


@register("forecast_fixed", _fixed_sql())
def forecast_fixed(spark, sf):
    """M11, M13 with all 22 coefficients given."""
    return stable(FC.forecast_linear(_features(spark, sf), _FIXED, 5.0, 72), D4)


# --- M6 / A14 -------------------------------------------------------------------------

_SMALL_SPACE = dict(SR.SEARCH_SPACE, maxIter=SEARCH_ROUNDS)


@register("walk_forward_search")
def walk_forward_search(spark, sf):
    train, _ = _split(spark, sf)
    _, scores, _, _ = SR.walk_forward_search(spark, train, n_trials=SEARCH_TRIALS, n_splits=3, space=_SMALL_SPACE)
    return scores


@register("cv_score")
def cv_score(spark, sf):
    train, _ = _split(spark, sf)
    _, _, table, _ = SR.walk_forward_search(spark, train, n_trials=SEARCH_TRIALS, n_splits=3, space=_SMALL_SPACE)
    return table


@register("cv_score_lags", f"""WITH {S.predictions_sql()},
st AS (SELECT DISTINCT ts FROM feat),
ix AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS idx, count(*) OVER () AS n FROM st),
folded AS (SELECT p.model, p.y, p.p, CASE WHEN n // 4 > 0 AND idx >= n - 3 * (n // 4) THEN (idx - (n - 3 * (n // 4))) // (n // 4) END AS fold
      FROM preds p JOIN ix ON p.ts = ix.ts),
m AS (SELECT model, fold, avg(abs(y - p)) AS mae FROM folded WHERE fold IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2)
SELECT model AS candidate, {S.rnd('avg(mae)', 'cv_mae')}, count(*) AS n_folds FROM m GROUP BY 1""")
def cv_score_lags(spark, sf):
    """A14 on the fold errors of the lag predictions."""
    folds = SP.fold_index(_lag_preds(spark, sf), 3).where("val_fold is not null and p is not null")
    scores = folds.groupBy("model", "val_fold").agg(M.mae(F.col("y"), F.col("p")).alias("mae"))
    return stable(SR.cv_score(scores.withColumnRenamed("model", "candidate")))


# --- M14 --------------------------------------------------------------------------------

@register("seasonal_regression")
def seasonal_regression(spark, sf):
    train, test = _split(spark, sf)
    _, tp, _ = SE.seasonal_regression(train, test, 72)
    return tp


_T = "(epoch(ts) / 3600.0)"


@register("seasonal_trend", f"""WITH {S.features_sql()},
g AS (SELECT series_id, avg(load_mw) AS my, avg({_T}) AS mt, regr_slope(load_mw, {_T} - 470000) AS b FROM feat WHERE ts < {S.CUTOFF} GROUP BY 1)
SELECT feat.series_id, ts, {S.rnd(f'my + b * ({_T} - mt)', 'yhat', 3)} FROM feat JOIN g ON feat.series_id = g.series_id WHERE ts >= {S.CUTOFF}""")
def seasonal_trend(spark, sf):
    """The trend part alone, without priors: least squares per series."""
    train, test = _split(spark, sf)
    bare = dict(regressors=(), seasons=(), holiday=False, changepoints=0)
    coefs = SE.fit_seasonal(train, priors=False, **bare)
    return stable(SE.predict_seasonal(test, coefs, **bare).select("series_id", "ts", "yhat"), 3)


@register("seasonal_forecast")
def seasonal_forecast(spark, sf):
    train, test = _split(spark, sf)
    _, _, fp = SE.seasonal_regression(train, test, 72)
    return fp


# --- M17 ---------------------------------------------------------------------------------

def _seq_sql() -> str:
    cols = [*FEATURE_COLS, "load_mw"]
    mm = ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in cols)
    sc = ", ".join(f"(f.{c} - s.{c}_lo) / (CASE WHEN s.{c}_hi - s.{c}_lo = 0 THEN 1.0 ELSE s.{c}_hi - s.{c}_lo END) AS {c}"
                   for c in cols)
    return f"""WITH {S.features_sql()},
s AS (SELECT {mm} FROM feat WHERE ts < {S.CUTOFF}),
z AS (SELECT f.series_id, f.ts, CASE WHEN f.ts < {S.CUTOFF} THEN 0 ELSE 1 END AS part, {sc} FROM feat f CROSS JOIN s),
q AS (SELECT series_id, ts, load_mw, hour_sin,
        count(*) OVER (PARTITION BY series_id, part ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS n,
        sum(lag_1h) OVER (PARTITION BY series_id, part ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS s1
      FROM z)
SELECT series_id, ts, CAST(n AS INTEGER) AS seq_len, {S.rnd('s1', 'lag_1h_sum')}, {S.rnd('load_mw', 'y')} FROM q WHERE n = 24"""


@register("sequence_dataset", _seq_sql())
def sequence_dataset(spark, sf):
    train, test = _split(spark, sf)
    _, tr, te = SEQ.sequence_dataset(train, test, 24)
    i = FEATURE_COLS.index("lag_1h")

    def summary(d):
        return d.select("series_id", "ts", F.size("seq").alias("seq_len"),
                        F.aggregate("seq", F.lit(0.0), lambda a, r: a + r[i]).alias("lag_1h_sum"), "y")
    return stable(summary(tr).unionByName(summary(te)))


# --- S4-S6, S9 ----------------------------------------------------------------------------

_MET = f"{S.predictions_sql()}, {S.metrics_cte()}"


@register("metrics_json", f"""WITH {_MET}
SELECT CAST(to_json(map_from_entries(list({{'k': model, 'v': {{'MAE': round(mae, 2), 'RMSE': round(rmse, 2), 'MAPE': round(mape, 4), 'R2': round(r2, 4)}}}} ORDER BY model))) AS VARCHAR) AS metrics_json FROM m""")
def metrics_json(spark, sf):
    return MIO.metrics_document(M.evaluate_models(_lag_preds(spark, sf), rounded=True))


@register("metrics_json_roundtrip", f"""WITH {_MET}
SELECT model, round(mae, 2) AS mae, round(rmse, 2) AS rmse, round(mape, 4) AS mape, round(r2, 4) AS r2 FROM m""")
def metrics_json_roundtrip(spark, sf):
    path = scratch_path(spark, "metrics-json")
    MIO.write_metrics_json(M.evaluate_models(_lag_preds(spark, sf), rounded=True), path)
    return kept(MIO.read_metrics_json(spark, path), path)


@register("metrics_csv", f"""WITH {_MET}
SELECT model, round(round(mae, 2), 2) AS mae, round(round(rmse, 2), 2) AS rmse, round(round(mape, 4), 2) AS mape,
       round(round(r2, 4), 2) AS r2 FROM m""")
def metrics_csv(spark, sf):
    path = scratch_path(spark, "metrics-csv")
    MIO.write_metrics_csv(M.leaderboard(M.evaluate_models(_lag_preds(spark, sf), rounded=True)), path)
    return kept(MIO.read_metrics_csv(spark, path), path)


_SOURCE = f"""WITH {_MET}
SELECT model, round(mae, 2) AS mae, round(rmse, 2) AS rmse, round(round(mape, 4), {{d}}) AS mape, round(round(r2, 4), {{d}}) AS r2,
  '{{name}}' AS source FROM m"""


def _from_source(spark, sf, write, name):
    root = scratch_path(spark, "metrics")
    write(M.evaluate_models(_lag_preds(spark, sf), rounded=True), f"{root}/{name}")
    got = MIO.metrics_source(spark, f"{root}/metrics.json", f"{root}/metrics.csv")
    return kept(got.withColumn("source", F.substring_index("source", "/", -1)), root)


@register("metrics_source", _SOURCE.format(d=4, name="metrics.json"))
def metrics_source(spark, sf):
    return _from_source(spark, sf, MIO.write_metrics_json, "metrics.json")


@register("metrics_source_csv", _SOURCE.format(d=2, name="metrics.csv"))
def metrics_source_csv(spark, sf):
    return _from_source(spark, sf, lambda m, path: MIO.write_metrics_csv(M.leaderboard(m), path), "metrics.csv")


@register("list_runs", f"""WITH {_MET}
SELECT 'lag-baselines' AS experiment, md5('lag-baselines/' || model) AS run_id, substr(md5('lag-baselines/' || model), 1, 8) AS name,
  'FINISHED' AS status, model, {S.snapped_metrics()} FROM m""")
def list_runs(spark, sf):
    runs = RU.run_records(M.evaluate_models(_lag_preds(spark, sf), rounded=False), "lag-baselines")
    path = scratch_path(spark, "runs")
    RU.log_runs(runs, path)
    return kept(stable(RU.list_runs(RU.read_runs(spark, path))), path)


@register("list_model_runs")
def list_model_runs(spark, sf):
    """S9 for the tuned and the seasonal model: both logged, then listed with
    shown names and parameters."""
    train, test = _split(spark, sf)
    best, _, table, model = SR.walk_forward_search(spark, train, n_trials=SEARCH_TRIALS, n_splits=3, space=_SMALL_SPACE)
    path = scratch_path(spark, "model-runs")
    RU.log_runs(SR.tuned_run(best, table, model, test), path)
    RU.log_runs(SE.seasonal_run(SE.seasonal_regression(train, test, 72)[1]), path)
    runs = RU.read_runs(spark, path)
    listed = RU.list_runs(runs).join(runs.select("run_id", F.to_json("params").alias("params")), "run_id")
    return kept(listed.withColumn("model", SC.display_name(F.col("model"))), path)
