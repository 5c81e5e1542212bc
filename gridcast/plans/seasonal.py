"""Seasonal regression (M14): trend times (1 + seasonality), with shrinkage.

Per series ``y = g(t) * (1 + x(t) . b) + noise``.  ``g`` is a piecewise linear
trend over the train span (changepoints in its first 80 %); ``x`` holds Fourier
terms of the daily, weekly and yearly cycles, the holiday flag and the weather
columns, standardised on the train rows.  Time and value are scaled by the
train span and the largest value, so the priors mean the same for every series.

Changepoints are sparse: their sizes have a Laplace prior, fitted by coordinate
descent on the series' ``X'X`` beside the cycles that the span shows twice, and
breaks that do not earn their place are dropped again.  Every block of
seasonal coefficients has a Gaussian prior whose width is learned from the data
(evidence maximisation) up to the block's fixed largest width, and a cycle longer
than the train span has no part: it could only be taken for the trend.

Fitting is distributed and safe for a hot series: rows meet the values of
their series by time block, each batch of rows adds up ``X'X`` and ``X'y`` per
series (one matrix product), Spark sums these, and only the small per-series
systems are solved.  Three passes: the trend beside additive cycles, the
seasonality around it, the trend again under this seasonality.  Predictions are
plain expressions.

The band is ``yhat`` plus and minus ``z`` deviations of residual, trend
coefficients and, after the train span, breaks to come: these happen at the rate
of those found and are as large, so the trend's variance grows with the third
power of the horizon.  In the last fifth of the span, where no break is looked
for, the slope may drift by the same variance if any break was found.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import add_is_holiday
from ..operators import ordered as O
from ..schema import KEYS, TS
from ..session import materialize

# --- fixed values: seasonal orders and periods (hours), largest prior widths ---
SEASONS = (("daily", 24.0, 4), ("weekly", 168.0, 3), ("yearly", 8766.0, 10))
INTERVAL_WIDTH = 0.80
SEASONALITY_PRIOR = 10.0
CHANGEPOINT_PRIOR = 0.05
SLOPE_PRIOR = 5.0
CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
# -------------------------------------------------------------------------------
EVIDENCE_ROUNDS = 40
SPARSE_ROUNDS = 6       # of the noise beside the changepoints
SWEEPS = 200            # of coordinate descent, at most
BREAK_COST = 3.0        # times ln(rows): what a break must take off the scaled squared error


def trend_matrix(s: np.ndarray, changepoints: int) -> np.ndarray:
    """Intercept, slope and hinges over scaled time ``s`` (0..1 in train)."""
    return np.column_stack([np.ones_like(s), s, *(np.maximum(0.0, s - k) for k in knots_of(changepoints))])


def knots_of(changepoints: int) -> np.ndarray:
    return CHANGEPOINT_RANGE * np.arange(1, changepoints + 1) / max(1, changepoints)


def season_matrix(hours: np.ndarray, holiday: np.ndarray, regressors: np.ndarray, seasons, with_holiday: bool) -> np.ndarray:
    cols = []
    for _, period, order in seasons:
        for k in range(1, order + 1):
            angle = 2.0 * math.pi * k / period * hours
            cols += [np.sin(angle), np.cos(angle)]
    if with_holiday:
        cols.append(holiday)
    cols += list(regressors.T)
    return np.column_stack(cols) if cols else np.zeros((len(hours), 0))


def solve_evidence(gram: np.ndarray, xy: np.ndarray, yy: float, n: float, blocks: Sequence[tuple[int, int, float | None]],
                   rounds: int = EVIDENCE_ROUNDS) -> tuple[np.ndarray, float]:
    """Posterior mean and noise deviation.  ``blocks``: (start, end, largest
    prior width; None: no prior)."""
    p = len(xy)
    if not p:
        return np.zeros(0), math.sqrt(yy / max(n, 1.0))
    width = np.zeros(p)
    for a, b, w in blocks:
        width[a:b] = np.inf if w is None else w
    variance = np.where(np.isinf(width), np.inf, np.minimum(width ** 2, 1.0))
    noise = max(yy / max(n, 1.0), 1e-12)
    mean = np.zeros(p)
    free = not np.isfinite(width).any()
    tiny = 1e-12 * np.diag(np.maximum(np.diag(gram), 1e-12))
    for _ in range(1 if free else rounds):
        precision = np.where(np.isinf(variance), 0.0, 1.0 / np.maximum(variance, 1e-12))
        cov = np.linalg.pinv((gram + tiny) / noise + np.diag(precision), hermitian=True)
        mean = cov @ xy / noise
        sse = max(yy - 2 * mean @ xy + mean @ gram @ mean, 0.0)
        noise = max((sse + float((gram * cov).sum())) / max(n, 1.0), 1e-12) if not free else noise
        for a, b, w in blocks:
            if w is not None and b > a:
                variance[a:b] = min((mean[a:b] @ mean[a:b] + np.trace(cov[a:b, a:b])) / (b - a), w ** 2)
    sse = max(yy - 2 * mean @ xy + mean @ gram @ mean, 0.0)
    return mean, math.sqrt(sse / max(n - min(p, n - 1), 1.0)) if free else math.sqrt(noise)


def solve_sparse(gram: np.ndarray, xy: np.ndarray, yy: float, n: float, sparse: slice, ridge: np.ndarray,
                 rate: float = CHANGEPOINT_PRIOR) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, their covariance and the noise variance, with a Laplace
    prior of scale ``rate`` on the columns ``sparse`` and Gaussian ones of
    precision ``ridge`` (0: none) on the others, which are eliminated exactly."""
    p = len(xy)
    many = np.arange(p)[sparse]
    rest = np.setdiff1d(np.arange(p), many)
    noise, delta = max(yy / max(n, 1.0), 1e-12), np.zeros(len(many))
    for _ in range(SPARSE_ROUNDS):
        a = gram[np.ix_(rest, rest)] + np.diag(noise * ridge[rest] + 1e-9 * np.maximum(np.diag(gram)[rest], 1e-9))
        half = np.linalg.solve(a, np.column_stack([gram[np.ix_(rest, many)], xy[rest]]))
        q = gram[np.ix_(many, many)] - gram[np.ix_(many, rest)] @ half[:, :-1]
        c = xy[many] - gram[np.ix_(many, rest)] @ half[:, -1]
        left = max(yy - xy[rest] @ half[:, -1], 0.0)  # squared error without any break
        for _ in range(SWEEPS):
            moved = 0.0
            for j in range(len(many)):
                if q[j, j] > 1e-9:
                    r = c[j] - q[j] @ delta + q[j, j] * delta[j]
                    new = math.copysign(max(abs(r) - noise / rate, 0.0), r) / q[j, j]
                    moved, delta[j] = max(moved, abs(new - delta[j])), new
            if moved < 1e-6:
                break
        noise = max((left - 2 * c @ delta + delta @ q @ delta) / max(n - len(rest) - np.count_nonzero(delta), 1.0), 1e-12)

    def fitted(breaks: list[int]) -> tuple[np.ndarray, float]:
        if not breaks:
            return np.zeros(0), left
        size = np.linalg.lstsq(q[np.ix_(breaks, breaks)], c[breaks], rcond=1e-10)[0]
        return size, left - c[breaks] @ size

    breaks = np.flatnonzero(delta).tolist()
    size, error = fitted(breaks)
    while breaks:
        noise = max(error / max(n - len(rest) - len(breaks), 1.0), 1e-12)
        least, k = min((fitted([x for x in breaks if x != b])[1], b) for b in breaks)
        if least - error > BREAK_COST * math.log(max(n, 2.0)) * noise:
            break
        breaks.remove(k)
        size, error = fitted(breaks)
    noise = max(error / max(n - len(rest) - len(breaks), 1.0), 1e-12)
    out, cov = np.zeros(p), np.zeros((p, p))
    out[many[breaks]] = size
    out[rest] = half[:, -1] - half[:, :-1][:, breaks] @ size
    used = np.concatenate([rest, many[breaks]]).astype(int)
    precision = gram[np.ix_(used, used)] + np.diag(noise * ridge[used] + 1e-9 * np.maximum(np.diag(gram)[used], 1e-9))
    cov[np.ix_(used, used)] = noise * np.linalg.pinv(precision, hermitian=True)
    return out, cov, noise


LATE = 6  # places after the last knot that stand for breaks there
_LATE = CHANGEPOINT_RANGE + (1 - CHANGEPOINT_RANGE) / LATE * (np.arange(LATE) + 0.5)


class _Design:
    """How rows become matrices; shared by fitting and prediction."""

    def __init__(self, keys, ts, value, regressors, seasons, holiday, changepoints, priors):
        self.keys, self.ts, self.value = list(keys), ts, value
        self.regressors, self.seasons, self.holiday = list(regressors), tuple(seasons), holiday
        self.changepoints, self.priors = changepoints, priors
        w = (lambda x: x) if priors else (lambda x: None)
        self.trend_blocks = [(0, 1, None), (1, 2, w(SLOPE_PRIOR)), (2, 2 + changepoints, w(CHANGEPOINT_PRIOR))]
        self.periods = [period for _, period, order in self.seasons for _ in range(2 * order)]  # by column
        at, self.season_blocks = 0, []
        for size in [2 * order for _, _, order in self.seasons] + [1] * holiday + [1] * len(self.regressors):
            self.season_blocks.append((at, at + size, w(SEASONALITY_PRIOR)))
            at += size

    def rows(self, df: DataFrame, bounds: DataFrame) -> DataFrame:
        """Rows with their series' scales; columns as plain numbers."""
        d = df if "is_holiday" in df.columns or not self.holiday else add_is_holiday(df, self.ts)
        hours = F.unix_seconds(F.col(self.ts)).cast("double") / F.lit(3600.0)
        d = O.join_by_block(d, bounds, self.keys, self.ts)
        span = F.when(F.col("_h1") > F.col("_h0"), F.col("_h1") - F.col("_h0")).otherwise(F.lit(1.0))
        scaled = [((F.col(r).cast("double") - F.col(f"_m_{r}"))
                   / F.when(F.col(f"_s_{r}") > 0, F.col(f"_s_{r}")).otherwise(F.lit(1.0))) for r in self.regressors]
        return d.withColumns({"_hours": hours, "_s": (hours - F.col("_h0")) / span,
                              "_hol": F.col("is_holiday").cast("double") if self.holiday else F.lit(0.0),
                              "_r": F.array(*[F.coalesce(c, F.lit(0.0)) for c in scaled]).cast("array<double>")})

    def bounds(self, train: DataFrame) -> DataFrame:
        hours = F.unix_seconds(F.col(self.ts)).cast("double") / F.lit(3600.0)
        return train.groupBy(*self.keys).agg(
            F.min(hours).alias("_h0"), F.max(hours).alias("_h1"),
            F.coalesce(F.nullif(F.max(F.abs(self.value)), F.lit(0.0)), F.lit(1.0)).alias("_scale"),
            *[F.avg(r).alias(f"_m_{r}") for r in self.regressors],
            *[F.stddev_pop(r).alias(f"_s_{r}") for r in self.regressors])

    def season(self, b) -> np.ndarray:
        r = np.array(b["_r"].tolist(), dtype=float).reshape(len(b), len(self.regressors))
        return season_matrix(b["_hours"].to_numpy(float), b["_hol"].to_numpy(float), r, self.seasons, self.holiday)

    def trend_value(self):
        """The trend of a row, from its series' ``_trend`` and ``_knots``."""
        hinges = F.zip_with(F.expr("slice(_trend, 3, greatest(size(_trend) - 2, 0))"), "_knots",
                            lambda d, k: d * F.greatest(F.col("_s") - k, F.lit(0.0)))
        return F.element_at("_trend", 1) + F.element_at("_trend", 2) * F.col("_s") + F.aggregate(hinges, F.lit(0.0), lambda a, x: a + x)

    def season_value(self):
        """The seasonality of a row, from its series' ``_beta``."""
        terms = []
        for _, period, order in self.seasons:
            for k in range(1, order + 1):
                angle = F.col("_hours") * F.lit(2.0 * math.pi * k / period)
                terms += [F.sin(angle), F.cos(angle)]
        terms += [F.col("_hol")] * self.holiday + [F.col("_r")[i] for i in range(len(self.regressors))]
        return sum((F.col("_beta")[i] * x for i, x in enumerate(terms)), F.lit(0.0))

    def trend_variance(self):
        """Of the trend's coefficients at a row, and of the breaks to come."""
        at = F.concat(F.array(F.lit(1.0), F.col("_s")), F.transform("_knots", lambda k: F.greatest(F.col("_s") - k, F.lit(0.0))))
        width = F.size("_knots") + F.lit(2)

        def line(x, i):
            return x * F.aggregate(F.zip_with(F.slice("_cov", i * width + 1, width), at, lambda c, y: c * y), F.lit(0.0), lambda a, y: a + y)
        known = F.aggregate(F.transform(at, line), F.lit(0.0), lambda a, x: a + x)
        return F.greatest(F.coalesce(known, F.lit(0.0)), F.lit(0.0)) + F.col("_rate") * F.pow(F.greatest(F.col("_s") - 1.0, F.lit(0.0)), 3)


def _key_schema(df: DataFrame, keys) -> str:
    return ", ".join(f"`{k}` {t}" for k, t in df.select(*keys).dtypes)


def _sums(rows: DataFrame, keys: list[str], matrix, target) -> DataFrame:
    """Per series: flattened ``X'X``, ``X'y``, ``y'y`` and row count.  Batches
    add up their own rows; Spark adds the batches."""
    def run(batches):
        import pandas as pd
        for b in batches:
            if not len(b):
                continue
            x, y = matrix(b), target(b)
            out = []
            for key, i in b.groupby(keys, dropna=False, sort=False).indices.items():
                xi, yi = x[i], y[i]
                flat = np.concatenate([(xi.T @ xi).ravel(), xi.T @ yi, [yi @ yi, len(yi)]])
                out.append((*(key if isinstance(key, tuple) else (key,)), flat.tolist()))
            yield pd.DataFrame(out, columns=[*keys, "_v"])

    part = rows.mapInPandas(run, _key_schema(rows, keys) + ", _v array<double>")
    return (part.select(*keys, array_to_vector("_v").alias("_v")).groupBy(*keys)
            .agg(Summarizer.sum(F.col("_v")).alias("_v")).select(*keys, vector_to_array("_v").alias("_v")))


def _solved(sums: DataFrame, keys: list[str], p: int, blocks, name: str, periods: Sequence[float] = ()) -> DataFrame:
    """Solutions by series; the first columns are of cycles of ``periods`` and
    have no part (coefficient 0) where the span ``_h0.._h1`` is shorter."""
    def run(batches):
        for b in batches:
            got = []
            spans = b["_h1"] - b["_h0"] if len(periods) else [0.0] * len(b)
            for v, span in zip(b["_v"], spans, strict=True):
                v = np.asarray(v, dtype=float)
                part = np.ones(p)
                part[:len(periods)] = [x <= span + 1 for x in periods]
                got.append(solve_evidence(v[:p * p].reshape(p, p) * np.outer(part, part), v[p * p:p * p + p] * part, v[-2], v[-1], blocks))
            yield b[keys].assign(**{name: [m.tolist() for m, _ in got], f"{name}_sd": [s for _, s in got]})

    return sums.mapInPandas(run, _key_schema(sums, keys) + f", `{name}` array<double>, `{name}_sd` double")


def _trends(sums: DataFrame, des: _Design, periods: Sequence[float], more: int) -> DataFrame:
    """Per series ``_trend`` (intercept, slope, sizes of the breaks), ``_knots``
    (their places), ``_cov`` (of these coefficients, by lines) and ``_rate``: a
    third of what breaks add to the variance of the slope in a train span.
    ``sums`` are of the trend's columns, the hinges of late places and ``more``
    seasonal columns, the first of cycles of ``periods``; late places have a part
    only without these."""
    own = 2 + des.changepoints
    p = own + LATE + more
    knots, late = knots_of(des.changepoints), slice(own, own + LATE)

    def solved(v, span):
        gram, xy = v[:p * p].reshape(p, p), v[p * p:p * p + p]
        seen = np.array([True] * own + [False] * LATE + [2 * x <= span + 1 for x in periods]
                        + [True] * (p - own - LATE - len(periods)))
        ridge = np.zeros(p)
        ridge[1], ridge[own:] = SLOPE_PRIOR ** -2, SEASONALITY_PRIOR ** -2
        coef, cov, noise = solve_sparse(gram[np.ix_(seen, seen)], xy[seen], v[-2], v[-1], slice(2, own), ridge[seen])
        found = np.flatnonzero(coef[2:own])
        places, often = knots[found], 0.0
        use = [0, 1, *(2 + found)]
        if len(found):
            often = len(found) / CHANGEPOINT_RANGE * 2 * float(np.abs(coef[2 + found]).mean()) ** 2
        if len(found) and not more:  # the late places join in, with the variance that such breaks have there
            ridge[late] = 1 / max(often * (1 - CHANGEPOINT_RANGE) / LATE, 1e-12)
            use, places = [*use, *range(own, own + LATE)], [*places, *_LATE]
            every = np.concatenate([use, np.flatnonzero(seen[own:]) + own]).astype(int)
            m = gram[np.ix_(every, every)] + np.diag(noise * ridge[every] + 1e-9 * np.maximum(np.diag(gram)[every], 1e-9))
            inverse = np.linalg.pinv(m, hermitian=True)
            coef, cov = inverse @ xy[every], noise * inverse
            use = list(range(len(use)))
        return coef[use].tolist(), list(places), cov[np.ix_(use, use)].ravel().tolist(), often / 3, math.sqrt(noise)

    def run(batches):
        import pandas as pd
        for b in batches:
            got = [solved(np.asarray(v, dtype=float), h) for v, h in zip(b["_v"], b["_h1"] - b["_h0"], strict=True)]
            yield pd.concat([b[des.keys].reset_index(drop=True),
                             pd.DataFrame(got, columns=["_trend", "_knots", "_cov", "_rate", "_sd"])], axis=1)

    arrays = ", ".join(f"{c} array<double>" for c in ("_trend", "_knots", "_cov"))
    return sums.mapInPandas(run, _key_schema(sums, des.keys) + f", {arrays}, _rate double, _sd double")


def fit_seasonal(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, value: str = "load_mw",
                 regressors: Sequence[str] = ("temp", "rhum", "wspd"), seasons=SEASONS, holiday: bool = True,
                 changepoints: int = CHANGEPOINTS, priors: bool = True) -> DataFrame:
    """Per series: scales ``_h0, _h1, _scale, _m_*, _s_*``, the trend's
    ``_trend, _knots, _cov, _rate``, the ``_beta`` coefficients and the residual
    deviation ``sigma`` (in units of ``value``).  Without ``priors`` both fits
    are plain least squares, with all changepoints in."""
    des = _Design(keys, ts, value, regressors, seasons, holiday, changepoints, priors)
    keys = des.keys
    train = df.filter(F.col(value).isNotNull() & F.col(ts).isNotNull())
    bounds = des.bounds(train)
    rows = des.rows(train, bounds).withColumn("_y", F.col(value) / F.col("_scale"))
    slim = materialize(rows.select(*keys, ts, "_s", "_hours", "_hol", "_r", "_y"))  # read by both passes
    y = lambda b: b["_y"].to_numpy(float)

    def hinged(b):
        return trend_matrix(b["_s"].to_numpy(float), changepoints)

    def late(b):
        return np.maximum(0.0, b["_s"].to_numpy(float)[:, None] - _LATE)
    spans, p = bounds.select(*keys, "_h0", "_h1"), des.season_blocks[-1][1] if des.season_blocks else 0
    if priors:
        both = _sums(slim.drop(ts), keys, lambda b: np.hstack([hinged(b), late(b), des.season(b)]), y)
        trend = _trends(both.join(spans, keys), des, des.periods, p)
    else:
        trend = _solved(_sums(slim.drop(ts), keys, hinged, y), keys, 2 + changepoints, des.trend_blocks, "_trend")
        trend = trend.select(*keys, "_trend", F.lit(knots_of(changepoints).tolist()).cast("array<double>").alias("_knots"),
                             F.array().cast("array<double>").alias("_cov"), F.lit(0.0).alias("_rate"))
    trend = materialize(trend)  # a row per series
    around = O.join_by_block(slim, trend, keys, ts).select(*keys, "_hours", "_hol", "_r", "_y", des.trend_value().alias("_g"))
    beta = _sums(around, keys, lambda b: des.season(b) * b["_g"].to_numpy(float)[:, None], lambda b: y(b) - b["_g"].to_numpy(float))
    beta = materialize(_solved(beta.join(spans, keys), keys, p, des.season_blocks, "_beta", des.periods))
    if priors and p:  # the trend again, now under its seasonality
        around = O.join_by_block(slim, beta, keys, ts).select(*keys, "_s", "_y", (1.0 + des.season_value()).alias("_x"))
        under = _sums(around, keys, lambda b: np.hstack([hinged(b), late(b)]) * b["_x"].to_numpy(float)[:, None], y)
        trend = _trends(under.join(spans, keys), des, (), 0)
    sigma = F.col("_scale") * F.col("_sd" if priors else "_beta_sd")
    return bounds.join(trend, keys).join(beta, keys).withColumn("sigma", sigma).drop("_beta_sd", "_sd")


def predict_seasonal(df: DataFrame, coefs: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS,
                     regressors: Sequence[str] = ("temp", "rhum", "wspd"), interval_width: float = INTERVAL_WIDTH,
                     seasons=SEASONS, holiday: bool = True, changepoints: int = CHANGEPOINTS,
                     keep: Sequence[str] = ()) -> DataFrame:
    """``keys, ts, yhat, yhat_lower, yhat_upper`` and the ``keep`` columns for
    every row of ``df`` (history or a future frame).  The coefficient table has
    one row per series; rows meet it by time block."""
    des = _Design(keys, ts, "", regressors, seasons, holiday, changepoints, True)
    z = NormalDist().inv_cdf(0.5 + interval_width / 2.0)
    kept = [*des.keys, ts, *keep]
    rows = des.rows(df, coefs).withColumns({"_g": des.trend_value(), "_x": 1.0 + des.season_value(), "_v": des.trend_variance()})
    half = F.lit(z) * F.sqrt(F.col("sigma") ** 2 + (F.col("_scale") * F.col("_x")) ** 2 * F.col("_v"))
    return (rows.withColumns({"yhat": F.col("_g") * F.col("_x") * F.col("_scale"), "_half": half})
            .select(*kept, "yhat", (F.col("yhat") - F.col("_half")).alias("yhat_lower"),
                    (F.col("yhat") + F.col("_half")).alias("yhat_upper")))


def seasonal_regression(train: DataFrame, test: DataFrame, horizon: int = 72, keys: Sequence[str] = KEYS,
                        ts: str = TS, value: str = "load_mw",
                        regressors: Sequence[str] = ("temp", "rhum", "wspd"),
                        interval_width: float = INTERVAL_WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fit on train; score test (``y`` kept for metrics); forecast
    ``horizon`` hours after the last test stamp with regressors held at
    their test means.  Returns ``(coefs, test_pred, future_pred)``; the small
    coefficient table is written once (both predictions read it)."""
    from ..operators.metrics import exog_means
    from .report import future_frame
    coefs = materialize(fit_seasonal(train, keys, ts, value, regressors))
    tp = predict_seasonal(test.withColumn("y", F.col(value)), coefs, keys, ts, regressors, interval_width, keep=["y"])
    fut = future_frame(test, horizon, exog_means(test, regressors), keys, ts)
    fp = predict_seasonal(fut, coefs, keys, ts, regressors, interval_width)
    return coefs, tp, fp


def seasonal_run(predictions: DataFrame, experiment: str = "seasonal", interval_width: float = INTERVAL_WIDTH) -> DataFrame:
    """A scored test frame (``y, yhat``) as a run record with the fixed
    settings of the fit."""
    from ..operators.metrics import evaluate_models
    from ..sources.runs import run_records
    scored = predictions.select(F.lit("prophet").alias("model"), "y", F.col("yhat").alias("p"))
    return run_records(evaluate_models(scored, rounded=False), experiment, {
        "changepoint_prior_scale": CHANGEPOINT_PRIOR, "seasonality_prior_scale": SEASONALITY_PRIOR,
        "seasonality_mode": "multiplicative", "interval_width": interval_width})
