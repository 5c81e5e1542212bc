"""Registered queries (one per operator of the inventory) and their DuckDB
oracles.  Each query takes ``(spark, sf_dir)`` and returns a DataFrame; each
oracle is one SQL statement over the driver's pre-registered views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as S
from .operators import clean as C
from .operators import metrics as M
from .operators import split as SP
from .plans import evaluate as PE
from .plans import features as PF
from .session import HUGE_METHOD
from .sources import fixtures as FX
from .testing import stable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def ensure_utc(spark: SparkSession) -> None:
    """Naive timestamps keep their wall clock only under a UTC session (no
    DST gaps or repeats in hourly arithmetic): the package's contract."""
    if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def ensure_compiled(spark: SparkSession) -> None:
    """HotSpot never compiles a method over 8000 bytes: stages that generate one
    run without whole-stage code, unless the session has a limit of its own."""
    if spark.conf.get(HUGE_METHOD[0]) == "65535":  # Spark's default
        spark.conf.set(*HUGE_METHOD)


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ensure_utc(spark)
            ensure_compiled(spark)
            return fn(spark, sf)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def _features(spark, sf, materialize: bool = True):
    """The dense-panel feature frame.  Operators downstream of it read it more
    than once (numbering, two-pass statistics, fits), so by default it is
    materialised once with a reliable checkpoint instead of re-running the
    feature plan in every branch."""
    f = PF.build_features(FX.dense_panel(spark, sf), FX.weather(spark, sf))
    if materialize:
        from .session import materialize as _m
        f = _m(f)
    return f


# --- M2 / P1 ------------------------------------------------------------------

@register("build_features", f"WITH {S.features_sql()} SELECT series_id, ts, {S.rounded_features()} FROM feat")
def build_features(spark: SparkSession, sf: str) -> DataFrame:
    return stable(_features(spark, sf, materialize=False))


@register("select_features", f"WITH {S.features_sql()} SELECT {S.rounded_features()} FROM feat")
def select_features(spark, sf):
    return stable(PF.select_features(_features(spark, sf, materialize=False)))


# --- cleaning: A1, A2, A3, J2, W6, F5, M1 -------------------------------------

@register("dedupe_mean", f"SELECT series_id, ts, {S.rnd('avg(load_mw)', 'load_mw')} FROM ({S.DUP}) s GROUP BY 1, 2")
def dedupe_mean(spark, sf):
    return stable(C.dedupe_mean(FX.dup_panel(spark, sf)))


@register("reindex_hourly", f"WITH {S.clean_ctes(S.SPARSE)} SELECT series_id, ts, {S.rnd('v', 'load_mw')} FROM g")
def reindex_hourly(spark, sf):
    return stable(C.reindex_hourly(FX.sparse_panel(spark, sf)))


@register("interpolate_gaps", f"WITH {S.clean_ctes(S.SPARSE)} SELECT series_id, ts, {S.rnd('iv', 'load_mw')} FROM k")
def interpolate_gaps(spark, sf):
    from .session import materialize
    grid = materialize(C.reindex_hourly(FX.sparse_panel(spark, sf)))  # the full grid is read four times
    return stable(C.interpolate_gaps(grid))


@register("series_stats", f"WITH {S.clean_ctes(S.DENSE)} SELECT series_id, {S.rnd('mu', 'mean')}, {S.rnd('sd', 'std')} FROM st")
def series_stats(spark, sf):
    return stable(C.series_stats(C.fill_series(FX.dense_panel(spark, sf))))


@register("clip_outliers", f"WITH {S.clean_ctes(S.DENSE)} SELECT series_id, ts, {S.rnd('load_mw', 'load_mw')}, outlier_flag FROM cl")
def clip_outliers(spark, sf):
    return stable(C.clip_outliers(C.fill_series(FX.dense_panel(spark, sf))))


@register("regularize", f"WITH {S.clean_ctes(S.SPARSE)} SELECT series_id, ts, {S.rnd('load_mw', 'load_mw')}, outlier_flag FROM cl")
def regularize(spark, sf):
    return stable(C.regularize(FX.sparse_panel(spark, sf)))


@register("regularize_duplicates", f"WITH {S.clean_ctes(S.DUP)} SELECT series_id, ts, {S.rnd('load_mw', 'load_mw')}, outlier_flag FROM cl")
def regularize_duplicates(spark, sf):
    return stable(C.regularize(FX.dup_panel(spark, sf)))


@register("regularize_offgrid", f"WITH {S.clean_ctes(S.OFFGRID)} SELECT series_id, ts, {S.rnd('load_mw', 'load_mw')}, outlier_flag FROM cl")
def regularize_offgrid(spark, sf):
    return stable(C.regularize(FX.offgrid_panel(spark, sf)))


@register("quality_report", f"""WITH {S.clean_ctes(S.DUP)},
r AS (SELECT series_id, count(*) AS n_rows, count(DISTINCT ts) AS nd, min(ts) AS ts_min, max(ts) AS ts_max
      FROM ({S.DUP}) s GROUP BY 1),
c AS (SELECT series_id, CAST(sum(outlier_flag) AS BIGINT) AS n_outliers, count(*) AS n_clean FROM cl GROUP BY 1)
SELECT r.series_id, n_rows, n_rows - nd AS n_duplicates,
       CAST(floor(epoch(ts_max - ts_min) / 3600) AS BIGINT) + 1 - nd AS n_missing, ts_min, ts_max, n_outliers, n_clean
FROM r LEFT JOIN c ON r.series_id = c.series_id""")
def quality_report(spark, sf):
    raw = FX.dup_panel(spark, sf)
    return C.quality_report(raw, C.regularize(raw))


# --- predictions, splits, metrics: P3, P5, W8, A5-A11, A15, F7, K2, K4 --------

def _preds(spark, sf, materialize: bool = False):
    """Lag predictions; ``materialize`` where the plan reads them twice."""
    return PE.lag_predictions(_features(spark, sf, materialize))


_PRED = S.predictions_sql()


@register("split_cutoff", f"""WITH {S.features_sql()}
SELECT series_id, ts, CASE WHEN ts < {S.CUTOFF} THEN 'train' ELSE 'test' END AS split, {S.rnd('load_mw', 'load_mw')}
FROM feat""")
def split_cutoff(spark, sf):
    f = _features(spark, sf, materialize=False)
    train, test = SP.split_cutoff(f, FX.CUTOFF)
    out = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return stable(out.select("series_id", "ts", "split", "load_mw"))


@register("walk_forward_folds", f"""WITH {S.features_sql()},
st AS (SELECT DISTINCT ts FROM feat),
ix AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS idx, count(*) OVER () AS n FROM st),
fx AS (SELECT f.series_id, f.ts, ix.idx, ix.n, ix.n // 6 AS t FROM feat f JOIN ix ON f.ts = ix.ts),
vf AS (SELECT *, CASE WHEN t > 0 AND idx >= n - 5 * t THEN CAST((idx - (n - 5 * t)) // t AS INTEGER) END AS val_fold
       FROM fx),
ex AS (SELECT series_id, ts, idx, val_fold, CAST(unnest(range(0, 5)) AS INTEGER) AS fold FROM vf)
SELECT series_id, ts, idx, fold,
       CASE WHEN val_fold = fold THEN 'validate' ELSE 'train' END AS role
FROM ex WHERE val_fold = fold OR val_fold IS NULL OR val_fold < fold""")
def walk_forward_folds(spark, sf):
    return SP.walk_forward_folds(_features(spark, sf).select("series_id", "ts"), 5) \
             .select("series_id", "ts", "idx", F.col("fold").cast("int").alias("fold"), "role")


@register("residuals", f"WITH {_PRED} SELECT model, series_id, ts, {S.rnd('y - p', 'resid')} FROM preds")
def residuals(spark, sf):
    return stable(M.residuals(_preds(spark, sf)).select("model", "series_id", "ts", "resid"))


@register("mask_nonzero", f"WITH {_PRED} SELECT model, count(*) AS n_usable FROM preds WHERE y <> 0 AND p IS NOT NULL GROUP BY model")
def mask_nonzero(spark, sf):
    p = _preds(spark, sf)
    return p.filter((F.col("y") != 0) & F.col("p").isNotNull()).groupBy("model").agg(F.count(F.lit(1)).alias("n_usable"))


for _k in ("mae", "rmse", "mape", "r2"):
    def _one(spark, sf, _k=_k):
        p = _preds(spark, sf).filter(F.col("y").isNotNull() & F.col("p").isNotNull())
        fn = getattr(M, _k)
        return stable(p.groupBy("model").agg(fn(F.col("y"), F.col("p")).alias(_k)))
    register(f"metric_{_k}", f"WITH {_PRED}, {S.metrics_cte()} SELECT model, {S.rnd(_k, _k)} FROM m")(_one)


@register("evaluate_models", f"WITH {_PRED}, {S.metrics_cte()} SELECT model, {S.snapped_metrics()}, n FROM m")
def evaluate_models(spark, sf):
    return stable(M.evaluate_models(_preds(spark, sf), rounded=False))


@register("evaluate_by_series", f"""WITH {_PRED},
m AS (SELECT model, series_id, {', '.join(f'{v} AS {k}' for k, v in S.metric_exprs().items())}, count(*) AS n
      FROM preds WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY model, series_id)
SELECT model, series_id, {S.snapped_metrics()}, n FROM m""")
def evaluate_by_series(spark, sf):
    return stable(M.evaluate_models(_preds(spark, sf), by=("model", "series_id"), rounded=False))


@register("best_model", f"""WITH {_PRED}, {S.metrics_cte()}
SELECT model AS best_model, {S.rnd('mae', 'mae')} FROM m ORDER BY mae, model LIMIT 1""")
def best_model(spark, sf):
    return stable(M.best_model(M.evaluate_models(_preds(spark, sf), rounded=False)))


@register("best_per_metric", f"""WITH {_PRED}, {S.metrics_cte()},
l AS (SELECT model, 'mae' AS metric, mae AS value FROM m UNION ALL SELECT model, 'rmse', rmse FROM m
      UNION ALL SELECT model, 'mape', mape FROM m),
r AS (SELECT metric, model, value, row_number() OVER (PARTITION BY metric ORDER BY value, model) AS rk
      FROM l WHERE value IS NOT NULL)
SELECT metric, model, {S.rnd('value', 'value')} FROM r WHERE rk = 1""")
def best_per_metric(spark, sf):
    return stable(M.best_per_metric(M.evaluate_models(_preds(spark, sf), rounded=False)))


@register("leaderboard", f"""WITH {_PRED}, {S.metrics_cte()}
SELECT model AS "Model", {S.rnd('mae', '"MAE (MW)"')}, {S.rnd('rmse', '"RMSE (MW)"')},
       {S.rnd('mape', '"MAPE (%)"')}, {S.rnd('r2', '"R2"')}, mae = min(mae) OVER () AS is_best FROM m""")
def leaderboard(spark, sf):
    return stable(M.leaderboard(M.evaluate_models(_preds(spark, sf), rounded=False)))


@register("residual_histogram", f"""WITH {_PRED},
rr AS (SELECT model, y - p AS resid FROM preds WHERE y IS NOT NULL AND p IS NOT NULL),
rg AS (SELECT model, min(resid) AS lo, max(resid) AS hi FROM rr GROUP BY model),
rb AS (SELECT rr.model, rg.lo, rg.hi,
        CAST(CASE WHEN rg.hi - rg.lo = 0 THEN 0 ELSE least(floor((rr.resid - rg.lo) / (rg.hi - rg.lo) * 80.0), 79) END
             AS INTEGER) AS bin
      FROM rr JOIN rg ON rr.model = rg.model)
SELECT model, bin, {S.rnd('lo + (hi - lo) / 80.0 * bin', 'bin_lo')}, {S.rnd('lo + (hi - lo) / 80.0 * (bin + 1)', 'bin_hi')},
       count(*) AS count
FROM rb GROUP BY model, bin, lo, hi""")
def residual_histogram(spark, sf):
    return stable(M.residual_histogram(_preds(spark, sf, True)))


@register("head_sample", f"""WITH {S.features_sql()},
r AS (SELECT series_id, ts, load_mw, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn
      FROM feat WHERE ts >= {S.CUTOFF})
SELECT series_id, ts, {S.rnd('load_mw', 'load_mw')} FROM r WHERE rn <= 500""")
def head_sample(spark, sf):
    _, test = SP.split_cutoff(_features(spark, sf, materialize=False), FX.CUTOFF)
    return stable(SP.head_sample(test.select("series_id", "ts", "load_mw"), 500))


@register("build_features_users", f"""WITH {S.features_sql(load=S.SPARSE)}
SELECT series_id, ts, {S.rounded_features()} FROM fg""")
def build_features_users(spark, sf):
    """The 22 features of every user's series (rows grow with the events);
    incomplete rows stay, as most users have under 168 stamps."""
    return stable(PF.build_features(FX.sparse_panel(spark, sf), FX.weather(spark, sf), dropna=False))


from . import queries_ops  # noqa: E402,F401  (registers part 2)
from . import queries_models  # noqa: E402,F401  (registers part 3)
