"""Error metrics, leaderboards and summaries.

Predictions travel in one long table ``(model, [keys], ts, y, p)`` so all
models are scored in one aggregation pass (partial aggregates map-side, one
small shuffle on ``model``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import display_name
from ..schema import METRIC_NAMES
from ..session import materialize

#: Rows of a range table that is broadcast without asking Spark.
RANGES = 10_000


def residuals(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """``resid = y - p``."""
    return df.withColumn("resid", F.col(y) - F.col(p))


def mae(y: Column, p: Column) -> Column:
    """A5."""
    return F.avg(F.abs(y - p))


def rmse(y: Column, p: Column) -> Column:
    """A6."""
    return F.sqrt(F.avg((y - p) * (y - p)))


def mape(y: Column, p: Column) -> Column:
    """A7 (with P5): mean |(y-p)/y| ×100 over rows with y ≠ 0; null when no
    row qualifies."""
    return F.avg(F.when(y != 0, F.abs((y - p) / y))) * F.lit(100.0)


def r2(y: Column, p: Column) -> Column:
    """1 − SSE/SST; SST = 0 gives 1 when SSE = 0, else 0."""
    sse = F.sum((y - p) * (y - p))
    sst = F.var_pop(y) * F.count(y)
    return F.when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))) \
            .otherwise(F.lit(1.0) - sse / sst)


def metric_columns(y: str = "y", p: str = "p") -> list[Column]:
    yc, pc = F.col(y), F.col(p)
    return [mae(yc, pc).alias("mae"), rmse(yc, pc).alias("rmse"), mape(yc, pc).alias("mape"),
            r2(yc, pc).alias("r2"), F.count(F.lit(1)).alias("n")]


def evaluate_models(preds: DataFrame, by: Sequence[str] = ("model",), y: str = "y", p: str = "p",
                    rounded: bool = True) -> DataFrame:
    """MAE, RMSE, MAPE, R² (and row count) per model in one pass.  Rows
    with a null prediction or actual are skipped.  ``rounded`` applies the
    reference's reporting precision (2 digits for MAE / RMSE, 4 for MAPE / R²)."""
    d = preds.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    m = d.groupBy(*by).agg(*metric_columns(y, p))
    if rounded:
        m = m.withColumns({"mae": F.round("mae", 2), "rmse": F.round("rmse", 2),
                           "mape": F.round("mape", 4), "r2": F.round("r2", 4)})
    return m


def best_model(metrics: DataFrame) -> DataFrame:
    """A10: the model with the lowest MAE (ties: first by name).  The input
    has one row per model."""
    return metrics.orderBy(F.col("mae").asc_nulls_last(), "model").limit(1) \
                  .select(F.col("model").alias("best_model"), "mae")


def best_per_metric(metrics: DataFrame, names: Sequence[str] = ("mae", "rmse", "mape")) -> DataFrame:
    """For each error metric, the best (lowest) model and its value."""
    long = metrics.unpivot("model", list(names), "metric", "value").filter(F.col("value").isNotNull())
    return long.groupBy("metric").agg(
        F.min_by("model", F.struct("value", "model")).alias("model"), F.min("value").alias("value"))


def leaderboard(metrics: DataFrame) -> DataFrame:
    """K2: display names, sorted by MAE ascending, ``is_best`` on the top
    row.  The metrics table has one row per model (tiny), so the unpartitioned
    window runs on a handful of rows."""
    best = F.min("mae").over(Window.partitionBy())
    return (metrics.select(display_name(F.col("model")).alias("Model"),
                           *[F.col(k).alias(v) for k, v in METRIC_NAMES.items()],
                           (F.col("mae") == best).alias("is_best"))
                   .orderBy(F.col(METRIC_NAMES["mae"]).asc_nulls_last(), "Model"))


def residual_histogram(preds: DataFrame, bins: int = 80, by: Sequence[str] = ("model",),
                       y: str = "y", p: str = "p") -> DataFrame:
    """Equal-width histogram of residuals per model; the maximum falls
    in the last bin; min = max gives a single bin.  Two passes: a min/max
    aggregate, written once (one row per model), then a grouped count.  The
    ranges are broadcast if they are at most ``RANGES`` rows; beyond, the join
    is Spark's choice."""
    by = list(by)
    r = residuals(preds.filter(F.col(y).isNotNull() & F.col(p).isNotNull()), y, p)
    rng = r.groupBy(*by).agg(F.min("resid").alias("_lo"), F.max("resid").alias("_hi"))
    rng = materialize(rng)
    d = r.join(F.broadcast(rng) if rng.count() <= RANGES else rng, by)
    width = F.col("_hi") - F.col("_lo")
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("resid") - F.col("_lo")) / width * F.lit(float(bins))), F.lit(bins - 1)))
    h = d.groupBy(*by, b.cast("int").alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("count"))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    return h.select(*by, "bin", (F.col("_lo") + step * F.col("bin")).alias("bin_lo"),
                    (F.col("_lo") + step * (F.col("bin") + 1)).alias("bin_hi"), "count")


def load_kpis(df: DataFrame, value: str = "load_mw", by: Sequence[str] = ()) -> DataFrame:
    """A4: row count, mean, max, min load."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total_hours"), F.avg(value).alias("avg_load"),
                               F.max(value).alias("peak_load"), F.min(value).alias("min_load"))


def exog_means(df: DataFrame, cols: Sequence[str] = ("temp", "rhum", "wspd"),
               by: Sequence[str] = ()) -> DataFrame:
    """Mean of each regressor (used to hold them constant in the future)."""
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols])


def mean_abs_contribution(contrib: DataFrame, by: Sequence[str] = ("feature",),
                          value: str = "contribution") -> DataFrame:
    """Mean |contribution| per feature."""
    return contrib.groupBy(*by).agg(F.avg(F.abs(value)).alias("mean_abs_contribution"))


def top_features(importance: DataFrame, n: int = 20, value: str = "importance") -> DataFrame:
    """K3: the ``n`` largest by importance (ties by name); a top-k report, so
    the limit is the feature (TakeOrderedAndProject keeps n rows per task)."""
    return importance.orderBy(F.col(value).desc(), F.col("feature")).limit(n)
