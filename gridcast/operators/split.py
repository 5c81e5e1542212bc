"""Chronological splits, walk-forward folds, slices and heads (P3, P4, W8,
K4, W9's cousin)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEYS, SPLIT_DATE, TS


def _ts_lit(value: str):
    return F.lit(value).cast("timestamp")


def split_cutoff(df: DataFrame, cutoff: str = SPLIT_DATE, ts: str = TS) -> tuple[DataFrame, DataFrame]:
    """``ts < cutoff`` is train, ``ts >= cutoff`` test.  Two filters over
    one lineage; both push down to a Parquet scan."""
    c = _ts_lit(cutoff)
    return df.filter(F.col(ts) < c), df.filter(F.col(ts) >= c)


def slice_range(df: DataFrame, start: str, end: str, whole_last_day: bool = True, ts: str = TS) -> DataFrame:
    """Inclusive date range; with ``whole_last_day`` the end day's last
    23 hours are kept too (one page of the reference does, the other not)."""
    lo = F.lit(start).cast("timestamp")
    hi = F.lit(end).cast("timestamp")
    if whole_last_day:
        hi = hi + F.expr("INTERVAL 23 HOURS")
    return df.filter(F.col(ts).between(lo, hi))


def timestamp_index(df: DataFrame, ts: str = TS) -> DataFrame:
    """0-based rank of each distinct timestamp across the panel (``ts,
    idx``) and the count ``n``.  Distributed: distinct stamps are counted per
    day, the small per-day table is prefix-summed, a ``row_number`` inside
    each day adds the offset.  No single-partition window over rows."""
    stamps = df.select(ts).distinct().withColumn("_day", F.to_date(ts))
    per_day = stamps.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    # per_day has one row per calendar day of the span: small by construction.
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offs = per_day.select("_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                          F.sum("_n").over(Window.partitionBy()).alias("n"))
    s = stamps.join(F.broadcast(offs), "_day")
    inside = Window.partitionBy("_day").orderBy(ts)
    return s.select(ts, (F.col("_off") + F.row_number().over(inside) - 1).alias("idx"), "n")


def fold_index(df: DataFrame, n_splits: int = 5, ts: str = TS) -> DataFrame:
    """W8, compact form: ``val_fold`` = the fold whose validation block
    holds the row (null: the row only ever trains).  Row r trains in fold f
    when ``val_fold`` is null or < f.  Folds follow expanding-window
    time-series CV: block size ``t = n // (k+1)``, validation of fold ``i``
    is ``[n-(k-i)t, n-(k-i-1)t)`` over the distinct-timestamp index."""
    idx = timestamp_index(df, ts)
    d = df.join(idx, ts)
    t = F.floor(F.col("n") / F.lit(n_splits + 1))
    first = F.col("n") - F.lit(n_splits) * t
    vf = F.when((t > 0) & (F.col("idx") >= first), F.floor((F.col("idx") - first) / t)).cast("int")
    return d.withColumn("val_fold", vf).drop("n")


def walk_forward_folds(df: DataFrame, n_splits: int = 5, ts: str = TS) -> DataFrame:
    """W8, long form: one row per (row, fold it takes part in) with ``fold``
    and ``role`` ('train' / 'validate').  Rows after a fold's validation
    block are not part of that fold."""
    d = fold_index(df, n_splits, ts)
    folds = F.sequence(F.lit(0), F.lit(n_splits - 1))
    d = d.withColumn("fold", F.explode(folds))
    vf = F.col("val_fold")
    role = F.when(vf == F.col("fold"), "validate").when(vf.isNull() | (vf < F.col("fold")), "train")
    return d.withColumn("role", role).filter(F.col("role").isNotNull()).drop("val_fold")


def head_sample(df: DataFrame, n: int = 500, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """K4: the first ``n`` rows of each series in time order (deterministic,
    not random).  A rank limit: every task keeps at most ``n`` rows per series
    before the exchange."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(ts))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
