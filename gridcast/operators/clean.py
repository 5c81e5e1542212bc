"""Series cleaning.

Reference semantics (one series, generalised to a panel):

1. duplicate stamps collapse to their mean;
2. the series is re-indexed to the hourly grid ``min + k·1h`` up to ``max``
   (stamps off that grid vanish);
3. time-linear interpolation fills at most ``limit`` hours into every gap
   (the first ``limit`` of a longer gap, on the slope of the whole gap); a
   trailing run after the last known value carries that value, a leading run
   stays empty;
4. ``|z| > 5`` is flagged and clipped to ``mean ± 5·std`` (sample std);
5. rows still empty are dropped.

:func:`regularize` never materialises the grid: it generates only the (at
most ``limit``) filled hours per gap from consecutive known rows, so a
10,000-hour gap costs six rows, not ten thousand.  :func:`reindex_hourly` +
:func:`interpolate_gaps` are the grid-shaped operators for callers who want
the full grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import INTERP_LIMIT, KEYS, TARGET, TS, Z_CLIP
from . import ordered as O

HOUR = 3600


def _secs(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c) / F.lit(1_000_000.0)


def dedupe_mean(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, value: str = TARGET) -> DataFrame:
    """A1: one row per ``(series, ts)`` with the mean of the duplicates.
    Partial aggregation runs map-side, so a hot series is pre-reduced before
    the shuffle."""
    return df.groupBy(*keys, ts).agg(F.avg(value).alias(value))


def grid_bounds(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """Per series: grid start ``_g0`` (first stamp) and last grid point
    ``_g1`` (``_g0`` + whole hours up to the last stamp).  One row per
    series."""
    b = df.groupBy(*keys).agg(F.min(ts).alias("_g0"), F.max(ts).alias("_tmax"))
    whole = F.floor((_secs("_tmax") - _secs("_g0")) / F.lit(HOUR)).cast("long")
    return b.select(*keys, "_g0", F.timestamp_add("HOUR", whole, F.col("_g0")).alias("_g1"))


def _with_grid(df: DataFrame, source: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Attach ``_g0`` and ``_g1`` (see :func:`grid_bounds`) by time block: the
    bounds of ``source``'s blocks are a small map-side aggregate, widened to
    the series over the blocks; rows are exchanged by ``(series, block)``."""
    blk = O._block(ts, O.DEFAULT_BLOCK_HOURS)
    per = source.groupBy(*keys, blk.alias("_blk")).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    w = Window.partitionBy(*keys)
    per = per.select(*keys, "_blk", F.min("_lo").over(w).alias("_g0"), F.max("_hi").over(w).alias("_tmax"))
    whole = F.floor((_secs("_tmax") - _secs("_g0")) / F.lit(HOUR)).cast("long")
    per = per.select(*keys, "_blk", "_g0", F.timestamp_add("HOUR", whole, F.col("_g0")).alias("_g1"))
    return df.withColumn("_blk", blk).join(per, [*keys, "_blk"]).drop("_blk")


def _on_grid(ts: str) -> Column:
    return F.pmod(F.unix_micros(F.col(ts)) - F.unix_micros(F.col("_g0")), F.lit(HOUR * 1_000_000)) == 0


def reindex_hourly(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, value: str = TARGET) -> DataFrame:
    """The full hourly grid of each series, data left-joined onto it
    (``value`` null where nothing is known).  Input stamps must be unique
    per series (run :func:`dedupe_mean` first)."""
    keys = list(keys)
    b = grid_bounds(df, keys, ts)
    grid = b.select(*keys, F.explode(F.sequence("_g0", "_g1", F.expr("INTERVAL 1 HOUR"))).alias(ts))
    return grid.join(df.select(*keys, ts, value), [*keys, ts], "left")


def _gap_fills(known: DataFrame, keys: list[str], ts: str, value: str,
               limit: int, with_known: bool = False) -> DataFrame:
    """Rows to add after each known row: ``k = 1..min(limit, gap)`` hours,
    interpolated towards the next known row, or carried after the last one
    (up to the grid end ``_g1``, a column of ``known``).  ``with_known`` also emits the known row
    itself (``k = 0``) from the same pass."""
    d = O.with_positions(known, keys, ts, lead=[value])
    d = d.withColumnsRenamed({"_next_ts": "_nt", f"_next_{value}": "_nv"}).drop(O.POS)
    gap = F.when(F.col("_nt").isNotNull(), (_secs("_nt") - _secs(ts)) / F.lit(HOUR) - 1) \
           .otherwise((_secs("_g1") - _secs(ts)) / F.lit(HOUR))
    d = d.withColumn("_n", F.least(F.floor(gap).cast("int"), F.lit(limit)))
    first = 0 if with_known else 1
    if not with_known:
        d = d.filter(F.col("_n") >= 1)
    d = d.withColumn("_k", F.explode(F.sequence(F.lit(first), F.greatest(F.col("_n"), F.lit(first)))))
    t_k = F.timestamp_add("HOUR", F.col("_k"), F.col(ts))
    pv, nv = F.col(value), F.col("_nv")
    interp = pv + (nv - pv) * (_secs(t_k) - _secs(ts)) / (_secs("_nt") - _secs(ts))
    v = F.when((F.col("_k") > 0) & F.col("_nt").isNotNull(), interp).otherwise(pv)
    return d.select(*keys, t_k.alias(ts), v.alias(value))


def interpolate_gaps(grid: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, value: str = TARGET,
                     limit: int = INTERP_LIMIT) -> DataFrame:
    """W6 on a grid frame (output of :func:`reindex_hourly`): nulls at most
    ``limit`` hours after a known value are filled; the others stay null."""
    keys = list(keys)
    known = _with_grid(grid.filter(F.col(value).isNotNull()).select(*keys, ts, value), grid, keys, ts).drop("_g0")
    fills = _gap_fills(known, keys, ts, value, limit).withColumnRenamed(value, "_fill")
    out = grid.join(fills, [*keys, ts], "left")
    return out.withColumn(value, F.coalesce(F.col(value), F.col("_fill"))).drop("_fill")


def series_stats(df: DataFrame, keys: Sequence[str] = KEYS, value: str = TARGET) -> DataFrame:
    """A3: per-series mean and sample std (nulls skipped)."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def clip_outliers(df: DataFrame, stats: DataFrame | None = None, keys: Sequence[str] = KEYS,
                  value: str = TARGET, z: float = Z_CLIP, ts: str = TS) -> DataFrame:
    """F5 (+ J6): ``outlier_flag`` = ``|x-mean|/std > z``; value clipped to
    ``mean ± z·std``.  Null values are dropped first (``least/greatest``
    would otherwise turn a null into a bound).  The stats table has one row
    per series; with a ``ts`` column the rows meet it by time block, never by
    series alone."""
    keys = list(keys)
    df = df.filter(F.col(value).isNotNull())
    s = stats if stats is not None else series_stats(df, keys, value)
    s = s.select(*keys, F.col("mean").alias("_mu"), F.col("std").alias("_sd"))
    d = O.join_by_block(df, s, keys, ts) if ts in df.columns else df.join(s, keys)
    x, mu, sd = F.col(value), F.col("_mu"), F.col("_sd")
    zc = F.abs(F.try_divide(x - mu, sd))
    lo, hi = mu - F.lit(z) * sd, mu + F.lit(z) * sd
    return (d.withColumn("outlier_flag", F.coalesce(zc > F.lit(z), F.lit(False)).cast("int"))
             .withColumn(value, F.least(F.greatest(x, lo), hi))
             .drop("_mu", "_sd"))


def regularize(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, value: str = TARGET,
               limit: int = INTERP_LIMIT, z: float = Z_CLIP, materialize: bool = True) -> DataFrame:
    """M1: dedupe → hourly grid → interpolate (≤ ``limit`` h) → flag / clip →
    drop empty.  Output ``keys, ts, value, outlier_flag``.

    The clip needs statistics of the *filled* rows, so the filled rows are
    read twice; with ``materialize`` they are checkpointed once (reliable,
    into ``spark.checkpoint.dir``) instead of recomputing dedupe and the
    ordering shuffle for the statistics."""
    filled = fill_series(df, keys, ts, value, limit, materialize)
    if materialize:
        from ..session import materialize as _materialize
        filled = _materialize(filled)
    return clip_outliers(filled, None, keys, value, z, ts).select(*keys, ts, value, "outlier_flag")


def quality_report(raw: DataFrame, clean: DataFrame | None = None, keys: Sequence[str] = KEYS,
                   ts: str = TS) -> DataFrame:
    """A2: per series — rows, duplicate stamps, missing grid hours, span and
    (given the cleaned frame) outliers and rows kept.  Missing hours follow
    the reference: grid length − distinct stamps (off-grid stamps count as
    present)."""
    keys = list(keys)
    r = raw.filter(F.col(ts).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(ts).alias("n_distinct"),
        F.min(ts).alias("ts_min"), F.max(ts).alias("ts_max"))
    grid_len = F.floor((_secs("ts_max") - _secs("ts_min")) / F.lit(HOUR)).cast("long") + 1
    r = r.select(*keys, "n_rows", (F.col("n_rows") - F.col("n_distinct")).alias("n_duplicates"),
                 (grid_len - F.col("n_distinct")).alias("n_missing"), "ts_min", "ts_max")
    if clean is None:
        return r
    c = clean.groupBy(*keys).agg(F.sum("outlier_flag").cast("long").alias("n_outliers"),
                                 F.count(F.lit(1)).alias("n_clean"))
    return r.join(c, keys, "left")


def fill_series(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, value: str = TARGET,
                limit: int = INTERP_LIMIT, materialize: bool = False) -> DataFrame:
    """M1 steps 1-3 only: deduped on-grid known rows plus interpolated hours
    (before outlier clipping).  ``materialize``: the known rows, which the
    gap pass reads twice, are checkpointed once."""
    keys = list(keys)
    df = df.filter(F.col(ts).isNotNull())
    known = (_with_grid(dedupe_mean(df, keys, ts, value), df, keys, ts)
              .filter(_on_grid(ts) & F.col(value).isNotNull())
              .select(*keys, ts, value, "_g1"))
    if materialize:
        from ..session import materialize as _materialize
        known = _materialize(known)
    return _gap_fills(known, keys, ts, value, limit, with_known=True)
