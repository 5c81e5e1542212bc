"""Positional window operators (W1-W5, W9) over chunked series.

Semantics follow the reference (T3): lags and rolling frames count *rows*,
not hours.  Rolling statistics cover the previous ``n`` rows (current row
excluded) and are null unless all ``n`` are present and non-null.

Each public operator is ``DataFrame -> DataFrame`` and runs on chunks with a
halo (see :mod:`.ordered`); ``lag_columns`` and ``add_rolling`` let a pipeline
put all its windows over one sort of one halo'd frame.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEYS, LAGS, ROLL_MEANS, ROLL_STDS, TARGET, TS
from . import ordered as O


def lag_columns(w: Window, value: str = TARGET, lags: Sequence[int] = LAGS) -> dict[str, Column]:
    return {f"lag_{n}h": F.lag(F.col(value), n).over(w) for n in lags}


#: Blocks of rows that a level of rolling statistics joins into one.
RADIX = 4


def _merged(df: DataFrame, w: Window, wanted: dict[str, tuple[list[tuple[int, int]], bool]]) -> DataFrame:
    """Add ``<name>_mean`` (and ``<name>_sq``, the sum of squared deviations)
    of consecutive blocks, given as (rows, rows back) with the columns
    ``_b<rows>_mean`` / ``_b<rows>_sq``; null if a block is null or missing.
    The squares are added around the common mean: nothing is subtracted that
    is larger than the frame's own spread."""
    lags: dict[str, Column] = {}
    for at, squares in wanted.values():
        for rows, back in at:
            lags[f"_at_{rows}_{back}"] = F.lag(f"_b{rows}_mean", back).over(w)
            if squares and rows > 1:
                lags[f"_at_{rows}_{back}_sq"] = F.lag(f"_b{rows}_sq", back).over(w)
    means, sqs = {}, {}
    for name, (at, squares) in wanted.items():
        parts = [(F.col(f"_at_{rows}_{back}"), f"_at_{rows}_{back}_sq", float(rows)) for rows, back in at]
        means[f"{name}_mean"] = reduce(add, [m * F.lit(rows) for m, _, rows in parts]) / F.lit(sum(rows for *_, rows in parts))
        if squares:
            off = [(m - F.col(f"{name}_mean")) * (m - F.col(f"{name}_mean")) * F.lit(rows) for m, _, rows in parts]
            sqs[f"{name}_sq"] = reduce(add, [*off, *(F.col(sq) for _, sq, rows in parts if rows > 1)])
    return df.withColumns(lags).withColumns(means).withColumns(sqs).drop(*lags)


def _frame(rows: int) -> list[tuple[int, int]]:
    """The ``rows`` rows before the current one as blocks (rows, rows back)."""
    at, back = [], 1
    block = RADIX ** int(math.log(rows, RADIX) + 1e-9)
    while block:
        while rows >= block:
            at.append((block, back))
            back, rows = back + block, rows - block
        block //= RADIX
    return at


def add_rolling(df: DataFrame, w: Window, value: str = TARGET, means: Sequence[int] = ROLL_MEANS,
                stds: Sequence[int] = ROLL_STDS, hour: str | None = None) -> DataFrame:
    """``rolling_mean_<n>h`` / ``rolling_std_<n>h`` of the ``n`` rows before the
    current one in ``w``, null unless all are present and non-null (with
    ``hour``: and cover exactly the ``n`` hours before).

    Means and squared deviations of blocks of 4, 16, 64, ... rows are joined
    from those of the level below, a frame from at most three blocks a level:
    the work per row grows with the logarithm of ``n``, where a sliding frame
    adds up ``n`` values again for every row.  All levels share one sort."""
    sizes = sorted({*means, *stds})
    if not sizes:
        return df
    if sizes[0] < 1:
        raise ValueError("a rolling frame has at least one row")
    d, rows = df.withColumn("_b1_mean", F.col(value).cast("double")), 1
    helpers = ["_b1_mean"]
    while rows * RADIX <= sizes[-1]:
        squares = bool(stds) and rows * RADIX <= max(stds)
        d = _merged(d, w, {f"_b{rows * RADIX}": ([(rows, k * rows) for k in range(RADIX)], squares)})
        rows *= RADIX
        helpers += [f"_b{rows}_mean", f"_b{rows}_sq"]
    d = _merged(d, w, {f"_frame_{n}": (_frame(n), n in stds) for n in sizes})
    helpers += [f"_frame_{n}_{x}" for n in sizes for x in ("mean", "sq")]
    if hour:
        d = d.withColumns({f"_whole_{n}": F.lag(hour, n).over(w) == F.col(hour) - F.lit(n) for n in sizes})
        helpers += [f"_whole_{n}" for n in sizes]

    def checked(n: int, x: Column) -> Column:
        return F.when(F.col(f"_whole_{n}"), x) if hour else x

    out = {f"rolling_mean_{n}h": checked(n, F.col(f"_frame_{n}_mean")) for n in means}
    for n in stds:  # one row has no sample deviation
        out[f"rolling_std_{n}h"] = checked(n, F.sqrt(F.col(f"_frame_{n}_sq") / F.lit(n - 1))) if n > 1 else F.lit(None).cast("double")
    return d.withColumns(out).drop(*helpers)


def _prepare(df: DataFrame, keys, ts, lookback, lookahead, chunk_rows, tiebreak=()):
    d = O.with_positions(df, keys, ts, tiebreak=tiebreak)
    return O.with_halo(d, lookback=lookback, lookahead=lookahead, chunk_rows=chunk_rows)


def lag_features(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, value: str = TARGET,
                 lags: Sequence[int] = LAGS, chunk_rows: int = O.DEFAULT_CHUNK_ROWS) -> DataFrame:
    """``lag_<n>h`` = value ``n`` rows earlier in the series."""
    d = _prepare(df, keys, ts, max(lags), 0, chunk_rows)
    return O.finish(d.withColumns(lag_columns(O.chunk_window(keys), value, lags)))


def rolling_features(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, value: str = TARGET,
                     means: Sequence[int] = ROLL_MEANS, stds: Sequence[int] = ROLL_STDS,
                     chunk_rows: int = O.DEFAULT_CHUNK_ROWS) -> DataFrame:
    """W2 + W3: previous-``n``-row mean and sample std."""
    d = _prepare(df, keys, ts, max([*means, *stds]), 0, chunk_rows)
    return O.finish(add_rolling(d, O.chunk_window(keys), value, means, stds))


def fill_gaps(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS, ts: str = TS,
              backfill: bool = True) -> DataFrame:
    """W4 (+ W5 with ``backfill``): carry the last known value forward; the
    leading nulls take the first known value.  Exact over any gap length."""
    return O.with_positions(df, keys, ts, fill=cols, backfill=backfill).drop(O.POS)


def recent_window(df: DataFrame, n: int = 168, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """The last ``n`` rows of each series.  A rank limit: every task
    keeps at most ``n`` rows per series before the exchange, so one scan and
    ``n`` rows per series and task are all that moves."""
    keys = list(keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(ts).desc()))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


# --- time mode (T3): lags and frames in hours ------------------------------------

def add_time_windows(df: DataFrame, keys: Sequence[str], value: str = TARGET, lags: Sequence[int] = LAGS,
                     means: Sequence[int] = ROLL_MEANS, stds: Sequence[int] = ROLL_STDS) -> DataFrame:
    """Columns over a time-halo'd frame: ``lag_<n>h`` = value exactly n hours
    earlier (null when that hour is absent); rolling stats over the previous
    n hours, null unless all n hours are present and non-null."""
    w = Window.partitionBy(*keys, O.CHUNK).orderBy(O.HOUR_COL)
    d = df.withColumns({f"lag_{n}h": F.first(F.col(value)).over(w.rangeBetween(-n, -n)) for n in lags})
    return add_rolling(d, w, value, means, stds, hour=O.HOUR_COL)


def time_lag_features(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, value: str = TARGET,
                      lags: Sequence[int] = LAGS, means: Sequence[int] = ROLL_MEANS, stds: Sequence[int] = ROLL_STDS,
                      chunk_hours: int = O.DEFAULT_BLOCK_HOURS * 4) -> DataFrame:
    """W1-W3 by time (hourly stamps, unique per series): one exchange on
    ``(series, time chunk)``; equal to the positional operators on a complete
    hourly grid."""
    keys = list(keys)
    d = O.with_time_halo(df, ts, max([*lags, *means, *stds]), chunk_hours)
    d = add_time_windows(d, keys, value, lags, means, stds)
    return d.filter(F.col(O.OWN)).drop(O.CHUNK, O.OWN, O.HOUR_COL)
