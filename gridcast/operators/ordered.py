"""Ordered work inside a series without one task per series.

A window partitioned only by ``series_id`` sends a whole series to one task;
with one series holding a third of all rows that task is the job. Everything
order-dependent in this package therefore runs on *chunks* of a series:

* :func:`with_positions` gives every row its exact 0-based position in the
  series (time order), and in the same pass can forward / back fill columns
  over any distance and attach the next row (across blocks).  A small
  per-``(series, time block)`` summary — a map-side partial aggregate of the
  input — is prefix-summed and joined back; the rows are exchanged once on
  ``(series, block)`` and handled by one window sort.
* :func:`with_halo` cuts positions into chunks of ``chunk_rows`` and copies
  the last ``lookback`` rows of each chunk into the next chunk (and the first
  ``lookahead`` rows into the previous one).  A window partitioned by
  ``(series, _chunk)`` and ordered by ``_pos`` then sees every row it needs;
  keep ``_own`` rows for the result.  Exact for positional lags / frames of
  at most ``lookback`` rows back and ``lookahead`` rows forward.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POS = "_pos"
CHUNK = "_chunk"
OWN = "_own"

# Rows per chunk.  Big enough that halo copies (<= 168 rows) are noise, small
# enough that a chunk is one comfortably sized task at any scale.
DEFAULT_CHUNK_ROWS = 1 << 20
# Time block used only to count rows before numbering them (a week of
# hourly rows = 168 per series; the count table stays tiny).
DEFAULT_BLOCK_HOURS = 24 * 7


def _block(ts: str, block_hours: int) -> Column:
    return F.floor(F.unix_seconds(F.col(ts)) / F.lit(3600 * block_hours)).cast("long")


def with_positions(df: DataFrame, keys: Sequence[str], ts: str = "ts",
                   tiebreak: Sequence[str] = (), block_hours: int = DEFAULT_BLOCK_HOURS,
                   fill: Sequence[str] = (), backfill: bool = True,
                   lead: Sequence[str] = (), with_len: bool = False) -> DataFrame:
    """Add ``_pos``: the row's 0-based rank inside its series, ordered by
    ``ts`` then ``tiebreak``.  Null keys / null ``ts`` rows are not numbered
    (callers drop them first).

    Optionally, in the same pass: ``fill`` columns are forward filled (and,
    with ``backfill``, leading nulls take the series' first known value) over
    any distance, and ``lead`` adds ``_next_ts`` / ``_next_<c>`` — the next
    row of the series, across block boundaries; ``with_len`` adds the series
    length ``_len``.

    Plan: a per-``(series, time block)`` summary (row count, last / first
    known values, first row) is a partial aggregate of the input — map-side
    combined, so only one small row per block is shuffled — then prefix-summed
    over blocks; the rows themselves are exchanged once on ``(series,
    block)`` and numbered / filled by one window sort, with the summary joined
    on the same keys."""
    keys = list(keys)
    order = F.struct(F.col(ts), *[F.col(c) for c in tiebreak])
    d = df.withColumn("_blk", _block(ts, block_hours))
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in fill:
        known = F.when(F.col(c).isNotNull(), order)
        aggs.append(F.max_by(F.col(c), known).alias(f"_last_{c}"))
        if backfill:
            aggs.append(F.min_by(F.col(c), known).alias(f"_head_{c}"))
    if lead:
        aggs.append(F.min_by(F.struct(F.col(ts).alias("_ts"), *[F.col(c).alias(c) for c in lead]), order)
                     .alias("_first_row"))
    summ = d.groupBy(*keys, "_blk").agg(*aggs)
    ob = Window.partitionBy(*keys).orderBy("_blk")
    before = ob.rowsBetween(Window.unboundedPreceding, -1)
    out = [*keys, "_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")]
    if with_len:
        out.append(F.sum("_n").over(Window.partitionBy(*keys)).alias("_len"))
    for c in fill:
        out.append(F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_carry_{c}"))
        if backfill:
            whole = ob.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            out.append(F.first(f"_head_{c}", ignorenulls=True).over(whole).alias(f"_first_{c}"))
    if lead:
        out.append(F.lead("_first_row", 1).over(ob).alias("_next_block_row"))
    summ = summ.select(*out)
    d = d.join(summ, [*keys, "_blk"], "left")
    inside = Window.partitionBy(*keys, "_blk").orderBy(F.col(ts), *[F.col(c) for c in tiebreak])
    cols = {POS: F.col("_start") + F.row_number().over(inside) - F.lit(1)}
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    for c in fill:
        parts = [F.last(c, ignorenulls=True).over(upto), F.col(f"_carry_{c}")]
        if backfill:
            parts.append(F.col(f"_first_{c}"))
        cols[c] = F.coalesce(*parts)
    if lead:
        nxt = F.coalesce(F.lead(F.struct(F.col(ts).alias("_ts"), *[F.col(c).alias(c) for c in lead]), 1).over(inside),
                         F.col("_next_block_row"))
        cols["_next_ts"] = nxt["_ts"]
        for c in lead:
            cols[f"_next_{c}"] = nxt[c]
    d = d.withColumns(cols)
    drop = ["_start", "_blk"] + [f"_carry_{c}" for c in fill] + ([f"_first_{c}" for c in fill] if backfill else [])
    drop += ["_next_block_row"] if lead else []
    return d.drop(*drop)


def join_by_block(df: DataFrame, per_series: DataFrame, keys: Sequence[str], ts: str = "ts",
                  block_hours: int = DEFAULT_BLOCK_HOURS) -> DataFrame:
    """Attach a one-row-per-series table to rows without shuffling rows by
    series alone: the table meets the (few) time blocks of each series, and
    the rows meet their block.  A hot series stays spread over its blocks, and
    a later :func:`with_positions` needs no further exchange."""
    keys = list(keys)
    d = df.withColumn("_blk", _block(ts, block_hours))
    blocks = d.select(*keys, "_blk").distinct().join(per_series, keys)
    return d.join(blocks, [*keys, "_blk"]).drop("_blk")


def with_halo(df: DataFrame, lookback: int = 0, lookahead: int = 0,
              chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Assign ``_chunk`` and replicate boundary rows as halo (``_own`` false)."""
    if lookback > chunk_rows or lookahead > chunk_rows:
        raise ValueError("chunk_rows must be at least the look-back / look-ahead")
    own = F.floor(F.col(POS) / F.lit(chunk_rows)).cast("long")
    rem = F.col(POS) - own * F.lit(chunk_rows)
    empty = F.array().cast("array<long>")
    targets = F.array(own)
    if lookback:
        targets = F.concat(targets, F.when(rem >= F.lit(chunk_rows - lookback), F.array(own + 1)).otherwise(empty))
    if lookahead:
        targets = F.concat(targets, F.when((rem < F.lit(lookahead)) & (own > 0), F.array(own - 1)).otherwise(empty))
    return (df.withColumn("_own_chunk", own)
              .withColumn(CHUNK, F.explode(targets))
              .withColumn(OWN, F.col(CHUNK) == F.col("_own_chunk"))
              .drop("_own_chunk"))


def chunk_window(keys: Sequence[str]) -> Window:
    """Window spec over a halo'd frame: ordered rows of one chunk."""
    return Window.partitionBy(*keys, CHUNK).orderBy(POS)


def finish(df: DataFrame) -> DataFrame:
    """Drop halo rows and helper columns."""
    return df.filter(F.col(OWN)).drop(POS, CHUNK, OWN)


# --- time-based chunks (lags counted in hours, not rows) ----------------------

HOUR_COL = "_hr"


def with_time_halo(df: DataFrame, ts: str = "ts", lookback_hours: int = 0,
                   chunk_hours: int = DEFAULT_BLOCK_HOURS * 4) -> DataFrame:
    """Time chunks: ``_chunk = floor(hour / chunk_hours)``; rows in the last
    ``lookback_hours`` of a chunk are copied into the next one (``_own``
    false).  A window over ``(series, _chunk)`` ordered by ``_hr`` with RANGE
    frames then sees every hour it needs.  No numbering pass: one exchange."""
    if lookback_hours > chunk_hours:
        raise ValueError("chunk_hours must be at least the look-back")
    hr = F.floor(F.unix_seconds(F.col(ts)) / F.lit(3600)).cast("long")
    own = F.floor(F.col(HOUR_COL) / F.lit(chunk_hours)).cast("long")
    rem = F.col(HOUR_COL) - own * F.lit(chunk_hours)
    targets = F.array(own)
    if lookback_hours:
        targets = F.concat(targets, F.when(rem >= F.lit(chunk_hours - lookback_hours), F.array(own + 1))
                                      .otherwise(F.array().cast("array<long>")))
    d = df.withColumn(HOUR_COL, hr).withColumn("_own_chunk", own)
    return (d.withColumn(CHUNK, F.explode(targets))
             .withColumn(OWN, F.col(CHUNK) == F.col("_own_chunk")).drop("_own_chunk"))


def time_fill(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], chunk_hours: int,
              backfill: bool = True) -> DataFrame:
    """Forward (and back) fill on a time-halo'd frame: local fill inside the
    chunk window plus the carry of earlier chunks from a per-chunk summary
    that is a partial aggregate of the *source* rows (no second pass over the
    windowed data)."""
    keys = list(keys)
    src = df.filter(F.col(OWN))
    aggs = []
    for c in cols:
        known = F.when(F.col(c).isNotNull(), F.col(ts))
        aggs.append(F.max_by(F.col(c), known).alias(f"_last_{c}"))
        if backfill:
            aggs.append(F.min_by(F.col(c), known).alias(f"_head_{c}"))
    summ = src.groupBy(*keys, F.col("_chunk")).agg(*aggs)
    ob = Window.partitionBy(*keys).orderBy(CHUNK)
    before = ob.rowsBetween(Window.unboundedPreceding, -1)
    whole = ob.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sel = [*keys, CHUNK]
    for c in cols:
        sel.append(F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_carry_{c}"))
        if backfill:
            sel.append(F.first(f"_head_{c}", ignorenulls=True).over(whole).alias(f"_first_{c}"))
    d = df.join(summ.select(*sel), [*keys, CHUNK], "left")
    upto = Window.partitionBy(*keys, CHUNK).orderBy(HOUR_COL, ts).rowsBetween(Window.unboundedPreceding, 0)
    repl = {}
    for c in cols:
        parts = [F.last(c, ignorenulls=True).over(upto), F.col(f"_carry_{c}")]
        if backfill:
            parts.append(F.col(f"_first_{c}"))
        repl[c] = F.coalesce(*parts)
    drop = [f"_carry_{c}" for c in cols] + ([f"_first_{c}" for c in cols] if backfill else [])
    return d.withColumns(repl).drop(*drop)


#: Rows that one task ranks, and leading digits of a hash that blocks have at most.
RANK_ROWS = 1_000_000
RANK_DIGITS = 4


def hash_rank(df: DataFrame, order: str, rank: str) -> DataFrame:
    """``df`` with ``rank``, 1 for the first row in the order of ``order``, a
    column of evenly spread hexadecimal hashes (ties: by a hash of the row).

    No task sees all rows: the leading digits of the hash are blocks, their
    counts (at most ``16 ** RANK_DIGITS`` rows) are summed up on the driver, and
    rows are numbered inside their block."""
    spark = df.sparkSession
    counts = dict(df.groupBy(F.substring(order, 1, RANK_DIGITS).alias("b")).agg(F.count("*").alias("n")).collect())
    total, digits = sum(counts.values()), 1
    while digits < RANK_DIGITS and total > RANK_ROWS * 16 ** digits:
        digits += 1
    blocks: dict[str, int] = {}
    for b, n in sorted(counts.items()):
        blocks[b[:digits]] = blocks.get(b[:digits], 0) + n
    rows, before = [], 0
    for b, n in blocks.items():
        rows.append((b, before))
        before += n
    offsets = spark.createDataFrame(rows, "_rank_block string, _rank_before long")
    within = Window.partitionBy("_rank_block").orderBy(order, F.xxhash64(*df.columns))
    return (df.withColumn("_rank_block", F.substring(order, 1, digits)).join(offsets, "_rank_block")
            .withColumn(rank, F.col("_rank_before") + F.row_number().over(within)).drop("_rank_block", "_rank_before"))
