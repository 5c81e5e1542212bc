"""Scaled supervised sequences for an external sequence model (A12, F6, W7,
M17).  The scaler is fitted on train only; windows are built per series on
chunks with a halo, so a long series never lands in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import minmax_inverse, minmax_transform
from ..schema import FEATURE_COLS, KEYS, TARGET, TS
from . import ordered as O


def minmax_fit(train: DataFrame, cols: Sequence[str] = (*FEATURE_COLS, TARGET)) -> DataFrame:
    """One row with ``<c>_min`` / ``<c>_max`` per column (train only)."""
    return train.agg(*[x for c in cols for x in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))])


def apply_minmax(df: DataFrame, scaler: DataFrame, cols: Sequence[str] = (*FEATURE_COLS, TARGET),
                 inverse: bool = False) -> DataFrame:
    """scale (or unscale) ``cols`` with a fitted scaler row (a single row,
    broadcast by construction)."""
    d = df.crossJoin(F.broadcast(scaler))
    fn = minmax_inverse if inverse else minmax_transform
    d = d.withColumns({c: fn(F.col(c), F.col(f"{c}_min"), F.col(f"{c}_max")) for c in cols})
    return d.drop(*[f"{c}_{s}" for c in cols for s in ("min", "max")])


def make_sequences(df: DataFrame, seq_len: int, cols: Sequence[str] = FEATURE_COLS, target: str | None = TARGET,
                   keys: Sequence[str] = KEYS, ts: str = TS, chunk_rows: int = O.DEFAULT_CHUNK_ROWS) -> DataFrame:
    """For each row with ``seq_len`` rows before it in its series,
    ``seq`` = those rows' feature vectors in time order and ``y`` = the row's
    target (n − L samples per series, as the reference's loop)."""
    keys = list(keys)
    d = O.with_halo(O.with_positions(df.select(*keys, ts, *cols, *([target] if target else [])), keys, ts),
                    lookback=seq_len, chunk_rows=chunk_rows)
    w = O.chunk_window(keys).rowsBetween(-seq_len, -1)
    d = d.withColumn("seq", F.collect_list(F.array(*[F.col(c).cast("double") for c in cols])).over(w))
    d = O.finish(d).filter(F.size("seq") == seq_len)
    return d.select(*keys, ts, "seq", *([F.col(target).alias("y")] if target else []))


def compact_sequences(df: DataFrame, seq_len: int, cols: Sequence[str] = FEATURE_COLS, target: str | None = TARGET,
                      keys: Sequence[str] = KEYS, ts: str = TS, chunk_rows: int = 1024) -> DataFrame:
    """W7 without copies, to be stored: a row per chunk of a series with
    ``matrix``, the feature vectors of the chunk and of the ``seq_len`` rows
    before it in time order, and ``samples`` (``ts``, ``offset`` of the first
    vector in the matrix, ``y``).  A vector is held once, and once more where it
    is in the halo of the next chunk (``seq_len`` rows of at least ``8 *
    seq_len``).  Series of up to ``seq_len`` rows have no sample and no row."""
    keys = list(keys)
    d = O.with_halo(O.with_positions(df.select(*keys, ts, *cols, *([target] if target else [])), keys, ts),
                    lookback=seq_len, chunk_rows=max(chunk_rows, 8 * seq_len))
    row = F.struct(O.POS, O.OWN, F.col(ts).alias("ts"), F.array(*[F.col(c).cast("double") for c in cols]).alias("v"),
                   *([F.col(target).alias("y")] if target else []))
    d = d.groupBy(*keys, F.col(O.CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(row)).alias("_rows"))

    def sample(r, i):
        return F.struct(r["ts"].alias("ts"), (i - F.lit(seq_len)).alias("offset"), *([r["y"].alias("y")] if target else []),
                        r[O.OWN].alias("own"))

    kept = F.filter(F.transform("_rows", sample), lambda x: x["own"] & (x["offset"] >= 0))
    return d.select(*keys, "chunk", F.transform("_rows", lambda r: r["v"]).alias("matrix"),
                    F.transform(kept, lambda x: x.dropFields("own")).alias("samples")).where(F.size("samples") > 0)


def expand_sequences(compact: DataFrame, seq_len: int, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """The rows of :func:`make_sequences` from :func:`compact_sequences`: a
    projection, without exchange or sort."""
    named = [f.name for f in compact.schema["samples"].dataType.elementType.fields]

    def sample(x):
        return F.struct(x["ts"].alias(ts), F.slice("matrix", x["offset"] + 1, F.lit(seq_len)).alias("seq"),
                        *([x["y"].alias("y")] if "y" in named else []))

    return compact.select(*keys, F.inline(F.transform("samples", sample)))


def sequence_dataset(train: DataFrame, test: DataFrame, seq_len: int = 24, cols: Sequence[str] = FEATURE_COLS,
                     keys: Sequence[str] = KEYS, ts: str = TS, path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scaler fitted on train, both sides scaled, sequences built; when
    ``path`` is given the three tables are written as Parquet (``scaler/``, and
    compact ``train/``, ``test/`` for :func:`expand_sequences`) and read back.
    Returns ``(scaler, train_seq, test_seq)``."""
    scaler = minmax_fit(train, (*cols, TARGET))
    sides = {name: apply_minmax(side, scaler, (*cols, TARGET)) for name, side in (("train", train), ("test", test))}
    if not path:
        return scaler, *(make_sequences(side, seq_len, cols, TARGET, keys, ts) for side in sides.values())
    scaler.write.mode("overwrite").parquet(f"{path}/scaler")
    for name, side in sides.items():
        compact_sequences(side, seq_len, cols, TARGET, keys, ts).write.mode("overwrite").parquet(f"{path}/{name}")
    read = train.sparkSession.read.parquet
    return read(f"{path}/scaler"), *(expand_sequences(read(f"{path}/{name}"), seq_len, keys, ts) for name in sides)
