"""M2 ``build_features``: load ⟕ weather → fills → calendar → holidays →
lags / rolling → temp² → drop incomplete rows, as one lazy plan.

Physical shape: one exchange on ``(series, week)`` that numbers rows and
fills the weather (one sort; a small map-side-combined per-week summary
carries values across weeks), one exchange on ``(series, chunk)`` for the
lag / rolling windows (one sort); holidays are a rule expression (no join).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import add_calendar, add_is_holiday
from ..operators import ordered as O
from ..operators.windows import add_rolling, add_time_windows, lag_columns
from ..schema import FEATURE_COLS, KEYS, MAX_LOOKBACK, TARGET, TS
from ..sources.load import WEATHER_COLS, constant_weather


def join_weather(load: DataFrame, weather: DataFrame | None, ts: str = TS,
                 on: Sequence[str] | None = None) -> DataFrame:
    """Left equi-join on the timestamp (plus ``on`` site keys when the
    weather is per site).  Duplicate weather stamps multiply rows, as in the
    reference.  Join strategy is left to Catalyst / AQE (the weather table is
    usually small enough to broadcast, but its size is the optimizer's to
    check, not ours)."""
    if weather is None:
        return constant_weather(load)
    keys = [ts, *(on or [])]
    w = weather.select(*keys, *[c for c in WEATHER_COLS if c in weather.columns])
    return load.join(w, keys, "left")


def add_weather_features(df: DataFrame) -> DataFrame:
    """``temp_sq``."""
    return df.withColumn("temp_sq", F.col("temp") * F.col("temp"))


def build_features(load: DataFrame, weather: DataFrame | None = None, keys: Sequence[str] = KEYS,
                   ts: str = TS, backfill: bool = True, weather_on: Sequence[str] | None = None,
                   chunk_rows: int = O.DEFAULT_CHUNK_ROWS, dropna: bool = True,
                   lag_mode: str = "position", chunk_hours: int = O.DEFAULT_BLOCK_HOURS * 4,
                   materialize: bool = True) -> DataFrame:
    """M2: the 22-column feature frame plus ``load_mw``, keyed by ``keys, ts``.

    ``lag_mode="position"`` (reference semantics) counts rows;
    ``lag_mode="time"`` counts hours (for hourly stamps, e.g. after
    :func:`regularize`) and needs a single exchange — fill and lags share one
    ``(series, time chunk)`` window sort.

    The joined rows are read twice (numbering / fills and their per-block
    summary); ``materialize`` checkpoints them once, so that the sources are
    read, aggregated and joined once."""
    keys = list(keys)
    d = join_weather(load.select(*keys, ts, TARGET), weather, ts, weather_on)
    if materialize:
        from ..session import materialize as _materialize
        d = _materialize(d)
    if lag_mode == "time":
        d = O.with_time_halo(d, ts, MAX_LOOKBACK, chunk_hours)
        if weather is not None:
            d = O.time_fill(d, keys, ts, list(WEATHER_COLS), chunk_hours, backfill)
        d = add_time_windows(d, keys)
        d = d.filter(F.col(O.OWN)).drop(O.CHUNK, O.OWN, O.HOUR_COL)
    elif lag_mode == "position":
        d = O.with_positions(d, keys, ts, fill=list(WEATHER_COLS) if weather is not None else (), backfill=backfill)
        d = O.with_halo(d, lookback=MAX_LOOKBACK, chunk_rows=chunk_rows)
        w = O.chunk_window(keys)
        d = O.finish(add_rolling(d.withColumns(lag_columns(w)), w))
    else:
        raise ValueError("lag_mode is 'position' or 'time'")
    d = add_calendar(d, ts)
    d = add_is_holiday(d, ts)
    d = add_weather_features(d)
    d = d.select(*keys, ts, *FEATURE_COLS, TARGET)
    return d.dropna(how="any", subset=[*FEATURE_COLS, TARGET]) if dropna else d


def select_features(df: DataFrame, with_target: bool = True) -> DataFrame:
    """The contract columns in contract order."""
    return df.select(*FEATURE_COLS, *([TARGET] if with_target else []))
