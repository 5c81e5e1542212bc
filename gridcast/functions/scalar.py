"""Row-level functions (F4, F6-F11, P6): all built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DISPLAY_NAMES, FEATURE_COLS, LOAD_BANDS

NOTE = ("Scored without history: load lags and rolling statistics are fixed stand-ins, "
        "weather is the default unless the request gives it. Use a recursive forecast for real lags.")


def parse_request_time(df: DataFrame, col: str = "datetime", out: str = "ts") -> DataFrame:
    """F8: string → TIMESTAMP (null when unparsable) and an ``error`` text
    for the rows that failed, instead of failing the batch."""
    t = F.col(col).try_cast("timestamp")
    err = F.when(t.isNull(), F.concat(F.lit("unreadable time '"), F.coalesce(F.col(col), F.lit("")), F.lit("'")))
    return df.withColumn(out, t).withColumn("error", err)


def format_timestamp(c: Column, seconds: bool = False) -> Column:
    """``yyyy-MM-dd HH:mm`` (table) or ``yyyy-MM-dd HH:mm:ss`` (API)."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss" if seconds else "yyyy-MM-dd HH:mm")


def format_mw(c: Column, digits: int = 0) -> Column:
    """thousands separators plus the unit, e.g. ``32,451 MW``."""
    return F.concat(F.format_number(c, digits), F.lit(" MW"))


def display_name(c: Column) -> Column:
    """a model's shown name; other names stay as they are."""
    names = F.create_map(*[x for k, v in DISPLAY_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(names, c), c)


def code_of_display(c: Column) -> Column:
    """The code of a shown model name; other names stay as they are."""
    codes = F.create_map(*[x for k, v in DISPLAY_NAMES.items() for x in (F.lit(v), F.lit(k))])
    return F.coalesce(F.try_element_at(codes, c), c)


def model_code(name: str) -> str:
    """The code of a model given by code or shown name."""
    return {v: k for k, v in DISPLAY_NAMES.items()}.get(name, name)


def load_band(c: Column, bands=LOAD_BANDS) -> Column:
    """the gauge band of a load value (lower bound inclusive; the top
    band includes its upper bound); null outside all bands."""
    expr = None
    for i, (lo, hi, label) in enumerate(bands):
        cond = (c >= F.lit(lo)) & ((c <= F.lit(hi)) if i == len(bands) - 1 else (c < F.lit(hi)))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def response_record(forecast: Column, model: Column, input_datetime: Column,
                    server_timestamp: Column | None = None, error: Column | None = None) -> Column:
    """the prediction response as a JSON object with six fields; a row
    with an ``error`` gets ``{"detail": error}`` instead."""
    st = server_timestamp if server_timestamp is not None else \
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    answer = F.to_json(F.struct(
        F.round(forecast, 2).alias("forecast_mw"), model.alias("model"),
        input_datetime.alias("input_datetime"), st.alias("server_timestamp"),
        F.lit(len(FEATURE_COLS)).alias("feature_count"), F.lit(NOTE).alias("note")))
    if error is None:
        return answer
    return F.when(error.isNotNull(), F.to_json(F.struct(error.alias("detail")))).otherwise(answer)


def rename_ds_y(df: DataFrame, ts: str = "ts", value: str = "load_mw",
                regressors: Sequence[str] = ("temp", "rhum", "wspd"), keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Seasonal-model naming: ``ds``, ``y`` plus regressors."""
    return df.select(*keys, F.col(ts).alias("ds"), F.col(value).alias("y"), *regressors)


def minmax_transform(c: Column, lo: Column, hi: Column) -> Column:
    """scale to 0…1 with a column's train min / max; a constant column
    (max = min) uses scale 1, i.e. ``x - min``."""
    rng = hi - lo
    return (c - lo) / F.when(rng == 0, F.lit(1.0)).otherwise(rng)


def minmax_inverse(c: Column, lo: Column, hi: Column) -> Column:
    """F6 inverse: back to the original units."""
    rng = hi - lo
    return c * F.when(rng == 0, F.lit(1.0)).otherwise(rng) + lo
