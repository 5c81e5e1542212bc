"""Calendar, cyclical and holiday columns.

All built-in expressions: they stay inside whole-stage codegen.  The holiday
dimension is generated by rule for a fixed span of years (about 16 rows per
year), never from a pass over the data, and is safe to broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi


def calendar_columns(ts: str | Column = "ts") -> dict[str, Column]:
    """hour, day_of_week (Mon=0), month, quarter, day_of_year, ISO week,
    is_weekend — all INT."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return {
        "hour": F.hour(t).cast("int"),
        "day_of_week": F.weekday(t).cast("int"),
        "month": F.month(t).cast("int"),
        "quarter": F.quarter(t).cast("int"),
        "day_of_year": F.dayofyear(t).cast("int"),
        "week_of_year": F.weekofyear(t).cast("int"),
        "is_weekend": (F.weekday(t) >= 5).cast("int"),
    }


def cyclical_columns(hour: Column, month: Column) -> dict[str, Column]:
    """sin / cos of hour/24 and month/12 (month is 1-based, as given)."""
    return {
        "hour_sin": F.sin(F.lit(TWO_PI) * hour / F.lit(24.0)),
        "hour_cos": F.cos(F.lit(TWO_PI) * hour / F.lit(24.0)),
        "month_sin": F.sin(F.lit(TWO_PI) * month / F.lit(12.0)),
        "month_cos": F.cos(F.lit(TWO_PI) * month / F.lit(12.0)),
    }


def add_calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    """F1 + F2 + F3 in one projection."""
    df = df.withColumns(calendar_columns(ts))
    return df.withColumns(cyclical_columns(F.col("hour"), F.col("month")))


# --- US federal holidays, actual and observed ------------------------------
# Fixed values (rules of the federal calendar since 1971):
#   New Year's Day Jan 1; Juneteenth Jun 19 (from 2021); Independence Day Jul 4;
#   Veterans Day Nov 11 (4th Monday of October 1971-1977); Christmas Day Dec 25;
#   Martin Luther King Jr. Day 3rd Monday of January (from 1986);
#   Washington's Birthday 3rd Monday of February; Memorial Day last Monday of May;
#   Labor Day 1st Monday of September; Columbus Day 2nd Monday of October;
#   Thanksgiving 4th Thursday of November.
#   A fixed-date holiday on Saturday is also observed on the Friday before,
#   on Sunday on the Monday after (Jan 1 on a Saturday -> Dec 31 of the year before).

def _nth_weekday(y: Column, month: int, dow: str, n: int) -> Column:
    first = F.next_day(F.date_sub(F.make_date(y, F.lit(month), F.lit(1)), 1), dow)
    return F.date_add(first, 7 * (n - 1))


def _observed(d: Column) -> Column:
    dow = F.dayofweek(d)  # 1 = Sunday, 7 = Saturday
    return F.when(dow == 7, F.date_sub(d, 1)).when(dow == 1, F.date_add(d, 1))


def holiday_rows(years: DataFrame, year_col: str = "year") -> DataFrame:
    """One row per (holiday date): ``holiday_date DATE, holiday STRING``.
    ``years`` holds one row per calendar year to generate."""
    y = F.col(year_col).cast("int")
    fixed = [
        ("New Year's Day", F.make_date(y, F.lit(1), F.lit(1)), F.lit(True)),
        ("Juneteenth National Independence Day", F.make_date(y, F.lit(6), F.lit(19)), y >= 2021),
        ("Independence Day", F.make_date(y, F.lit(7), F.lit(4)), F.lit(True)),
        ("Veterans Day", F.when((y >= 1971) & (y <= 1977), _nth_weekday(y, 10, "Mon", 4))
                          .otherwise(F.make_date(y, F.lit(11), F.lit(11))), F.lit(True)),
        ("Christmas Day", F.make_date(y, F.lit(12), F.lit(25)), F.lit(True)),
    ]
    moving = [
        ("Martin Luther King Jr. Day", _nth_weekday(y, 1, "Mon", 3), y >= 1986),
        ("Washington's Birthday", _nth_weekday(y, 2, "Mon", 3), F.lit(True)),
        ("Memorial Day", F.next_day(F.make_date(y, F.lit(5), F.lit(24)), "Mon"), F.lit(True)),
        ("Labor Day", _nth_weekday(y, 9, "Mon", 1), F.lit(True)),
        ("Columbus Day", _nth_weekday(y, 10, "Mon", 2), F.lit(True)),
        ("Thanksgiving", _nth_weekday(y, 11, "Thu", 4), F.lit(True)),
    ]
    entries = []
    for name, d, ok in fixed:
        entries.append(F.struct(F.lit(name).alias("holiday"), d.alias("holiday_date"), ok.alias("ok")))
        entries.append(F.struct(F.lit(name + " (observed)").alias("holiday"), _observed(d).alias("holiday_date"),
                                ok.alias("ok")))
    for name, d, ok in moving:
        entries.append(F.struct(F.lit(name).alias("holiday"), d.alias("holiday_date"), ok.alias("ok")))
    return (years.select(F.inline(F.array(*entries)))
                 .filter(F.col("ok") & F.col("holiday_date").isNotNull())
                 .select("holiday_date", "holiday"))


# Years covered by the generated holiday dimension (rules above hold from 1971).
HOLIDAY_YEARS = (1971, 2100)
_DIMENSIONS: dict = {}


def holiday_dimension(spark, first_year: int = HOLIDAY_YEARS[0], last_year: int = HOLIDAY_YEARS[1]) -> DataFrame:
    """Distinct holiday dates ``holiday_date, holiday`` for a span of years,
    generated by rule (about 16 rows per year, ~2,000 for the default span),
    independent of the data: no pass over the input is needed.  Cached per
    session."""
    key = (id(spark), first_year, last_year)
    if key not in _DIMENSIONS:
        # one year more: Jan 1 of the next year can be observed on Dec 31 of the last
        years = spark.range(first_year, last_year + 2).select(F.col("id").cast("int").alias("year"))
        dim = holiday_rows(years).groupBy("holiday_date").agg(F.min("holiday").alias("holiday"))
        _DIMENSIONS[key] = dim
    return _DIMENSIONS[key]


def add_is_holiday(df: DataFrame, ts: str = "ts", holidays: DataFrame | None = None) -> DataFrame:
    """``is_holiday`` INT, 1 when the row's date is a US federal holiday
    (actual or observed).  By default the rules are evaluated as one
    expression of the date (stays in whole-stage codegen, no join).  A
    caller-supplied ``holidays`` table (``holiday_date``) is joined instead;
    it is a calendar dimension (tens of rows per year), hence the broadcast."""
    if holidays is None:
        return df.withColumn("is_holiday", is_holiday_expr(F.to_date(F.col(ts))).cast("int"))
    h = holidays.select(F.col("holiday_date").alias("_hdate")).distinct().withColumn("_hflag", F.lit(1))
    out = df.join(F.broadcast(h), F.to_date(F.col(ts)) == F.col("_hdate"), "left")
    return out.withColumn("is_holiday", F.coalesce(F.col("_hflag"), F.lit(0)).cast("int")).drop("_hdate", "_hflag")


def is_holiday_expr(d: Column) -> Column:
    """The same federal rules as :func:`holiday_rows`, as one boolean
    expression of a DATE (before 1971, when other dates held, those of 1971) (no lookup, no join): O(1) per row.  Equal to
    membership in :func:`holiday_dimension` for 1971-2100 (tested)."""
    y, m, dd = F.year(d), F.month(d), F.dayofmonth(d)
    dow = F.dayofweek(d)  # 1 = Sunday … 7 = Saturday
    mon, thu, fri = dow == 2, dow == 5, dow == 6

    def fixed(x: Column) -> Column:
        xm, xd, xy = F.month(x), F.dayofmonth(x), F.year(x)
        return (((xm == 1) & (xd == 1)) | ((xm == 6) & (xd == 19) & (xy >= 2021)) | ((xm == 7) & (xd == 4))
                | ((xm == 11) & (xd == 11) & ((xy < 1971) | (xy > 1977))) | ((xm == 12) & (xd == 25)))

    observed = (fri & fixed(F.date_add(d, 1))) | (mon & fixed(F.date_sub(d, 1)))
    moving = ((mon & (m == 1) & dd.between(15, 21) & (y >= 1986))
              | (mon & (m == 2) & dd.between(15, 21))
              | (mon & (m == 5) & (dd >= 25))
              | (mon & (m == 9) & (dd <= 7))
              | (mon & (m == 10) & dd.between(8, 14))
              | (mon & (m == 10) & dd.between(22, 28) & y.between(1971, 1977))
              | (thu & (m == 11) & dd.between(22, 28)))
    return fixed(d) | observed | moving
