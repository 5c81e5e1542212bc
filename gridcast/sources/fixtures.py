"""Stand-ins for the reference's inputs, derived by Spark from the driver's
tables (events, orders).  Every registered query starts here, so its work
grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Cut-off used with the stand-ins (events cover 2024-01-01 … 2024-01-30).
CUTOFF = "2024-01-22 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # events.ts is TIMESTAMP_NTZ: cast once under the UTC session.
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _hour(c: str = "ts"):
    return F.date_trunc("hour", F.col(c)).cast("timestamp")


def dense_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per event type; hourly load = sum of event values."""
    e = _events(spark, sf_dir)
    return (e.groupBy(F.col("event_type").alias("series_id"), _hour().alias("ts"))
             .agg(F.sum("value").alias("load_mw")))


def sparse_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per user: many gaps of every length."""
    e = _events(spark, sf_dir)
    return (e.groupBy(F.col("user_id").cast("string").alias("series_id"), _hour().alias("ts"))
             .agg(F.sum("value").alias("load_mw")))


def dup_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the sparse panel but not aggregated: duplicate stamps remain."""
    e = _events(spark, sf_dir)
    return e.select(F.col("user_id").cast("string").alias("series_id"), _hour().alias("ts"),
                    F.col("value").alias("load_mw"))


def offgrid_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the dup panel but at minute resolution: stamps off the hourly grid."""
    e = _events(spark, sf_dir)
    return e.select(F.col("user_id").cast("string").alias("series_id"),
                    F.date_trunc("minute", F.col("ts")).cast("timestamp").alias("ts"),
                    F.col("value").alias("load_mw"))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per hour; temp / rhum / wspd from three event types (nulls
    where the hour has none of that type)."""
    e = _events(spark, sf_dir)
    v = F.col("value")
    t = F.col("event_type")
    return (e.groupBy(_hour().alias("ts"))
             .agg(F.avg(F.when(t == "view", v)).alias("temp"),
                  F.avg(F.when(t == "click", v)).alias("rhum"),
                  F.avg(F.when(t == "signup", v)).alias("wspd")))


def raw_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw station-style frame: ``time``, ``temp``, ``rhum``, an extra
    column, and no ``wspd`` (S3 must add it as nulls)."""
    e = _events(spark, sf_dir)
    v = F.col("value")
    t = F.col("event_type")
    return (e.groupBy(_hour().alias("time"))
             .agg(F.avg(F.when(t == "view", v)).alias("temp"),
                  F.avg(F.when(t == "click", v)).alias("rhum"),
                  F.count(F.lit(1)).alias("n_obs")))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long daily series (1992-1998 orders): calendars over many years."""
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.col("o_orderdate").cast("timestamp").alias("ts"))
             .agg(F.sum("o_totalprice").alias("load_mw"))
             .withColumn("series_id", F.lit("orders"))
             .select("series_id", "ts", "load_mw"))


# Request model names per event type; signups name none (the default is meant).
REQUEST_MODELS = {"view": "xgboost", "click": "rf", "purchase": "linear"}


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction requests ``datetime STRING, model STRING``: one per event.
    Error events: the even ones carry their JSON props as an unparsable time
    (for a known model), the odd ones a valid time for an unknown model."""
    e = _events(spark, sf_dir)
    t = F.col("event_type")
    even = F.col("event_id") % 2 == 0
    model = F.when(t == "error", F.when(even, F.lit("xgboost")).otherwise(F.lit("magic_model"))).otherwise(
        F.create_map(*[x for k, v in REQUEST_MODELS.items() for x in (F.lit(k), F.lit(v))])[t])
    dt = F.when((t == "error") & even, F.col("props")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    return e.select(F.col("event_id").alias("request_id"), dt.alias("datetime"), model.alias("model"))
