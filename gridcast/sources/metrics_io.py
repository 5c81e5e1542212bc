"""Metrics persistence (S4-S6): JSON document, leaderboard CSV, and the
"first source that exists" reader.  The metrics table is one row per model
(tiny); the JSON document is built by Spark, never on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import code_of_display
from ..schema import METRIC_NAMES, METRICS_SCHEMA
from . import commits

_JSON_VALUE = T.MapType(T.StringType(), T.StructType([
    T.StructField("MAE", T.DoubleType()), T.StructField("RMSE", T.DoubleType()),
    T.StructField("MAPE", T.DoubleType()), T.StructField("R2", T.DoubleType())]))


def metrics_document(metrics: DataFrame) -> DataFrame:
    """S4 (write side): one row, ``metrics_json`` = ``{model: {MAE, RMSE,
    MAPE, R2}}`` with models in name order."""
    entry = F.struct(F.col("model").alias("k"),
                     F.struct(F.col("mae").alias("MAE"), F.col("rmse").alias("RMSE"),
                              F.col("mape").alias("MAPE"), F.col("r2").alias("R2")).alias("v"))
    return metrics.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("metrics_json"))


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    """Replace the JSON document (a single small text file) by a commit:
    readers see the old one or the new one, whole."""
    commits.replace(metrics.sparkSession, path, lambda _, to: metrics_document(metrics).coalesce(1).write.text(to))


def parse_metrics_document(doc: DataFrame, col: str = "metrics_json") -> DataFrame:
    """S4 (read side): the document back to one row per model."""
    m = doc.select(F.explode(F.from_json(F.col(col), _JSON_VALUE)).alias("model", "v"))
    return m.select("model", F.col("v.MAE").alias("mae"), F.col("v.RMSE").alias("rmse"),
                    F.col("v.MAPE").alias("mape"), F.col("v.R2").alias("r2"))


def read_metrics_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_metrics_document(spark.read.text(commits.current(spark, path)).withColumnRenamed("value", "metrics_json"))


def write_metrics_csv(board: DataFrame, path: str) -> None:
    """The leaderboard as a headed CSV (model name first)."""
    board.drop("is_best").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_metrics_csv(spark: SparkSession, path: str, digits: int = 2) -> DataFrame:
    """S5 (read side): display columns back to ``model, mae, rmse, mape, r2``
    rounded to ``digits`` (the reference rounds to 2 on read)."""
    from .load import read_named
    df = read_named(spark, path, "csv", ("Model", *METRIC_NAMES.values()))
    return df.select(code_of_display(F.col("Model")).alias("model"),
                     *[F.round(F.col(v).cast("double"), digits).alias(k) for k, v in METRIC_NAMES.items()])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def metrics_source(spark: SparkSession, json_path: str, csv_path: str) -> DataFrame:
    """Metrics from the JSON document, else the CSV, else an empty typed
    table; ``source`` names where they came from ('not_found' when none)."""
    if _exists(spark, json_path):
        return read_metrics_json(spark, json_path).withColumn("source", F.lit(json_path))
    if _exists(spark, csv_path):
        return read_metrics_csv(spark, csv_path).withColumn("source", F.lit(csv_path))
    return spark.createDataFrame([], METRICS_SCHEMA).withColumn("source", F.lit("not_found"))


def upsert_metrics_json(spark: SparkSession, new: DataFrame, path: str) -> DataFrame:
    """S4 merge mode (retrain writes merge, evaluation writes overwrite):
    existing models are replaced by the new rows, the rest kept.  If another
    writer commits meanwhile, the merge is done again on its document."""
    from ..operators.joins import upsert_metrics
    rows = new.select("model", "mae", "rmse", "mape", "r2")

    def write(before, to):
        merged = rows if before is None else upsert_metrics(
            parse_metrics_document(spark.read.text(before).withColumnRenamed("value", "metrics_json")), rows)
        metrics_document(merged).coalesce(1).write.text(to)
    commits.replace(spark, path, write)
    return read_metrics_json(spark, path)
