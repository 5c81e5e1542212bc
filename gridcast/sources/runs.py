"""Run records (S9): append run parameters and metrics to a Parquet table;
list runs with a display name (run name, else the first 8 characters of the
id) and status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commits


def run_records(metrics: DataFrame, experiment: str, params: dict[str, str] | None = None,
                name_col: str | None = None, status: str = "FINISHED") -> DataFrame:
    """One run per model row of a metrics table: ``run_id`` = md5 of
    experiment and model, ``params``/``metrics`` as maps."""
    p = F.create_map(*[x for k, v in (params or {}).items() for x in (F.lit(k), F.lit(str(v)))]) if params \
        else F.create_map().cast("map<string,string>")
    mcols = [c for c in ("mae", "rmse", "mape", "r2") if c in metrics.columns]
    m = F.create_map(*[x for c in mcols for x in (F.lit(c), F.col(c).cast("double"))])
    return metrics.select(
        F.lit(experiment).alias("experiment"),
        F.md5(F.concat_ws("/", F.lit(experiment), F.col("model"))).alias("run_id"),
        (F.col(name_col) if name_col else F.lit(None).cast("string")).alias("run_name"),
        F.col("model"), F.lit(status).alias("status"),
        F.map_concat(p, F.create_map(F.lit("model"), F.col("model"))).alias("params"),
        m.alias("metrics"))


def log_runs(runs: DataFrame, path: str) -> None:
    """Append runs (partitioned by experiment) by a commit: all of them are
    seen or none, and writers at the same time lose nothing."""
    commits.append(runs.sparkSession, path, lambda to: runs.write.partitionBy("experiment").parquet(to))


def list_runs(runs: DataFrame) -> DataFrame:
    """Display listing: name (run name, else first 8 of the id), status and
    the metrics as columns."""
    name = F.coalesce(F.col("run_name"), F.substring("run_id", 1, 8))
    return runs.select("experiment", "run_id", name.alias("name"), "status", "model",
                       *[F.col("metrics")[k].alias(k) for k in ("mae", "rmse", "mape", "r2")])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(*commits.parts(spark, path)).drop("commit")
