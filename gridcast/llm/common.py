"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, drop_path, materialize, scratch_path  # noqa: F401  (re-exported)

#: Rows of one Arrow batch handed to a Python task.  Texts may be long, so a
#: batch stays a few MB; the value bounds memory, not what is processed.
BATCH_ROWS = 500


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small (rows per batch of this session)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """Apply a batch-to-batch function inside tasks (one batch in memory)."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn(b)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow text column, null as the empty text."""
    return [t or "" for t in column.to_pylist()]


def crc32_mod(id_col: str, mod: int):
    """``crc32(id as text) mod m`` (null ids: null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(mod)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
