"""The corpus pipeline: quality classifier, line dedup, SimHash near-dedup,
best-fit packing, each stage one operator of ``gridcast.llm``.

Every stage takes ``(spark, docs, sf_dir)``, works on all that the stage
before it kept, and its result is written as Parquet and read again before
the next.  All but the last return the columns of ``documents``.

Defined results: a null text is scored as the empty text and leaves line dedup
as the empty text; rows without an id are never learned from and go through all
stages; rows that share an id are scored each on its own text, lose the same
lines and are packed each; of equal fingerprints the row with the smallest id
stays; without labels every document is kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridcast.llm import kernel_quality, line_runs, packing, simhash
from gridcast.llm.common import drop_path, scratch_path, table
from gridcast.llm.queries import vocabulary
from gridcast.session import kept


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return kernel_quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that others repeat (n_chars follows)."""
    return line_runs.drop_lines(docs, count_col="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays."""
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 1024 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("best-fit packing", pack),
]

#: Scores, fingerprints and token ids are beyond SQL; tests/llm compares the
#: rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows, as a checkpointed
    table.  What a stage wrote is deleted when the next has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return kept(docs, before)
