"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at its ends, A-Z
lower-cased; keys shorter than ``min_chars`` code points are never dropped.
The 128-bit hash of a key stands for it.

Documents arrive in batches of descending ids.  The store holds *runs*: tables
``(h1, h2, docs, owner)`` partitioned and sorted by hash.  A new batch is
reduced to its own distinct keys, merge-anti-joined with the keys that the
runs already know in ``min_docs`` documents (nothing more about those can
change: the batches descend, so their owner is known too), and what is left
becomes a run of its own.  ``FANOUT`` runs of a level are compacted into one
of the next level.  In the end a key of ``min_docs`` documents or more keeps
its lines only in its owner, the largest id that holds it.

Both sides of every join are rows of one hash; texts are moved once, to meet
their own documents' dropped keys.

Defined results: a null or empty text is one empty line (a null text comes
back as the empty text); rows that share an id count as one document and are
treated alike; rows without an id are neither counted nor changed; an empty
table gives no rows; other columns pass through ``drop_lines`` untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, shuffle_parts

MIN_CHARS = 20
MIN_DOCS = 3
#: Batches that documents are dealt into by id, and runs of one level.
BATCHES = 4
FANOUT = 3

_BLANK = " \t\n\x0b\x0c\r"


def key_hash(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit hash of a line's key; None if the key is too short."""
    import xxhash
    key = line.strip(_BLANK)
    if len(key) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower())


def _halves(hashes: list[bytes]) -> list[pa.Array]:
    two = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
    return [pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())]


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct ``doc_id, h1, h2`` of each row's lines (rows with an id)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, hashes = [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            found = {key_hash(line, min_chars) for line in (text or "").split("\n")} - {None}
            rows += [i] * len(found)
            hashes += found
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), *_halves(hashes)],
                                          names=["doc_id", "h1", "h2"])

    return map_arrow(docs.where(F.col(id_col).isNotNull()).select(id_col, text_col),
                     f"doc_id {dict(docs.dtypes)[id_col]}, h1 long, h2 long", run)


class LineRuns:
    """The levelled store of line-key runs; feed batches of descending ids."""

    def __init__(self, parts: int, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.parts, self.min_docs, self.fanout = parts, min_docs, fanout
        self.levels: list[list[DataFrame]] = []

    def _sorted_run(self, rows: DataFrame) -> DataFrame:
        return materialize(rows.repartition(self.parts, "h1", "h2").sortWithinPartitions("h1", "h2"))

    def merged(self) -> DataFrame | None:
        """All runs as one table, a row per key."""
        runs = [r for level in self.levels for r in level]
        if not runs:
            return None
        return _merge(runs)

    def add(self, keys: DataFrame) -> None:
        """Add a batch (distinct ``doc_id, h1, h2``, ids below all before)."""
        own = keys.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("owner"))
        known = self.merged()
        if known is not None:
            settled = known.where(F.col("docs") >= self.min_docs).select("h1", "h2")
            own = own.join(settled.hint("merge"), ["h1", "h2"], "left_anti")
        self._put(self._sorted_run(own), 0)

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(self._sorted_run(_merge(full)), level + 1)


def _merge(runs: list[DataFrame]) -> DataFrame:
    rows = runs[0]
    for r in runs[1:]:
        rows = rows.union(r)
    return rows.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("owner").alias("owner"))


def batch_bounds(keys: DataFrame, batches: int) -> list:
    """Ids that cut the documents into about equal batches, ascending."""
    if batches < 2:
        return []
    ask = [k / batches for k in range(1, batches)]
    got = keys.select("doc_id").agg(F.percentile_approx("doc_id", ask, 1000).alias("q")).first()["q"]
    return sorted(set(got or []))


def dropped_keys(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, h1, h2``: keys whose lines the document loses."""
    keys = materialize(line_keys(docs, min_chars, id_col, text_col).distinct()
                       if _may_repeat(docs, id_col) else line_keys(docs, min_chars, id_col, text_col))
    bounds = batch_bounds(keys, batches)
    store = LineRuns(shuffle_parts(docs.sparkSession), min_docs)
    for low, high in zip([None, *bounds][::-1], [*bounds, None][::-1], strict=True):
        part = keys
        if low is not None:
            part = part.where(F.col("doc_id") >= F.lit(low))
        if high is not None:
            part = part.where(F.col("doc_id") < F.lit(high))
        store.add(part)
    # written, so that the join below is between two plain exchanges and a hot line's rows can be split
    common = materialize(store.merged().where(F.col("docs") >= min_docs).select("h1", "h2", "owner"))
    return keys.join(common, ["h1", "h2"]).where("doc_id <> owner").select("doc_id", "h1", "h2")


def _may_repeat(docs: DataFrame, id_col: str) -> bool:
    n = docs.where(F.col(id_col).isNotNull()).agg(F.count("*").alias("n"), F.count_distinct(id_col).alias("d")).first()
    return n["n"] != n["d"]


def _with_dropped(docs: DataFrame, dropped: DataFrame, id_col: str) -> DataFrame:
    lists = (dropped.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("__dropped"))
             .withColumnRenamed("doc_id", "__id"))  # at most a document's own lines
    return docs.join(lists, F.col(id_col) == F.col("__id"), "left").drop("__id")


def _keep(text: str, dropped: list, min_chars: int) -> tuple[int, list[str]]:
    lines = text.split("\n")
    if not dropped:
        return len(lines), lines
    gone = {int(d["h1"]).to_bytes(8, "little", signed=True) + int(d["h2"]).to_bytes(8, "little", signed=True)
            for d in dropped}
    return len(lines), [x for x in lines if key_hash(x, min_chars) not in gone]


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES,
               id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the repeated lines gone from its texts (same columns);
    ``count_col`` names a column that holds the text's length in code points
    and follows it."""
    joined = _with_dropped(docs, dropped_keys(docs, min_docs, min_chars, batches, id_col, text_col), id_col)
    at = joined.columns.index(text_col)
    gone = joined.columns.index("__dropped")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(at).to_pylist()]
        texts = ["\n".join(_keep(t, d, min_chars)[1]) if d else t
                 for t, d in zip(texts, batch.column(gone).to_pylist(), strict=True)]
        cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns) if i != gone]
        return pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols))])

    kinds = [docs.schema[c].dataType.simpleString() for c in docs.columns]
    out = map_arrow(joined, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)), run).toDF(*docs.columns)
    if count_col:
        out = out.withColumn(count_col, F.length(text_col).cast(dict(docs.dtypes)[count_col]))
    return out


def line_report(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every row."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    joined = _with_dropped(slim, dropped_keys(slim, min_docs, min_chars, batches), "doc_id")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, lost, sha = [], [], []
        for t, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            n, kept = _keep(t or "", d, min_chars)
            total.append(n)
            lost.append(n - len(kept))
            sha.append(hashlib.sha256("\n".join(kept).encode("utf-8", "surrogatepass")).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(lost, pa.int64()),
                                           pa.array(sha)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return map_arrow(joined, f"doc_id {dict(slim.dtypes)['doc_id']}, n_lines long, n_dropped long, kept_sha256 string",
                     run)
