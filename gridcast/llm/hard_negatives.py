"""Hard negatives by a vertical scan with branch and bound (BOND).

Vectors are dealt into blocks; a task turns a block into columns, a dimension
each, and meets the anchors one by one.  An anchor reads the columns in the
descending order of its own magnitudes, a few at a time.  What the columns not
yet read can still add to a score lies between the sums of the products with
the block's smallest and largest entries there, so every candidate has a lower
and an upper bound, and the bitmap of candidates shrinks:

* positives (equal label): a candidate goes when its upper bound is under the
  ``k``-th best lower bound;
* negatives (another label): a candidate goes when its bounds miss the windows
  of all positives, or when in each window that it may hit, enough others surely
  hit it with a lower bound above its upper one.

What is left when all columns are read has its exact integer score.  A block
gives at most ``k`` rows per anchor and window; ranks over them are whole.

Every anchor meets every block: that set of queries against all rows is the
work asked for, a block and an anchor are what one task holds.

Defined results: rows with a null id, a null label, a vector that is null or
empty, has a null or non-finite entry, or one so large that a score might not
fit a long take no part; shorter vectors count as padded with zeros; every row
is a row of its own, also where ids repeat (its equals are other rows); ties go
to the smaller id; an anchor without positives, and a positive without negatives
in its window, give no rows; an empty table gives none; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, shuffle_parts

POSITIVES = 5
NEGATIVES = 3
#: A negative's score as a share of its positive's, in hundredths.
LOW, HIGH = 50, 95
SCALE = 256
#: Most vectors in a block, and the fewest worth a task of their own.
BLOCK = 32768
LEAST = 1024
#: Columns read between two looks at the bounds.
STEP = 8


def integer_vectors(vectors: DataFrame, label: Column, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding",
                    scale: int = SCALE) -> DataFrame:
    """``row, vec_id, label, anchor, vec`` of the rows that take part, the
    vectors as integers ``floor(scale * x)``."""
    vec = F.col("vec")
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                           F.coalesce(anchor, F.lit(False)).alias("anchor"),
                           F.col(vec_col).cast("array<double>").alias("vec"))
            .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()))
    dim = rows.agg(F.max(F.size(vec)).alias("dim")).first()["dim"] or 1
    most = float(math.isqrt((1 << 62) // max(1, dim)))
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < most - 1))
    return materialize(rows.where(F.coalesce((F.size(vec) > 0) & ok, F.lit(False)))
                       .withColumn("vec", F.transform(vec, lambda x: F.floor(x * scale).cast("long")))
                       .withColumn("row", F.monotonically_increasing_id()))  # written once, so fixed


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), dim), np.int64)
    out[np.arange(dim)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class Columns:
    """A block of vectors by dimension, with the range of each."""

    def __init__(self, row, vec_id, label, vectors: np.ndarray):
        self.row, self.vec_id, self.label = row, vec_id, label
        self.of = np.ascontiguousarray(vectors.T)
        self.low, self.high = vectors.min(axis=0), vectors.max(axis=0)

    def scan(self, anchor: np.ndarray, alive: np.ndarray, shrink) -> tuple[np.ndarray, np.ndarray]:
        """Candidates that ``shrink(low bounds, high bounds)`` leaves, and
        their exact scores; ``alive``: indices to begin with."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack([anchor * self.low, anchor * self.high])[:, order]
        # what the columns from each place in the order on can add, at least and at most
        rest = np.concatenate([np.cumsum(np.sort(ends, axis=0)[:, ::-1], axis=1)[:, ::-1], np.zeros((2, 1), np.int64)], axis=1)
        score = np.zeros(len(alive), np.int64)
        for k in range(0, len(order), STEP):
            read = order[k:k + STEP]
            columns = self.of[read]
            score = score + anchor[read] @ (columns if len(alive) == self.of.shape[1] else columns[:, alive])
            least, most = rest[:, min(k + STEP, len(order))]
            stay = shrink(score + least, score + most)
            if not stay.all():
                alive, score = alive[stay], score[stay]
            if not len(alive):
                break
        return alive, score


def _best(score: np.ndarray, vec_id: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by id."""
    return np.lexsort((row, vec_id, -score))[:k]


def kth_best(values: np.ndarray, k: int):
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else None


def positives_in(block: Columns, row: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's ``k`` best rows of the anchor's label, and their scores."""
    def shrink(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        bar = kth_best(low, k)
        return np.ones(len(low), bool) if bar is None else high >= bar

    alive = np.flatnonzero((block.label == label) & (block.row != row))
    alive, score = block.scan(anchor, alive, shrink) if len(alive) else (alive, alive)
    best = _best(score, block.vec_id[alive], block.row[alive], k)
    return alive[best], score[best]


def negatives_in(block: Columns, label: int, anchor: np.ndarray, windows: list[tuple[int, int]],
                 k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window of scores the block's ``k`` best rows of another
    label within it, and their scores."""
    def shrink(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(low), bool)
        for bottom, top in windows:
            may = (high >= bottom) & (low <= top)
            bar = kth_best(low[(low >= bottom) & (high <= top)], k)
            stay |= may if bar is None else may & (high >= bar)
        return stay

    alive = np.flatnonzero(block.label != label)
    alive, score = block.scan(anchor, alive, shrink) if len(alive) else (alive, alive)
    out = []
    for bottom, top in windows:
        hit = np.flatnonzero((score >= bottom) & (score <= top))
        hit = hit[_best(score[hit], block.vec_id[alive[hit]], block.row[alive[hit]], k)]
        out.append((alive[hit], score[hit]))
    return out


def window_of(positive: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Integer scores ``s`` with ``low * positive <= 100 s <= high * positive``."""
    return -(-low * positive // 100), high * positive // 100


def _dealt(rows: DataFrame, blocks: int, anchors: DataFrame) -> DataFrame:
    """Blocks of rows, each followed by all anchors (columns ``windows`` of
    ``anchors``: what was found for them so far)."""
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    held = rows.select(block.alias("block"), F.lit(0).alias("kind"), "row", "vec_id", "label", "vec",
                       F.lit(None).cast("array<long>").alias("scores"))
    asks = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "row",
                          "vec_id", "label", "vec", "scores")
    return (held.union(asks).repartition(max(blocks, shuffle_parts(rows.sparkSession)), "block")
            .sortWithinPartitions("block", "kind"))


def _per_block(dealt: DataFrame, dim: int, schema: str, ask) -> DataFrame:
    """``ask(block, row, id, label, vector, scores)`` of every anchor and
    block; it returns rows."""
    bounded_batches(dealt.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, block = None, [], None
        for b in batches:
            keys, kinds = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            cut = np.flatnonzero((np.diff(keys) != 0) | (np.diff(kinds) != 0)) + 1
            edges = [0, *cut.tolist(), b.num_rows]
            for x, y in zip(edges, edges[1:], strict=False):
                if x == y:
                    continue
                part = b.slice(x, y - x)
                if int(keys[x]) != key:
                    key, parts, block = int(keys[x]), [], None
                row, vec_id, label = (part.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4))
                if not kinds[x]:
                    parts.append((row, vec_id, label, _matrix(part.column(5), dim)))
                    continue
                if not parts:
                    continue
                if block is None:
                    block = Columns(*(np.concatenate(p) for p in zip(*parts, strict=True)))
                vectors, out = _matrix(part.column(5), dim), []
                for i, scores in enumerate(part.column(6).to_pylist()):
                    out += ask(block, int(row[i]), int(vec_id[i]), int(label[i]), vectors[i], scores)
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, o, strict=True)) for o in out],
                                                     pa.schema([(c, pa.int64()) for c in names]))

    return dealt.mapInArrow(run, schema)


def mine(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score`` from :func:`integer_vectors`."""
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    n, dim = size["n"], size["dim"] or 1
    blocks = max(1, -(-n // BLOCK), min(shuffle_parts(rows.sparkSession), n // LEAST))
    anchors = rows.where("anchor").withColumn("scores", F.lit(None).cast("array<long>"))

    def find_positives(block, row, vec_id, label, vector, scores):
        at, score = positives_in(block, row, label, vector, positives)
        return [(row, int(block.vec_id[i]), int(block.row[i]), int(s)) for i, s in zip(at, score, strict=True)]

    found = _per_block(_dealt(rows, blocks, anchors), dim, "row long, positive_id long, positive_row long, score long",
                       find_positives)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "positive_id", "positive_row")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    # at most `positives` entries an anchor
    pos = materialize(best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "score"))).alias("p")))
    asking = rows.where("anchor").join(pos, "row").withColumn("scores", F.transform("p", lambda p: p["score"]))

    def find_negatives(block, row, vec_id, label, vector, scores):
        out = []
        hits = negatives_in(block, label, vector, [window_of(s, low, high) for s in scores], negatives)
        for place, (at, score) in enumerate(hits, 1):
            out += [(row, vec_id, place, int(block.vec_id[i]), int(block.row[i]), int(s))
                    for i, s in zip(at, score, strict=True)]
        return out

    hits = _per_block(_dealt(rows, blocks, asking), dim,
                      "row long, anchor_id long, place long, negative_id long, negative_row long, negative_score long",
                      find_negatives)
    order = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id", "negative_row")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    taken = F.element_at("p", F.col("place").cast("int"))
    return (ranked.join(pos, "row")
            .select("anchor_id", taken["positive_id"].alias("positive_id"), "rank", "negative_id",
                    taken["score"].alias("positive_score"), "negative_score"))
