"""Document fingerprints by winnowing.

Every run of ``k`` code points has a rolling hash; of each window of ``w``
consecutive hashes the smallest is chosen, the rightmost of equal ones, and
its position is kept.  Two texts that share a run of ``k + w - 1`` code points
share a chosen hash (the match guarantee), and nothing shorter than ``k``
matches.  Texts with fewer than ``w`` hashes have one window; a text shorter
than ``k`` is one hash of all of it; the empty text has none.

Likeness is the Jaccard index of two texts' distinct chosen hashes (1 for two
empty texts).

The next document is the one that follows by ascending id.  Documents are
dealt into id ranges; each range also gets the first document of the next
range (and the last one the first of all), so every task sees its successors
and texts move once.

Defined results: null text is the empty text; null ids come first; rows of one
id follow each other in order of their texts' hash; a single row's next
document is itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_arrow, shuffle_parts, texts_of

K = 15
W = 16
_BASE = 0x9E3779B97F4A7C15 | 1


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _inverse(x: int) -> int:
    y = x
    for _ in range(6):
        y = y * (2 - x * y) & ((1 << 64) - 1)
    return y


_UNDO = _inverse(_BASE)
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
#: Longest table of powers that a worker keeps (32 MB each).
_KEEP_POWERS = 1 << 22


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    size = max(n, min(2 * n, _KEEP_POWERS))
    made = []
    for x in (_BASE, _UNDO):
        p = np.full(size, x, dtype=np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if size <= _KEEP_POWERS:
        _POWERS[:] = made
    return made[0][:n], made[1][:n]


def rolling_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of every run of ``k`` code points (one of all, if fewer)."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    k = min(k, n)
    up, down = _powers(n)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    h = (total[k:] - total[:n - k + 1]) * down[:n - k + 1] + np.uint64(k)
    h ^= h >> np.uint64(31)  # spread, so that the smallest is any run
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, positions)`` chosen from a text, by ascending position."""
    h = rolling_hashes(_code_points(text), k)
    n = len(h)
    if not n:
        return h, np.zeros(0, dtype=np.int64)
    w = min(w, n)
    best, at = h, np.arange(n, dtype=np.int32)
    span = 1
    while span < w:  # windows of span and then of min(2 span, w) hashes
        step = min(span, w - span)
        left, right = best[:len(best) - step], best[step:]
        take = right <= left  # the rightmost of equal ones
        best = np.where(take, right, left)
        at = np.where(take, at[step:], at[:len(at) - step])
        span += step
    new = np.ones(len(at), dtype=bool)
    new[1:] = at[1:] != at[:-1]
    at = at[new]
    return h[at], at.astype(np.int64)


def digest(hashes: np.ndarray, positions: np.ndarray) -> str:
    """A fingerprint's short name: hash of its hashes and positions."""
    return hashlib.blake2b(hashes.tobytes() + positions.astype("<i8").tobytes(), digest_size=16).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sorted sets of hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def document_fingerprints(docs: DataFrame, k: int = K, w: int = W, id_col: str = "doc_id",
                          text_col: str = "text") -> DataFrame:
    """``doc_id, hashes, positions`` of every whole text."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [winnow(t, k, w) for t in texts_of(batch.column(1))]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([h.view(np.int64) for h, _ in got], pa.list_(pa.int64())),
             pa.array([p for _, p in got], pa.list_(pa.int64()))], names=["doc_id", "hashes", "positions"])

    return map_arrow(docs.select(id_col, text_col),
                     f"doc_id {dict(docs.dtypes)[id_col]}, hashes array<long>, positions array<long>", run)


def with_successors(docs: DataFrame, ranges: int, id_col: str, text_col: str) -> DataFrame:
    """Rows ``range, halo, doc_id, text`` dealt so that each range, sorted,
    ends with (halo) the document that follows its last one.  Only the cuts
    and first ids of the ranges reach the driver."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ask = [i / ranges for i in range(1, ranges)]
    cuts = slim.agg(F.percentile_approx("doc_id", ask, 100 * ranges).alias("q")).first()["q"] if ask else None
    cuts = sorted(set(cuts or []))
    n = len(cuts) + 1
    # number of cuts at or below the id, by halving; null ids are in range 0
    halving = f"""aggregate(sequence(1, {n.bit_length() + 1}), named_struct('lo', 0, 'hi', {n - 1}),
        (s, i) -> if(s.lo >= s.hi, s, if(element_at(__cuts, cast((s.lo + s.hi) div 2 as int) + 1) <= doc_id,
            named_struct('lo', cast((s.lo + s.hi) div 2 as int) + 1, 'hi', s.hi),
            named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) div 2 as int)))), s -> s.lo)"""
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    if cuts:
        slim = slim.withColumn("__cuts", longs(cuts)).withColumn("range", F.expr(halving).cast("int")).drop("__cuts")
    else:
        slim = slim.withColumn("range", F.lit(0))
    first = {r["range"]: r["f"]["doc_id"] for r in slim.groupBy("range").agg(
        F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id")).alias("f")).collect()}
    order = sorted(first)
    before = dict(zip(order[1:] + order[:1], order, strict=True))  # the range that needs a range's first document
    to = F.when(F.col("doc_id").eqNullSafe(F.element_at(longs([first.get(r) for r in range(n)]), F.col("range") + 1)),
                F.element_at(longs([before.get(r, 0) for r in range(n)]), F.col("range") + 1).cast("int"))
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("halo"))
    both = F.array(own, F.struct(F.col("__to").alias("range"), F.lit(1).alias("halo")))
    dealt = (slim.withColumn("__to", to)
             .select("doc_id", "text", F.explode(F.when(F.col("__to").isNull(), F.array(own)).otherwise(both)).alias("c"))
             .select("c.range", "c.halo", "doc_id", "text"))
    return (dealt.repartitionById(n, F.col("range"))
            .sortWithinPartitions("range", "halo", F.col("doc_id").asc_nulls_first(), F.xxhash64("text")))


def edited_fingerprints(docs: DataFrame, k: int = K, w: int = W, ranges: int | None = None, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited form, whose last ``n // 4`` code
    points are the first as many of the next document; one row per document:
    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_fingerprints``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    dealt = with_successors(docs, ranges or shuffle_parts(spark), id_col, text_col)
    kinds = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double, n_fingerprints long")

    def sets(text: str):
        h, p = winnow(text, k, w)
        return h, p, np.unique(h)

    def row(doc, text, mine, nxt_text, nxt):
        quarter = len(text) // 4
        edited = text[:len(text) - quarter] + nxt_text[:quarter]
        h, p, unique = sets(edited)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return (doc, len(text), sha, digest(mine[0], mine[1]), digest(h, p), likeness(mine[2], unique),
                likeness(mine[2], nxt[2]), len(mine[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None   # the document that waits for its successor
        halo = False  # has this range's halo been met?
        for b in batches:
            out = []
            for r, is_halo, doc, text in zip(*[b.column(c).to_pylist() for c in range(4)], strict=True):
                if held is not None and held[0] != r:
                    raise AssertionError("a range ended without its successor")
                if is_halo and halo:
                    continue  # more rows of the successor's id
                text = text or ""
                mine = sets(text)
                if held is not None:
                    out.append(row(held[1], held[2], held[3], text, mine))
                halo = bool(is_halo)
                held = None if is_halo else (r, doc, text, mine)
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.string()) for c in cols[2:5]],
                     *[pa.array(c, pa.float64()) for c in cols[5:7]], pa.array(cols[7], pa.int64())],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
                           "near_next", "n_fingerprints"])

    return dealt.mapInArrow(run, kinds)
