"""Removal of repeated byte strings by longest previous factors.

A byte goes if a string of ``SPAN`` bytes that covers it also starts earlier: in
a smaller document, or in the same one further left.  So a start ``p`` is lost
exactly if the longest factor that begins at ``p`` and also begins earlier, its
``LPF[p]``, has ``SPAN`` bytes or more.

Only suffixes that can share so much need one order.  Every window of ``SPAN``
bytes names a *seed*, its ``GRAM``-byte string with the smallest hash (the
rightmost of equals): windows that are equal have equal seeds at equal places.
Consecutive windows with one seed form a *run*, whose text is one segment.

1. Runs are grouped by seed and 128 bits of hash (seed, segment).  Equal
   segments stay in their first place, later ones lose all their windows.
   Tasks settle their own equal segments before the shuffle, so that a segment
   that is everywhere costs a row a task; rows that are settled travel by their
   own hash.
2. Where several different segments share a seed, their windows are ordered as
   suffixes of one text: suffix array, common prefixes of neighbours, and from
   each place the previous and the next smaller position in that order.  The
   longer common prefix with one of these two is LPF.
3. A seed with more than ``HOT`` different segments is no group for one task:
   the windows of its runs go on one by one, grouped by 128 bits of hash.

Texts are moved compressed, once to the runs of step 2 and once to the removal.

Defined results: a null text is the empty one; nothing is removed from texts of
fewer than ``SPAN`` bytes; rows without an id come after all others; of rows
that share an id (or have none) those earlier in the written table come first,
each is a document of its own; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept
from .common import bounded_batches, map_arrow, materialize, scratch_path, shuffle_parts

SPAN = 100
GRAM = 32
#: Different segments of one seed that one task orders.
HOT = 4096
#: Windows ordered at a time, rows settled by a task before the shuffle, and
#: bytes of a text looked at together: bounds of memory.
ORDERED = 1 << 17
SETTLED = 1 << 18
PIECE = 1 << 22

_LAST = (1 << 63) - 1
_U = np.uint64
_RUN = "key long, h long, doc long, copy long, start long, n int"
_NAMES = ["key", "h", "doc", "copy", "start", "n"]


@functools.cache
def _byte_hashes(gram: int) -> np.ndarray:
    return np.random.default_rng(gram).integers(1, 1 << 63, 256, dtype=_U)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit hashes of all strings of ``gram`` (a power of two) bytes."""
    h = _byte_hashes(gram)[data]
    factor, length = _U(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        while length < gram:
            right = h[length:]
            h = h[:-length] * factor + (right ^ (right >> _U(29)))
            factor, length = factor * factor + _U(2 * length), 2 * length
        h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
        return h ^ (h >> _U(32))


def seed_runs(data: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one seed: first window, number, hash of the seed."""
    h = gram_hashes(data, gram)
    width = span - gram + 1
    low, have = h, 1
    while have < width:
        step = min(have, width - have)
        low, have = np.minimum(low[:-step], low[step:]), have + step
    new = np.empty(len(low), bool)
    new[0] = True
    # the seed moves when the smallest hash changes or an equal one comes in from the right
    np.logical_or(low[1:] != low[:-1], h[width:] == low[1:], out=new[1:])
    start = np.flatnonzero(new)
    return start, np.diff(start, append=len(low)), low[start]


def runs_of(text: bytes, span: int = SPAN, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Seed hash, segment hash, first window and number of windows of the
    runs of a text, a bounded piece at a time."""
    import xxhash
    view, data = memoryview(text), np.frombuffer(text, np.uint8)
    for a in range(0, len(data) - span + 1, PIECE):
        start, n, seed = seed_runs(data[a:a + PIECE + span - 1], span, gram)
        start += a
        h = np.fromiter((xxhash.xxh3_64_intdigest(view[s:s + m + span - 1]) for s, m in zip(start.tolist(), n.tolist(), strict=True)),
                        _U, len(start))
        yield seed.view(np.int64), h.view(np.int64), start, n


def _batch(cols: list, names: list[str] = _NAMES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)


def settle_here(key, h, doc, copy, start, n) -> pa.RecordBatch:
    """The rows of one task, equal segments settled: the first of each stays;
    the windows of the others are lost, which a negative number tells, joined
    to stretches and keyed by their place."""
    order = np.lexsort((start, copy, doc, h, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order[1:]] != key[order[:-1]]) | (h[order[1:]] != h[order[:-1]])
    stay, gone = order[new], order[~new]
    gone = gone[np.lexsort((start[gone], copy[gone], doc[gone]))]
    d, c, s, m = doc[gone], copy[gone], start[gone], n[gone].astype(np.int64)
    head = np.ones(len(gone), bool)
    head[1:] = (d[1:] != d[:-1]) | (c[1:] != c[:-1]) | (s[1:] != s[:-1] + m[:-1])
    at = np.flatnonzero(head)
    d, c, s, m = d[at], c[at], s[at], np.add.reduceat(m, at) if len(at) else m
    while (m >= 1 << 31).any():  # a stretch is a number of 32 bits
        big = m >= 1 << 31
        d, c = np.append(d, d[big]), np.append(c, c[big])
        s, m = np.append(s, s[big] + (1 << 30)), np.append(np.where(big, 1 << 30, m), m[big] - (1 << 30))
    place = ((d + c) * 0x9E3779B9 + s).astype(np.int64)
    join = [np.concatenate(x) for x in ((key[stay], place), (h[stay], place), (doc[stay], d), (copy[stay], c), (start[stay], s))]
    return _batch([*join, np.concatenate([n[stay], -m]).astype(np.int32)])


def _gathered(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`runs_of` with their place, settled a buffer at a time."""
    held, count = [], 0
    for r in rows:
        held.append(r)
        count += len(r[0])
        if count >= SETTLED:
            yield settle_here(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, count = [], 0
    if held:
        yield settle_here(*(np.concatenate(x) for x in zip(*held, strict=True)))


class Settler:
    """Rows sorted by seed, segment and place: later equal segments are lost,
    different segments of one seed are contested (numbered from 0 per seed)."""

    def __init__(self):
        self.key = self.h = None
        self.count, self.pending = 0, None

    def feed(self, key, h, doc, copy, start, n) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple | None]:
        """``(later, contested, ordinal, earlier)``: rows whose segment came
        before; first rows of contested segments with their ordinal; and a
        first row of an earlier batch that is contested now."""
        new_key = np.ones(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        new = new_key.copy()
        new[1:] |= h[1:] != h[:-1]
        new_key[0] = self.key is None or int(key[0]) != self.key
        new[0] = new_key[0] or int(h[0]) != self.h
        first = np.flatnonzero(new)
        group = np.cumsum(new_key)[first]  # 0: goes on from the batch before
        base = np.searchsorted(group, group)
        ordinal = np.arange(len(first)) - base + np.where(group == 0, self.count, 0)
        more = np.zeros(len(first), bool)
        more[:-1] = group[1:] == group[:-1]
        contested = (ordinal > 0) | more
        earlier = None
        if len(first) and group[0] == 0 and self.pending is not None:
            earlier, self.pending = self.pending, None
        if new_key.any():
            self.pending, self.count = None, 0
        if len(first):
            self.count = int(ordinal[-1]) + 1
            if ordinal[-1] == 0:
                i = first[-1]
                self.pending = tuple(int(x[i]) for x in (key, h, doc, copy, start, n))
        self.key, self.h = int(key[-1]), int(h[-1])
        return np.flatnonzero(~new), first[contested], ordinal[contested], earlier


def settle(runs: DataFrame) -> DataFrame:
    """``key, doc, copy, start, n, ordinal``: lost stretches (ordinal -1) and
    contested runs, out of rows of :func:`settle_here`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Settler()
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            done = cols[5] < 0
            out = [[c[done] for c in (cols[0], *cols[2:5])] + [-cols[5][done], np.full(int(done.sum()), -1, np.int32)]]
            open_ = [c[~done] for c in cols]
            if len(open_[0]):
                later, contested, ordinal, earlier = state.feed(*open_)
                take = [open_[k] for k in (0, 2, 3, 4, 5)]
                out.append([c[later] for c in take] + [np.full(len(later), -1, np.int32)])
                out.append([c[contested] for c in take] + [ordinal.astype(np.int32)])
                if earlier:
                    out.append([np.array([earlier[k]]) for k in (0, 2, 3, 4, 5)] + [np.zeros(1, np.int32)])
            whole = [np.concatenate(x) for x in zip(*out, strict=True)]
            if len(whole[0]):
                whole[4] = whole[4].astype(np.int32)
                yield _batch(whole, ["key", "doc", "copy", "start", "n", "ordinal"])

    return (runs.repartition(shuffle_parts(runs.sparkSession), "key").sortWithinPartitions("key", "h", "doc", "copy", "start")
            .mapInArrow(run, "key long, doc long, copy long, start long, n int, ordinal int"))


def suffix_order(data: np.ndarray, starts: np.ndarray, group: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at ``starts`` by group and first ``span`` bytes (ties: as
    they come), and the bytes that each shares with the one before it."""
    text = np.lib.stride_tricks.sliding_window_view(data, span)[starts]
    named = np.concatenate([group.astype(">u4").view(np.uint8).reshape(-1, 4), text], axis=1)
    order = np.argsort(np.ascontiguousarray(named).view(f"S{span + 4}").ravel(), kind="stable")
    named = named[order]
    same = named[1:] == named[:-1]
    prefix = np.where(same.all(axis=1), span + 4, same.argmin(axis=1))
    return order, np.concatenate([[0], np.maximum(prefix - 4, 0)])


def _smaller_before(position: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each place of an order the bytes shared with the nearest place
    before it that holds a smaller position (``shared``: with the place just
    before).  Pointers skip what is known to be larger."""
    at, common = np.arange(len(position)) - 1, shared.copy()
    open_ = np.flatnonzero((at >= 0) & (common > 0))
    open_ = open_[position[at[open_]] > position[open_]]
    while len(open_):
        to = at[open_]
        common[open_], at[open_] = np.minimum(common[open_], common[to]), at[to]
        open_ = open_[(at[open_] >= 0) & (common[open_] > 0)]
        open_ = open_[position[at[open_]] > position[open_]]
    return np.where(at < 0, 0, common)


def longest_previous(data: np.ndarray, starts: np.ndarray, group: np.ndarray, span: int = SPAN) -> np.ndarray:
    """LPF, up to ``span``, of the suffixes at ``starts``, which are given in
    the order of their positions; groups are texts of their own."""
    position, shared = suffix_order(data, starts, group, span)
    previous = _smaller_before(position, shared)
    following = _smaller_before(position[::-1], np.concatenate([[0], shared[:0:-1]]))[::-1]
    out = np.empty(len(starts), np.int64)
    out[position] = np.maximum(previous, following)
    return out


def _lost_windows(rows: list[tuple], span: int) -> Iterator[tuple[int, int, int, int]]:
    """Lost stretches ``doc, copy, start, n`` of runs ``key, doc, copy,
    start, n, segment`` that come sorted by seed and place."""
    data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    n = np.array([r[4] for r in rows])
    begin = np.cumsum(n + span - 1) - (n + span - 1)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    key = np.array([r[0] for r in rows])
    group = np.repeat(np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])), n)
    lost = longest_previous(data, np.repeat(begin, n) + offset, group, span) >= span
    run = np.repeat(np.arange(len(rows)), n)
    head = np.flatnonzero(lost & np.concatenate([[True], ~lost[:-1] | (run[1:] != run[:-1])]))
    tail = np.flatnonzero(lost & np.concatenate([~lost[1:] | (run[1:] != run[:-1]), [True]]))
    for a, b in zip(head.tolist(), tail.tolist(), strict=True):
        r = rows[run[a]]
        yield r[1], r[2], r[3] + int(offset[a]), b - a + 1


def _zip(docs: DataFrame) -> DataFrame:
    """``doc, copy`` and the text, compressed."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard
        pack = zstandard.ZstdCompressor(level=1).compress
        texts = [pack((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], names=["doc", "copy", "z"])

    return map_arrow(docs, "doc long, copy long, z binary", run)


def contested_rows(docs: DataFrame, contested: DataFrame, span: int = SPAN) -> DataFrame:
    """The segments of contested runs; of hot seeds the single windows."""
    lists = contested.groupBy("doc", "copy").agg(F.collect_list(F.struct("key", "start", "n", "hot")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard
        unpack = zstandard.ZstdDecompressor().decompress
        windows, held = [], 0

        def flush():
            b = settle_here(*(np.concatenate(x) for x in zip(*windows, strict=True)))
            return pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.binary())], names=[*_NAMES, "segment"])

        for b in batches:
            rows = []
            for doc, copy, z, runs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = unpack(z)
                for r in runs:
                    s, m = r["start"], r["n"]
                    if not r["hot"]:
                        rows.append((r["key"], 0, doc, copy, s, m, text[s:s + m + span - 1]))
                        continue
                    names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(text[p:p + span]) for p in range(s, s + m)), "<i8").reshape(-1, 2)
                    windows.append((names[:, 0], names[:, 1], np.full(m, doc), np.full(m, copy), np.arange(s, s + m), np.ones(m, np.int64)))
                    held += m
                if held >= SETTLED:
                    yield flush()
                    windows, held = [], 0
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.int32()),
                                                  pa.array(cols[6], pa.binary())], names=[*_NAMES, "segment"])
        if windows:
            yield flush()

    return _zip(docs).join(lists, ["doc", "copy"]).mapInArrow(run, _RUN + ", segment binary")


def order_contested(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """Lost stretches ``doc, copy, start, n`` of :func:`contested_rows`."""
    def out(parts: list) -> Iterator[pa.RecordBatch]:
        if parts:
            doc, copy, start, n = zip(*parts, strict=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (doc, copy, start)), pa.array(n, pa.int32())],
                                             names=["doc", "copy", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held, windows = Settler(), [], 0
        for b in batches:
            single = b.column(6).is_null().to_numpy(zero_copy_only=False)
            cols = [c.to_numpy(zero_copy_only=False)[single] for c in b.columns[:6]]
            done = cols[5] < 0
            parts = list(zip(*(c[done].tolist() for c in cols[2:5]), (-cols[5][done]).tolist(), strict=True))
            cols = [c[~done] for c in cols]
            if len(cols[0]):
                later = state.feed(*cols)[0]
                parts += zip(*(c[later].tolist() for c in cols[2:6]), strict=True)
            yield from out(parts)
            for r in zip(*(b.column(k).filter(pa.array(~single)).to_pylist() for k in (0, 2, 3, 4, 5, 6)), strict=True):
                if windows >= ORDERED and r[0] != held[-1][0]:
                    yield from out(list(_lost_windows(held, span)))
                    held, windows = [], 0
                held.append(r)
                windows += r[4]
        if held:
            yield from out(list(_lost_windows(held, span)))

    return (rows.repartition(shuffle_parts(rows.sparkSession), "key").sortWithinPartitions("key", "h", "doc", "copy", "start")
            .mapInArrow(run, "doc long, copy long, start long, n int"))


def cut(text: bytes, stretches: list, span: int = SPAN) -> tuple[bytes, int, int]:
    """What is left of a text without the bytes of lost windows, how many
    bytes go, and in how many runs."""
    if not stretches:
        return text, 0, 0
    begin = np.array([s["start"] for s in stretches], np.int64)
    end = begin + np.array([s["n"] for s in stretches], np.int64) + span - 1
    step = np.zeros(len(text) + 1, np.int32)
    np.add.at(step, begin, 1)
    np.add.at(step, end, -1)
    gone = np.cumsum(step[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, doc, copy, text``: ``doc, copy`` name a row and sort as the
    rows do.  Where ids repeat or are missing the table is written to fix it."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    n = slim.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc")
    if n["n"] == n["d"]:
        return slim.select("doc_id", doc, F.lit(0).cast("long").alias("copy"), "text")
    return materialize(slim.select("doc_id", doc, F.monotonically_increasing_id().alias("copy"), "text"))


def lost_stretches(docs: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, str]:
    """``doc, copy, start, n`` of ``doc, copy, text``: ``n`` windows from
    byte ``start`` on that also start earlier; and the scratch folder that
    they are read from."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for doc, copy, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    for key, h, start, n in runs_of((text or "").encode("utf-8", "surrogatepass"), span, gram):
                        yield key, h, np.full(len(key), doc), np.full(len(key), copy), start, n
        return _gathered(rows())

    path = scratch_path(spark, "repeats")
    settle(docs.select("doc", "copy", "text").mapInArrow(run, _RUN)).write.parquet(path)
    found = spark.read.parquet(path)
    many = found.where(F.col("ordinal") == hot).select("key", F.lit(True).alias("hot"))  # one row of each such seed
    contested = found.where("ordinal >= 0").join(many, "key", "left").withColumn("hot", F.col("hot").isNotNull())
    rows = contested_rows(docs.select("doc", "copy", "text"), contested, span)
    return (found.where("ordinal < 0").select("doc", "copy", "start", "n").union(order_contested(rows, span))), path


def _cut_rows(docs: DataFrame, lost: DataFrame, schema: str, fn) -> DataFrame:
    """``fn(text, stretches)`` as columns of every row (``doc_id`` first)."""
    lists = lost.groupBy("doc", "copy").agg(F.collect_list(F.struct("start", "n")).alias("stretches"))  # of one text each
    ids = docs.select("doc", "copy", "doc_id")
    plain = dict(ids.dtypes)["doc_id"] in ("bigint", "int")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard
        unpack = zstandard.ZstdDecompressor().decompress
        rows = [fn(unpack(z), s) for z, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        cols = [pa.array(c) for c in zip(*rows, strict=True)] if rows else []
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["doc", "copy", *names])

    joined = _zip(docs.select("doc", "copy", "text")).join(lists, ["doc", "copy"], "left")
    out = map_arrow(joined, f"doc long, copy long, {schema}", run)
    if plain:
        return out.select(F.when(F.col("doc") != _LAST, F.col("doc")).cast(dict(ids.dtypes)["doc_id"]).alias("doc_id"), *names)
    return out.join(ids, ["doc", "copy"]).select("doc_id", *names)


def repeat_report(docs: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    placed = _placed(docs, id_col, text_col)
    lost, path = lost_stretches(placed, span, gram, hot)

    def row(text: bytes, stretches):
        left, n, runs = cut(text, stretches, span)
        return len(text), n, runs, hashlib.sha256(left).hexdigest()

    return kept(_cut_rows(placed, lost, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", row), path)


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id, kept`` of every row: the bytes left of its text (binary, as a
    cut may fall inside a character)."""
    placed = _placed(docs, id_col, text_col)
    lost, path = lost_stretches(placed, span, gram, hot)
    return kept(_cut_rows(placed, lost, "kept binary", lambda text, s: (cut(text, s, span)[0],)), path)
