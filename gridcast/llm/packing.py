"""Best-two-fit packing of tokenized documents into fixed-length sequences.

Each document becomes its token ids plus one end id.  Only a document longer
than ``max_len`` is cut, its first piece taking the remainder, so all its other
pieces fill a sequence alone.

Packing works on the histogram of piece lengths (at most ``max_len`` rows,
whatever the corpus): a bin is filled greedily (the longest piece left, then
always the longest that still fits); then the bin's smallest piece is taken
out again if two unpacked pieces fit the gap so expanded more tightly than it
did.  The finished bin is a *pattern* of lengths, applied as often as the
counts allow.  Pieces get their rank among pieces of their length (per block,
then block offsets: no task sees a whole length) and the rank picks pattern,
sequence and place.  Nothing per document passes through the driver.

Defined results: null text is the empty text (one end id); repeated rows are
packed each on their own (their order among equals is arbitrary); rows with a
null id are packed like any other; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, map_arrow, materialize, texts_of

MAX_LEN = 1024
END_ID = 2
# Fixed value: the pattern that cuts text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters beyond which the two libraries' Unicode tables might differ.
_RARE = re.compile("[^\x00-\u024f]")
#: White space beyond which the pattern's look-ahead runs out of stack.
BLANKS = 100_000
_BLANK = re.compile(rf"\s{{{BLANKS}}}")
_ENCODERS: dict[str, "Encoder"] = {}


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Token ids of whole texts, exactly as ``tokenizers`` gives them.

    The file's vocabulary is read as merge ranks by ``tiktoken``, which runs
    the same merges several times faster; texts that hold an added token, a
    character beyond Latin letters or very long white space go to
    ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import tiktoken
        import tokenizers
        self.tok = tokenizers.Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        byte = _byte_of()
        ranks = {bytes([byte[c] for c in t]): i for t, i in self.tok.get_vocab(with_added_tokens=False).items()}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        long_blank = len(text) >= BLANKS and _BLANK.search(text)
        if long_blank or _RARE.search(text) or any(s in text for s in self.special):
            return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        return self.fast.encode_to_numpy(text).astype("<u4").tobytes()


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces_of(n: int, max_len: int) -> list[tuple[int, int]]:
    """(start, length) of a document of ``n`` ids: the first takes the rest."""
    if n <= max_len:
        return [(0, n)]
    cuts = list(range(n % max_len, n, max_len))
    out = [(0, cuts[0])] if cuts[0] else []
    return out + [(s, max_len) for s in cuts]


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, max_len: int = MAX_LEN,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document."""
    end = array("I", [end_id]).tobytes()
    id_type = dict(docs.dtypes)[id_col]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(tokenizer_path)
        rows, piece, start, length, crc = [], [], [], [], []
        for i, text in enumerate(texts_of(batch.column(1))):
            ids = enc.encode(text) + end
            for k, (s, n) in enumerate(pieces_of(len(ids) // 4, max_len)):
                rows.append(i)
                piece.append(k)
                start.append(s)
                length.append(n)
                crc.append(zlib.crc32(ids[4 * s:4 * (s + n)]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()),
             pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(docs.select(id_col, text_col),
                     f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long", run)


def best_two_fit(counts: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[list[int], int]]:
    """Patterns ``(lengths of a bin, number of such bins)`` that use up the
    histogram ``counts`` (length -> pieces)."""
    left = np.zeros(max_len + 1, dtype=np.int64)
    for n, c in counts.items():
        left[n] = c
    sizes = np.arange(max_len + 1)
    out = []
    while True:
        # under[x]: the longest length up to x of which a piece is left
        under = np.maximum.accumulate(np.where(left > 0, sizes, 0))
        if not under[max_len]:
            return out
        used: dict[int, int] = {}
        lens, gap = [], max_len

        def longest(x: int, used=used, under=under) -> int:
            n = int(under[x])
            while n and left[n] <= used.get(n, 0):
                n = int(under[n - 1])
            return n

        while gap and (n := longest(gap)):
            lens.append(n)
            used[n] = used.get(n, 0) + 1
            gap -= n
        if gap and len(lens) > 1:
            small = lens[-1]
            room = gap + small
            free = left.copy()
            for n, c in used.items():
                free[n] -= c
            below = np.maximum.accumulate(np.where(free > 0, sizes, 0))
            a = sizes[1:room // 2 + 1]
            a = a[free[1:room // 2 + 1] > 0]
            if a.size:
                b = below[room - a]
                alone = (b == a) & (free[a] < 2)
                b = np.where(alone, 0, b)
                total = np.where(b >= a, a + b, 0)
                k = int(total.argmax())
                if total[k] > small:
                    lens[-1:] = sorted((int(a[k]), int(b[k])), reverse=True)
        need: dict[int, int] = {}
        for n in lens:
            need[n] = need.get(n, 0) + 1
        times = max(1, min(int(left[n]) // c for n, c in need.items()))
        for n, c in need.items():
            left[n] -= c * times
        out.append((lens, times))


def slots_of(patterns: list[tuple[list[int], int]]) -> dict[int, list[np.ndarray]]:
    """Per length: rank from which a slot holds, its first sequence, offset.

    The slots' ranks run gapless from 0, so a rank's slot is the last that
    begins at or before it."""
    first, slots, taken = 0, {}, {}
    for lens, times in patterns:
        at = 0
        for n in lens:
            slots.setdefault(n, []).append((taken.get(n, 0), first, at))
            taken[n] = taken.get(n, 0) + times
            at += n
        first += times
    return {n: [np.array(x, dtype=np.int64) for x in zip(*s, strict=True)] for n, s in slots.items()}


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, max_len: int = MAX_LEN,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document; one row per piece: ``doc_id, piece, start, length,
    ids_crc32, sequence_id, offset``."""
    spark = docs.sparkSession
    pieces = materialize(tokenize_pieces(docs, tokenizer_path, end_id, max_len, id_col, text_col))
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    return assign(spark, pieces, counts, max_len)


def assign(spark, pieces: DataFrame, counts: dict[int, int], max_len: int) -> DataFrame:
    """Sequence and offset of each piece, by its rank among equal lengths."""
    slots = spark.sparkContext.broadcast(slots_of(best_two_fit(counts, max_len)))  # bounded by max_len lengths
    blocks = min(1 << 16, max(256, sum(counts.values()) // 2000))
    p = pieces.withColumn("__block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    per = p.groupBy("__block", "length").agg(F.count("*").alias("__n"))
    before = per.select("__block", "length", (F.sum("__n").over(
        Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))).alias("__before"))
    ranked = (p.withColumn("__rn", F.row_number().over(Window.partitionBy("__block", "length")
                                                       .orderBy("doc_id", "piece", "ids_crc32")) - 1)
              .join(before, ["__block", "length"])
              .select("doc_id", "piece", "start", "length", "ids_crc32",
                      (F.col("__rn") + F.coalesce("__before", F.lit(0))).cast("long").alias("rank")))

    def place(batches):
        table = slots.value
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                i = np.flatnonzero(length == n)
                begin, first, at = table[int(n)]
                k = np.searchsorted(begin, rank[i], side="right") - 1
                seq[i] = first[k] + rank[i] - begin[k]
                off[i] = at[k]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in range(5)] + [pa.array(seq), pa.array(off)],
                                             names=[*b.schema.names[:5], "sequence_id", "offset"])

    bounded_batches(spark)
    id_type = dict(pieces.dtypes)["doc_id"]
    return ranked.mapInArrow(place, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, "
                                    "sequence_id long, offset long")
