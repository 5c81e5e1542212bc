"""SimHash near-duplicates with pigeonring filtering.

Fingerprint: words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased,
shingles of ``shingle`` words (repeats count), XXH64 of each, and per bit the
majority of all hashes.  Two fingerprints link at ``max_bits`` or fewer
differing bits.

Pigeonring filter (``max_bits`` = 3 over a ring of 5 segments of 12-13 bits):
if the segments' differences sum to at most 3, some segment starts a chain
whose first ``l`` segments differ in at most ``3 l / 5`` bits together, for
every ``l``.  For ``l`` = 1 the start is equal; for ``l`` = 3 at most one bit
differs, so one of the two following segments is equal too.  Distinct
fingerprints therefore meet under ten keys (start, next or next but one), with
about 26 equal bits each, and a candidate must keep within every chain budget
before its full distance counts.

A key shared by more than ``BLOCK`` fingerprints (a large group of near
copies) is dealt into hash blocks, and each pair of blocks is a task of its
own.  A group of rows yields a spanning forest of its links, never all pairs:
that keeps every component whole.

Defined results: null or empty text has fingerprint zero and links like any
other; equal texts share a fingerprint; rows are judged one by one, also if
ids repeat (the component is then that of their texts); the component is the
smallest id reachable (null only if all its ids are null); an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize
from .components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Fingerprints of one key that are compared in one piece.
BLOCK = 1024

RING = 5
_CUTS = [0, 13, 26, 39, 52, 64]
SEGMENTS = [((1 << (b - a)) - 1) << a for a, b in zip(_CUTS, _CUTS[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text, as a signed integer."""
    import xxhash
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0] + [e + 1 for e in ends]
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    h = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 1 << 15):
        part = np.array([h(joined[a:b], SEED) for a, b in zip(starts[k:k + (1 << 15)], last[k:k + (1 << 15)],
                                                              strict=False)], dtype="<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    value = int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])
    return _signed(value)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, th, fp``: fp the fingerprint's 64 bits as a long, th a hash
    of the text that tells rows of one id apart."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t or "", shingle) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())],
                                          names=["doc_id", "th", "fp"])

    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), text_col),
                     f"doc_id {dict(docs.dtypes)[id_col]}, th long, fp long", run)


def chain_ok(xor: np.ndarray, start: int, max_bits: int = MAX_BITS) -> np.ndarray:
    """Which XORs keep every chain from segment ``start`` within its budget;
    the last chain is the whole ring, the full Hamming distance."""
    alive = np.arange(len(xor))
    total = np.zeros(len(xor), dtype=np.int64)
    for k in range(RING):
        total = total + np.bitwise_count(xor[alive] & np.uint64(SEGMENTS[(start + k) % RING]))
        good = total * RING <= (k + 1) * max_bits
        alive, total = alive[good], total[good]
    return alive


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Indices of links that span the components of links (a, b) over 0..n-1."""
    parent = list(range(n))
    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(i)
    return keep


def group_links(fps: np.ndarray, block: np.ndarray, start: int, cross: bool,
                max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among the fingerprints of one key (cross: only between
    its two blocks)."""
    if cross:
        low = block == block.min()
        left, right = fps[low], fps[~low]
        at = np.concatenate([np.flatnonzero(low), np.flatnonzero(~low)])
        i = np.repeat(np.arange(len(left)), len(right))
        j = np.tile(np.arange(len(left), len(fps)), len(left))
        i, j = at[i], at[j]
    else:
        i, j = np.triu_indices(len(fps), 1)
    ok = chain_ok(fps[i] ^ fps[j], start, max_bits)
    i, j = i[ok], j[ok]
    keep = forest(i, j, len(fps))
    return fps[i[keep]], fps[j[keep]]


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``u, v`` between distinct fingerprints ``fp`` that connect all
    that a chain of links of at most ``max_bits`` connects."""
    if max_bits != MAX_BITS:
        raise ValueError("the ten keys of this ring are derived for 3 bits")
    fp = distinct.select("fp").where("fp is not null")
    rings = []
    for i in range(RING):
        for step in (1, 2):
            mask = _signed(SEGMENTS[i] | SEGMENTS[(i + step) % RING])
            rings.append(F.struct(F.lit(i * 2 + step - 1).alias("ring"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bits")))
    keyed = fp.select("fp", F.explode(F.array(*rings)).alias("k")).select("fp", "k.ring", "k.bits")
    # written, so that the join below is between two plain exchanges and a hot key's rows can be split
    sizes = materialize(keyed.groupBy("ring", "bits").agg(F.count("*").alias("n")).where("n > 1"))
    dealt = (keyed.join(sizes, ["ring", "bits"])
             .withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK)))
             .withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("fp"), F.col("blocks")))
                         .otherwise(F.lit(0)).cast("int"))
             .select("ring", "bits", "fp", "block",
                     F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))
                               .otherwise(F.array(F.lit(0)))).alias("other"))
             .select("ring", "bits", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"),
                     "block", "fp"))
    keys = ["ring", "bits", "b1", "b2"]
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    grouped = dealt.repartition(parts, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def flush(cols, last: bool):
            """Links of all groups that are complete; the rows of the last one."""
            new = np.ones(len(cols[0]), dtype=bool)
            new[1:] = False
            for c in cols[:4]:
                new[1:] |= c[1:] != c[:-1]
            edges = [*np.flatnonzero(new).tolist(), len(cols[0])]
            upto = len(edges) - 1 if last else len(edges) - 2
            us, vs = [], []
            for k in range(upto):
                a, b = edges[k], edges[k + 1]
                if b - a > 1:
                    cross = cols[2][a] != cols[3][a]
                    u, v = group_links(cols[5][a:b], cols[4][a:b], int(cols[0][a]) // 2, bool(cross), max_bits)
                    us.append(u)
                    vs.append(v)
            tail = None if last else [c[edges[-2]:] for c in cols]
            out = None
            if us:
                out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)],
                                                 names=["u", "v"])
            return out, tail

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(6)]
            cols[5] = cols[5].view(np.uint64)
            if rest is not None:
                cols = [np.concatenate([r, c]) for r, c in zip(rest, cols, strict=True)]
            if len(cols[0]):
                out, rest = flush(cols, False)
                if out is not None:
                    yield out
        if rest is not None and len(rest[0]):
            out, _ = flush(rest, True)
            if out is not None:
                yield out

    return grouped.mapInArrow(run, "u long, v long")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id, th, fp, root, component_id`` for every row of ``docs`` (root:
    the component's smallest fingerprint, a name for groups without ids)."""
    fps = materialize(fingerprints(docs, shingle, id_col, text_col))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = components(links(distinct, max_bits))
    grouped = (distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
               .select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    smallest = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    label = materialize(grouped.join(smallest, "root").select("fp", "root", "component_id"))
    return fps.join(label, "fp").select("doc_id", "th", "fp", "root", "component_id")


def hex16(fp):
    """Fingerprint as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id
    (null ids last; among rows of that id one text, once).  The columns are
    those of ``docs``."""
    groups = simhash_groups(docs, shingle, max_bits, id_col, text_col)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("r"))
    key = ["__id", "__none", "__th"]
    nothing = F.lit(0).cast(dict(docs.dtypes)[id_col])
    keep = first.select(F.coalesce("r.doc_id", nothing).alias("__id"), F.col("r.none").alias("__none"),
                        F.col("r.th").alias("__th"))
    keyed = (docs.withColumn("__id", F.coalesce(id_col, nothing)).withColumn("__none", F.col(id_col).isNull())
             .withColumn("__th", F.xxhash64(text_col)))
    return keyed.join(keep, key, "left_semi").dropDuplicates(key).select(*docs.columns)
