"""Hidden Markov language model over words.

Tokens: words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, then
one end token.  All training documents are counted; ``words`` (word, count) is
a distributed table.

Every training word is a symbol of its own, so is the end token.  A state gives
a word either its own share or that of its ending (``ENDINGS`` classes by the
last three bytes) divided by the class's words:

    P(word | state) = (1 - mix) * own + mix * ending / (V + 1)

with ``V`` words in the class, the extra one for words not seen, and ``mix`` the
share of add-one counts in all counts; one state would give ``(c + 1) / (N + V
+ 1)``, but for the endings.  This sums to one over all words, and the scaled
forward recursion gives P(text) exactly.

Training: Baum-Welch over all training documents.  Expected counts of the at
most ``LISTED`` most frequent words, of starts, transitions and endings are
tables of that bound, added up by Spark and sent to the tasks.  All other words
are dealt to buckets by hash, and a block of documents knows its words' places
in each: every round it sends a bucket its sums and gets back the totals of its
words, while the blocks' tokens stay where they are.  The rounds run in single
precision (sums over documents and scores in double).  They go on until the
summed log-likelihood gains less than a share of ``GAIN``.  The start is a
few rounds over a bounded sample, in which at most ``OWN`` words have a symbol.
Documents over ``HOLD`` tokens go through in pieces, with the forward and the
backward state carried over their borders.

Defined results: null text is the empty text (the end token alone); null ids
are training rows; repeated rows are scored each and count each; without any
training document every ending is equally likely; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import copy
import gc
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc32_mod, drop_path, materialize, scratch_path, texts_of

STATES = 8
#: Rounds over all training documents go on until one gains less than this
#: share of the summed log-likelihood.
GAIN = 0.002
START_ROUNDS = 12   # over the sample, which only seeds
START_DOCS = 600
START_TOKENS = 5000  # of a document in the sample; longer ones are in it with their beginning
OWN = 8192          # words with a symbol in the sample; in the training every word has one
ENDINGS = 1024
LISTED = 1 << 18
#: Tokens of a block, which a task holds at a time; longer documents go in pieces.
HOLD = 500_000
#: Tokens of a piece; pieces of a longer document go side by side, their states chained.
CUT = 1024
#: Blocks of a task, which sends its sums of listed words once for all of them.
TASK_BLOCKS = 64
#: Tokens of words that are not listed, by which their buckets are numbered.
BUCKET = 1 << 18
#: Listed words of a row of sums.
RANGE = 1 << 14
#: Words that a task counts before it passes the counts on.
COUNTED = 400_000
_BITS = 10  # leading binary digits of a count that its bar of the histogram keeps
_SMOOTH = 0.05


def tokens_of(text: str) -> list[bytes]:
    """Words of a text as bytes (only A-Z and ASCII white space matter)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, c`` over all of ``docs``."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passed(counter):
            return pa.RecordBatch.from_arrays([pa.array(counter.keys(), pa.binary()),
                                               pa.array(counter.values(), pa.int64())], names=["word", "n"])

        counter: Counter = Counter()
        for b in batches:
            for t in texts_of(b.column(0)):
                counter.update(tokens_of(t))
            if len(counter) > COUNTED:
                yield passed(counter)
                counter = Counter()
        if counter:
            yield passed(counter)

    return (docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word")
            .agg(F.sum("n").alias("c")))


class Alphabet:
    """The listed words and the classes: made on the driver, of bounded size."""

    def __init__(self, listed: list[bytes], counts: np.ndarray, own: int, class_words: np.ndarray,
                 rare_counts: np.ndarray, total: int, distinct: int, documents: int):
        self.listed, self.counts, self.own = listed, counts, own
        self.total, self.distinct, self.documents = total, distinct, documents
        self.end = len(listed)
        self.unseen = self.end + 1  # and the class: words that are not in the training
        self.size = self.unseen + ENDINGS
        self.rare_counts = rare_counts
        self.class_norm = class_words + 1.0
        classes = np.array([ending(w) for w in listed], dtype=np.int64) if listed else np.zeros(0, np.int64)
        # by symbol: class (the end token is one of its own), share of it, count
        self.classes = np.concatenate([classes, [ENDINGS], np.arange(ENDINGS)])
        self.share = np.concatenate([1.0 / self.class_norm[classes], [1.0], 1.0 / self.class_norm])
        self.symbol_counts = np.concatenate([counts, [documents], np.zeros(ENDINGS, np.int64)])
        self.mix = (distinct + 1.0) / (total + distinct + 1.0)
        self._table = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def table(self) -> dict[bytes, int]:
        if self._table is None:
            self._table = {w: i for i, w in enumerate(self.listed)}
        return self._table

    def without_words(self) -> Alphabet:
        """The same without the words themselves, for the passes after ``encode``."""
        out = copy.copy(self)
        out.listed = []
        return out


def ending(word: bytes) -> int:
    """Class of a word."""
    return zlib.crc32(word[-3:]) % ENDINGS


def make_alphabet(words: DataFrame, documents: int) -> tuple[Alphabet, int]:
    # a bar is the smallest of its counts: exact below 2 ** _BITS, then in steps of a fixed share, without a top
    step = F.expr(f"shiftleft(1L, greatest(length(bin(c)) - {_BITS}, 0))")
    bars = {r["k"]: r["n"] for r in words.groupBy((F.col("c") - F.pmod("c", step)).alias("k")).agg(F.count("*").alias("n")).collect()}

    def at_least(limit: int) -> int:
        """Smallest count such that at most ``limit`` words have it or more."""
        seen, bound = 0, max(bars, default=0) * 2 + 1
        for k in sorted(bars, reverse=True):
            seen += bars[k]
            if seen > limit:
                break
            bound = k
        return bound

    own_from, listed_from = at_least(OWN), at_least(LISTED)
    listed = words.where(F.col("c") >= listed_from).toArrow()  # LISTED rows at most
    rare = F.when(F.col("c") < listed_from, F.col("c"))
    got = (words.groupBy((F.crc32(F.expr("substring(word, -3, 3)")) % F.lit(ENDINGS)).alias("k"))
           .agg(F.sum("c").alias("c"), F.count("*").alias("v"), F.sum(rare).alias("r")).collect())
    class_counts, class_words, rare_counts = np.zeros(ENDINGS), np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in got:
        class_counts[r["k"]], class_words[r["k"]], rare_counts[r["k"]] = r["c"], r["v"], r["r"] or 0
    counts = listed.column("c").to_numpy().astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    names = listed.column("word").to_pylist()
    return Alphabet([names[i] for i in order], counts[order], int((counts >= own_from).sum()), class_words, rare_counts,
                    int(class_counts.sum()) + documents, int(class_words.sum()) + (1 if documents else 0),
                    documents), listed_from


class Look(dict):
    """Symbols of words; words that are not listed get the next ones from ``size`` on."""

    def __init__(self, table: dict[bytes, int], size: int):
        super().__init__(table)
        self.size, self.words = size, []

    def __missing__(self, word: bytes) -> int:
        i = self[word] = self.size + len(self.words)
        self.words.append(word)
        return i


def packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values, dtype=np.int32).tobytes(), "zstd", asbytes=True)


def unpacked(blob: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, 4 * size, "zstd", asbytes=True), np.int32)


def encode(docs: DataFrame, alphabet, held, buckets: int, path: str, id_col: str, text_col: str) -> DataFrame:
    """Write and reread the blocks that all later passes read, a row each:
    ``block, held_out``, the documents' ``ids`` and ``sizes``, their ``symbols`` (packed)
    and the ``words`` that are not listed with their ``classes`` and numbers ``n``.
    Such words have the symbols from ``size`` on, in the order of their buckets.
    A block has ``HOLD`` tokens, or one document more, and is of training
    documents or of others."""
    id_type = dict(docs.dtypes)[id_col]
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: Alphabet = alphabet.value
        table = a.table()
        first = TaskContext.get().partitionId() << 33
        blocks = 0
        opened: dict = {}  # by held_out: words, ids, symbols, tokens

        def closed(h, look, ids, symbols, ids_type):
            nonlocal blocks
            bucket = np.array([zlib.crc32(w) % buckets for w in look.words], dtype=np.int64)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(a.size + len(order), dtype=np.int32)
            place[:a.size] = np.arange(a.size)
            place[a.size + order] = a.size + np.arange(len(order))
            flat = place[np.concatenate(symbols)]
            words = [look.words[i] for i in order]
            classes = np.array([ending(w) for w in words], dtype=np.int16)
            blocks += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([first + blocks], pa.int64()), pa.array([h], pa.bool_()), pa.array([ids], pa.list_(ids_type)),
                 pa.array([[len(x) for x in symbols]], pa.list_(pa.int64())), pa.array([packed(flat)], pa.binary()),
                 pa.array([words], pa.list_(pa.binary())), pa.array([classes.tobytes()], pa.binary()),
                 pa.array([np.bincount(flat, minlength=len(place))[a.size:]], pa.list_(pa.int64()))],
                names=["block", "held_out", "ids", "sizes", "symbols", "words", "classes", "n"])

        ids_type = None
        for b in batches:
            ids_type = b.column(0).type
            for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), strict=True):
                if h not in opened:
                    opened[h] = [Look(table, a.size), [], [], 0]
                now = opened[h]
                words = tokens_of(t)
                sym = np.full(len(words) + 1, a.end, dtype=np.int32)
                sym[:-1] = np.fromiter(map(now[0].__getitem__, words), np.int32, len(words))
                now[1].append(i)
                now[2].append(sym)
                now[3] += len(sym)
                if now[3] >= HOLD:
                    yield closed(h, *opened.pop(h)[:3], ids_type)
        for h, now in opened.items():
            yield closed(h, *now[:3], ids_type)

    out = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), text_col).mapInArrow(
        run, f"block long, held_out boolean, ids array<{id_type}>, sizes array<long>, symbols binary, words array<binary>, "
             "classes binary, n array<long>")
    out.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


@contextmanager
def settings(spark, **values: str):
    """Session settings for the plans made and run inside."""
    values = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def one_block_a_batch(spark):
    """Blocks are rows of some MB: one at a time goes to a task."""
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="1")


def tasks_of(blocks: int, cores: int) -> int:
    """Tasks over the blocks: two a core, more if a task had over ``TASK_BLOCKS``.
    A task's sums of listed words have one size however many blocks are in them, so
    their traffic does not grow with the blocks before that."""
    return max(1, min(blocks, max(2 * cores, -(-blocks // TASK_BLOCKS))))


def placed(tokens: DataFrame, buckets: int) -> DataFrame:
    """The blocks of ``tokens`` with ``parts`` instead of words: by bucket, the
    words' places in the bucket's list and their counts in the training.  A
    checkpoint that stays hash partitioned by block: later joins on the block
    move the other side alone."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                bucket = np.array([zlib.crc32(w) % buckets for w in r["words"]], dtype=np.int64)
                cuts = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
                full = [(k, x, y) for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
                if full:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k for k, _, _ in full], pa.int32()), pa.array([r["block"]] * len(full), pa.int64()),
                         pa.array([r["held_out"]] * len(full), pa.bool_()),
                         pa.array([r["words"][x:y] for _, x, y in full], pa.list_(pa.binary())),
                         pa.array([r["n"][x:y] for _, x, y in full], pa.list_(pa.int64()))],
                        names=["bucket", "block", "held_out", "words", "n"])

    def listed(t: pa.Table) -> pa.Table:
        places: dict[bytes, int] = {}
        at = [np.array([places.setdefault(w, len(places)) for w in words], dtype=np.int32)
              for words in t.column("words").to_pylist()]
        c = np.zeros(len(places), dtype=np.int64)
        for i, n, h in zip(at, t.column("n").to_pylist(), t.column("held_out").to_pylist(), strict=True):
            if not h:
                c[i] += n
        return pa.table([t.column("bucket"), t.column("block"), pa.array([i.tobytes() for i in at], pa.binary()),
                         pa.array([c[i].tobytes() for i in at], pa.binary())], names=["bucket", "block", "place", "c"])

    spark = tokens.sparkSession
    with one_block_a_batch(spark), settings(spark, spark__sql__adaptive__enabled="false"):
        parts = (tokens.select("block", "held_out", "words", "n")
                 .mapInArrow(split, "bucket int, block long, held_out boolean, words array<binary>, n array<long>")
                 .groupBy("bucket").applyInArrow(listed, "bucket int, block long, place binary, c binary")
                 .groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "place", "c"))).alias("parts")))
        return materialize(tokens.drop("words", "n").join(parts.hint("merge"), "block", "left"))


class Steps:
    """Sequences side by side: all first tokens, all second tokens, ..."""

    def __init__(self, sequences: list[np.ndarray]):
        self.order = np.argsort([-len(s) for s in sequences], kind="stable")
        sizes = np.array([len(sequences[i]) for i in self.order])
        self.steps = int(sizes[0])
        # sequences that reach step t: their number falls with t
        self.active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(self.steps), side="right")
        self.begin = np.concatenate([[0], np.cumsum(self.active)])
        which = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        at = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # step, then place
        at = self.begin[at]
        at += which
        self.which = np.empty_like(which)
        self.which[at] = which
        del which
        self.symbols = np.empty(len(at), dtype=np.int32)
        self.symbols[at] = np.concatenate([sequences[i] for i in self.order])


def forward(s: Steps, start: np.ndarray, move: np.ndarray, emit: np.ndarray, keep: bool):
    """Scaled forward recursion: the scale of every token, and (``keep``) the
    forward rows and emissions (tokens x states, each state's values together).
    ``start``: the states ahead, or a column of them for each sequence in order.
    ``emit``: symbols x states; all is kept in its precision."""
    total, states, kind = len(s.symbols), len(start), emit.dtype
    scale = np.empty(total, kind)
    e = np.empty((states, total), kind)
    for k in range(states):
        np.take(np.ascontiguousarray(emit[:, k]), s.symbols, out=e[k])
    rows = np.empty_like(e) if keep else None
    turned, begin = np.ascontiguousarray(move.T, dtype=kind), s.begin.tolist()
    a = None
    for x, y in zip(begin, begin[1:], strict=False):
        now = rows[:, x:y] if keep else e[:, x:y]
        ahead = np.asarray(start, kind).reshape(states, -1) if a is None else turned @ a[:, :y - x]
        np.multiply(ahead, e[:, x:y], out=now)
        np.add.reduce(now, axis=0, out=scale[x:y])
        now /= scale[x:y]
        a = now
    return scale, rows.T if keep else None, e.T


def cut_up(sequences: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Pieces of at most ``CUT`` tokens, and the number of each in its sequence."""
    pieces = [q[k:k + CUT] for q in sequences for k in range(0, max(1, len(q)), CUT)]
    many = np.array([max(1, -(-len(q) // CUT)) for q in sequences])
    number = np.arange(len(pieces)) - np.repeat(np.cumsum(many) - many, many)
    return pieces, number


def carried(pieces: list[np.ndarray], number: np.ndarray, start, move, emit) -> tuple[np.ndarray, np.ndarray]:
    """By piece the states ahead of its first token, and what its sequence's later
    pieces make of the states after its last one (any scale; ones if none follow).
    Every piece of a longer sequence becomes a matrix, from all states ahead of it to
    those after it; they are chained in order, all sequences side by side."""
    n, states = len(pieces), len(start)
    ahead, behind = np.repeat(np.asarray(start, float)[:, None], n, 1), np.ones((states, n))
    follows = np.append(number[1:] > 0, False)  # another piece of the sequence does
    long = np.flatnonzero(follows | (number > 0))
    if not len(long):
        return ahead, behind
    s = Steps([pieces[i] for i in long])
    turned, begin = np.ascontiguousarray(move.T, dtype=emit.dtype), s.begin.tolist()
    ends, a = np.empty((states, len(long), states)), None
    for x, y in zip(begin, begin[1:], strict=False):
        m = y - x
        if a is None:
            now = np.repeat(np.eye(states, dtype=emit.dtype)[:, None], m, 1)
        else:
            if m < a.shape[1]:
                ends[:, m:a.shape[1]] = a[:, m:]
            now = (turned @ a[:, :m].reshape(states, -1)).reshape(states, m, states)
        now *= emit[s.symbols[x:y]].T[:, :, None]
        now /= now.max(axis=0).max(axis=1)[:, None]
        a = now
    ends[:, :a.shape[1]] = a
    matrix = np.empty((n, states, states))  # of a piece: after, ahead
    matrix[long[s.order]] = ends.transpose(1, 0, 2)
    for k in range(1, int(number.max()) + 1):
        at = np.flatnonzero(number == k)
        after = np.einsum("pij,jp->ip", matrix[at - 1], ahead[:, at - 1])
        ahead[:, at] = move.T @ (after / after.sum(axis=0))
    for k in range(int(number.max()), 0, -1):
        at = np.flatnonzero(number == k)
        rest = move @ np.einsum("pij,ip->jp", matrix[at], behind[:, at])
        behind[:, at - 1] = rest / rest.sum(axis=0)
    return ahead, behind


def expected(sequences: list[np.ndarray], start, move, emit):
    """Baum-Welch sums of a batch: starts, transitions, emissions (symbols x
    states), log-likelihood.  Pieces of long sequences go side by side."""
    pieces, number = cut_up(sequences)
    ahead, behind = carried(pieces, number, start, move, emit)
    s = Steps(pieces)
    scale, rows, e = forward(s, ahead[:, s.order], move, emit, True)
    gamma, back = rows.T, e.T  # both are overwritten: state probabilities, emission * backward / scale
    back /= scale
    place = np.empty_like(s.order)
    place[s.order] = np.arange(len(place))
    last = s.begin[[len(q) - 1 for q in pieces]] + place
    ended = gamma[:, last].astype(float)  # forward states after each piece
    behind /= (ended * behind).sum(axis=0)
    gamma[:, last] *= behind
    back[:, last] *= behind
    forth, begin = move.astype(emit.dtype), s.begin.tolist()
    moves, after = np.zeros(move.shape), None
    for x, y in zip(reversed(begin[:-1]), reversed(begin[1:]), strict=True):
        if after is not None:
            n = after.shape[1]
            moves += gamma[:, x:x + n] @ after.T
            b = forth @ after
            gamma[:, x:x + n] *= b
            back[:, x:x + n] *= b
        after = back[:, x:y]
    later = np.flatnonzero(number > 0)
    moves += ended[:, later - 1] @ back[:, place[later]].astype(float).T
    starts = gamma[:, place[number == 0]].astype(float)
    emits = np.stack([np.bincount(s.symbols, weights=g, minlength=emit.shape[0]) for g in gamma], 1)
    return (starts / starts.sum(axis=0)).sum(axis=1), moves * move, emits, float(np.log(scale).sum(dtype=float))


def _border(piece: np.ndarray, state: np.ndarray, move, emit, after):
    """Of one piece: starts, transitions, emissions, log-likelihood, its last
    forward row and its first emission * backward / scale.  ``after``: that of
    the next piece."""
    s = Steps([piece])
    scale, rows, e = forward(s, state, move, emit, True)
    back = np.empty_like(e)
    turned = np.ascontiguousarray(move.T)
    b = np.ones(len(state)) if after is None else after @ turned
    gamma = np.empty_like(e)
    for t in range(len(piece) - 1, -1, -1):
        gamma[t] = rows[t] * b
        back[t] = e[t] * b / scale[t]
        b = back[t] @ turned
    moves = (rows[:-1].T @ back[1:]) * move
    emits = np.stack([np.bincount(s.symbols, weights=gamma[:, k], minlength=emit.shape[0]) for k in range(len(state))], 1)
    return gamma[0], moves, emits, float(np.log(scale).sum()), rows[-1], back[0]


def in_pieces(sequence: np.ndarray, start, move, emit) -> tuple[list[np.ndarray], list[np.ndarray], float]:
    """Pieces of a long sequence, the forward state before each and the
    log-likelihood: nothing longer than a piece is held with its rows."""
    pieces, states, like = [sequence[k:k + HOLD] for k in range(0, len(sequence), HOLD)], [start], 0.0
    for piece in pieces:
        scale, rows, _ = forward(Steps([piece]), states[-1], move, emit, True)
        like += float(np.log(scale).sum())
        states.append(rows[-1] @ move)
    return pieces, states[:-1], like


def expected_long(sequence: np.ndarray, start, move, emit):
    """``expected`` of one sequence of any length, piece by piece."""
    pieces, states, like = in_pieces(sequence, start, move, emit)
    moves, emits, after, starts = np.zeros_like(move), np.zeros(emit.shape), None, None
    for piece, state in zip(reversed(pieces), reversed(states), strict=True):
        starts, m, x, _, last, first = _border(piece, state, move, emit, after)
        moves += m
        emits += x
        if after is not None:
            moves += np.outer(last, after) * move
        after = first
    return starts, moves, emits, like


def expected_of(sequences: list[np.ndarray], start, move, emit):
    """``expected`` with sequences over ``HOLD`` tokens piece by piece."""
    short = [s for s in sequences if len(s) <= HOLD]
    parts = [expected(short, start, move, emit)] if short else []
    parts += [expected_long(s, start, move, emit) for s in sequences if len(s) > HOLD]
    return tuple(sum(p[1:], p[0]) for p in zip(*parts, strict=True))


def improved(starts, moves, emits):
    """The model that fits the sums, smoothed so that nothing is impossible."""
    start = (starts + _SMOOTH) / (starts + _SMOOTH).sum()
    move = (moves + _SMOOTH) / (moves + _SMOOTH).sum(axis=1, keepdims=True)
    emit = emits + _SMOOTH
    return start, move, emit / emit.sum(axis=0, keepdims=True)


def first_model(sample: list[np.ndarray], size: int):
    """A few rounds over the sample, from frequencies tilted per state."""
    rng = np.random.default_rng(7)
    base = np.ones(size)
    for s in sample:
        base += np.bincount(s, minlength=size)
    emit = base[:, None] * np.exp(rng.normal(0, 0.5, (size, STATES)))
    emit /= emit.sum(axis=0, keepdims=True)
    move = np.full((STATES, STATES), 0.1 / max(1, STATES - 1))
    np.fill_diagonal(move, 0.9)
    model = np.full(STATES, 1 / STATES), move / move.sum(axis=1, keepdims=True), emit
    if sample:
        for _ in range(START_ROUNDS):
            model = improved(*expected(sample, *model)[:3])
    return model


class Model:
    """Sums of a round turned into probabilities (tables of bounded size; the
    words that are not listed have theirs from the joined rows)."""

    def __init__(self, start, move, own: np.ndarray, own_total: np.ndarray, back: np.ndarray, alphabet: Alphabet):
        self.start, self.move, self.mix = start, move, alphabet.mix
        self.rate = (1 - alphabet.mix) / np.maximum(own_total, 1e-300)  # of an expected count, by state
        self.own = own * self.rate
        self.back = alphabet.mix * back / back.sum(axis=0)

    def listed(self, alphabet: Alphabet):
        """Own part and whole of the emissions of the listed words and the unseen:
        the same in all blocks."""
        own = np.concatenate([self.own, np.zeros((ENDINGS, STATES))])
        return own, own + self.back[alphabet.classes] * alphabet.share[:, None]

    def others(self, alphabet: Alphabet, classes: np.ndarray, counts: np.ndarray):
        """The same of words that are not listed, of ``classes`` with expected ``counts``."""
        own = counts * self.rate
        return own, own + self.back[classes] / alphabet.class_norm[classes][:, None]

    def emissions(self, alphabet: Alphabet, others, counts: np.ndarray):
        """Own part and whole of every symbol's emission, with its class: the
        listed, the unseen and then words of the classes ``others``."""
        others = np.asarray(others, dtype=np.int64)
        parts = zip(self.listed(alphabet), self.others(alphabet, others, counts), strict=True)
        return *(np.concatenate(p) for p in parts), np.concatenate([alphabet.classes, others])


_HEAD = -1                  # bucket of the first rows of the summed table; the listed words follow below
_LIKE = 1 + STATES          # rows of the summed table before the symbols: starts, transitions, then
_RARE = _LIKE + 1           # log-likelihood, own counts of words that are not listed
_CLASS = _RARE + 1          # and a row per class
_FIRST = _CLASS + ENDINGS + 1


def seeded(sample: list[np.ndarray], a: Alphabet) -> tuple[Model, np.ndarray]:
    """The model of the sample spread over all words, and the states of a class."""
    low = np.concatenate([np.arange(a.own), a.own + 1 + a.classes[a.own:a.end], [a.own],
                          a.own + 1 + np.arange(ENDINGS)])  # symbols of the sample by symbol
    size = a.own + 1 + ENDINGS
    start, move, emit = first_model(sample, size)
    seen = np.zeros((size, STATES)) if not sample else expected(sample, start, move, emit)[2]
    weight = emit * (seen.sum(axis=0) + 1)
    states = weight / weight.sum(axis=1, keepdims=True)  # of a symbol
    of_class = states[a.own + 1:]
    own = a.symbol_counts[:a.end + 1, None] * states[low[:a.end + 1]]
    rare = a.rare_counts[:, None] * of_class
    back = np.zeros((ENDINGS + 1, STATES))
    np.add.at(back, a.classes[:a.end + 1], own)
    back[:ENDINGS] += rare
    return Model(start, move, own, own.sum(axis=0) + rare.sum(axis=0), back + _SMOOTH, a), of_class


def sample_of(learn: DataFrame, alphabet, documents: int, text_col: str) -> list[np.ndarray]:
    """At most ``START_DOCS`` documents in the symbols of the sample."""
    # about twice as many rows by hash, then the first of them: few rows move, however many there are
    share = min(1.0, 2 * START_DOCS / max(1, documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: Alphabet = alphabet.value
        table = a.table()
        for b in batches:
            symbols = []
            for t in texts_of(b.column(1)):
                known = [(w, table.get(w, a.end)) for w in tokens_of(t)]
                symbols.append([*(i if i < a.own else a.own + 1 + ending(w) for w, i in known), a.own][:START_TOKENS])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(symbols, pa.list_(pa.int32()))], names=["at", "symbols"])

    some = (learn.select(F.monotonically_increasing_id().alias("at"), text_col)
            .where(F.pmod(F.xxhash64("at"), F.lit(1 << 40)) < F.lit(math.ceil(share * (1 << 40))))
            .mapInArrow(run, "at long, symbols array<int>")
            .orderBy(F.xxhash64("at")).limit(START_DOCS).select("symbols").toArrow())
    return [np.asarray(s, dtype=np.int64) for s in some.column(0).to_pylist()]


def blocks_of(batches: Iterator[pa.RecordBatch], of_class: np.ndarray):
    """Of each block: its row, the symbols of its documents, and of its words
    that are not listed the classes, counts and expected counts (by state)."""
    for b in batches:
        for r in b.to_pylist():
            sizes = np.array(r["sizes"])
            flat = unpacked(r["symbols"], int(sizes.sum()))
            classes = np.frombuffer(r["classes"], np.int16)
            c = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(p["c"], np.int64) for p in r["parts"] or [])])
            if r["got"]:
                counts = np.concatenate([np.frombuffer(p["sums"], np.float32) for p in r["got"]]).reshape(-1, STATES)
            else:  # the first round
                counts = c[:, None] * of_class[classes]
            yield r, np.split(flat, np.cumsum(sizes)[:-1]), classes, c, counts


def log_scores(sequences: list[np.ndarray], start, move, emit) -> np.ndarray:
    """log10 P of each sequence."""
    out = np.zeros(len(sequences))
    short = np.array([i for i, x in enumerate(sequences) if len(x) <= HOLD], dtype=np.int64)
    if len(short):
        s = Steps([sequences[i] for i in short])
        scale, _, _ = forward(s, start, move, emit, False)
        out[short[s.order]] = np.bincount(s.which, weights=np.log10(scale), minlength=len(short))
    for i, x in enumerate(sequences):
        if len(x) > HOLD:
            out[i] = in_pieces(x, start, move, emit)[2] / math.log(10)
    return out


def with_emissions(blocks: DataFrame, emissions: DataFrame | None) -> DataFrame:
    """The blocks with the expected counts of their words that are not listed."""
    if emissions is None:
        return blocks.withColumn("got", F.lit(None).cast("array<struct<bucket:int,sums:binary>>"))
    got = emissions.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "sums"))).alias("got"))
    return blocks.join(got, "block", "left")


def _added(t: pa.Table) -> pa.Table:
    """Sums of a bucket, for each block those of its words (for the tables of
    listed words: once)."""
    bucket, block = t.column("bucket"), t.column("block")
    place, sums = t.column("place").to_pylist(), t.column("sums").to_pylist()
    if bucket[0].as_py() < 0:
        kind = np.float64 if bucket[0].as_py() == _HEAD else np.float32
        total = sum(np.frombuffer(x, kind).astype(float) for x in sums)
        return pa.table([bucket[:1], block[:1], pa.array([total.tobytes()], pa.binary())], names=["bucket", "block", "sums"])
    at = [np.frombuffer(p, np.int32) for p in place]
    total = np.zeros((1 + max(int(i.max()) for i in at), STATES))
    for i, x in zip(at, sums, strict=True):
        if x is not None:  # a word is in a block's list once
            total[i] += np.frombuffer(x, np.float32).reshape(-1, STATES)
    return pa.table([bucket, block, pa.array([total[i].astype(np.float32).tobytes() for i in at], pa.binary())],
                    names=["bucket", "block", "sums"])


def one_round(blocks: DataFrame, emissions: DataFrame | None, model: Model, alphabet: Alphabet, of_class: np.ndarray, path: str):
    """A Baum-Welch round: the summed table (its rows in the order of
    ``_LIKE``, ``_RARE``, ...) and the next ``emissions``, written to ``path``.
    Blocks of other documents take no part but get the emissions of their words."""
    spark = blocks.sparkSession
    now = spark.sparkContext.broadcast((model, alphabet, of_class))  # LISTED x STATES numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, a, states = now.value
        head, seen, any_block = np.zeros((_FIRST, STATES)), np.zeros((a.size, STATES)), False
        listed = m.listed(a)[1].astype(np.float32)

        def add_classes(head, classes, rest):
            for k in range(STATES):
                head[_CLASS:_FIRST, k] += np.bincount(classes, weights=rest[:, k], minlength=ENDINGS + 1)

        def rows(bucket, block, place, sums):
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(block, pa.int64()),
                                               pa.array(place, pa.binary()), pa.array(sums, pa.binary())],
                                              names=["bucket", "block", "place", "sums"])

        for r, held, classes, _, counts in blocks_of(batches, states):
            parts, rare = r["parts"] or [], None
            if not r["held_out"]:
                any_block = True
                own, emit = m.others(a, classes, counts)
                starts, moves, emits, like = expected_of(held, m.start, m.move, np.concatenate([listed, emit.astype(np.float32)]))
                seen += emits[:a.size]
                mine = own / emit * emits[a.size:]
                head[0] += starts
                head[1:1 + STATES] += moves
                head[_LIKE, 0] += like
                add_classes(head, classes, emits[a.size:] - mine)
                head[_RARE] += mine.sum(axis=0)
                rare = mine.astype(np.float32)
            at = 0
            for p in parts:
                n = len(p["place"]) // 4
                yield rows([p["bucket"]], [r["block"]], [p["place"]], [None if rare is None else rare[at:at + n].tobytes()])
                at += n
        if any_block:
            own, emit = m.listed(a)
            mine = own / emit * seen
            add_classes(head, a.classes, seen - mine)
            yield rows([_HEAD], [None], [None], [head.tobytes()])
            for k in range(0, a.end + 1, RANGE):
                yield rows([_HEAD - 1 - k // RANGE], [None], [None], [mine[k:min(k + RANGE, a.end + 1)].astype(np.float32).tobytes()])

    with one_block_a_batch(spark):
        (with_emissions(blocks, emissions)
         .mapInArrow(run, "bucket int, block long, place binary, sums binary")
         .groupBy("bucket").applyInArrow(_added, "bucket int, block long, sums binary")
         .write.option("compression", "zstd").parquet(path))
    now.destroy()
    got = spark.read.parquet(path)
    summed = {r["bucket"]: np.frombuffer(r["sums"]).reshape(-1, STATES) for r in got.where("bucket < 0").collect()}
    nothing = np.zeros((_FIRST + alphabet.end + 1, STATES))
    table = np.concatenate([summed[k] for k in sorted(summed, reverse=True)]) if summed else nothing
    return table, got.where("bucket >= 0").select("block", "bucket", "sums")


def let_go(spark) -> None:
    """Shuffle files of ended rounds are deleted once the driver's objects of
    them are collected; do not wait for it."""
    gc.collect()
    spark._jvm.System.gc()


def train(blocks: DataFrame, alphabet: Alphabet, sample: list[np.ndarray]):
    """Baum-Welch over all training documents of ``blocks``.  The model, the
    expected counts of the words that are not listed by block, the states of a
    class and the folder of those counts."""
    spark, documents = blocks.sparkSession, alphabet.documents
    model, of_class = seeded(sample, alphabet)
    said, before, emissions = None, -math.inf, None
    while documents:
        path = scratch_path(spark, "hmm-emissions")
        rows, emissions = one_round(blocks, emissions, model, alphabet, of_class, path)
        if said:
            drop_path(spark, said)
        let_go(spark)
        said = path
        start, move, _ = improved(rows[0], rows[1:_LIKE], np.ones((1, STATES)))
        own = rows[_FIRST:]
        model = Model(start, move, own, own.sum(axis=0) + rows[_RARE], rows[_CLASS:_FIRST] + _SMOOTH, alphabet)
        like = rows[_LIKE, 0]
        if like - before < GAIN * abs(like):  # of the model that the round began with
            break
        before = like
    return model, emissions, of_class, said


def score_documents(docs: DataFrame, fold: int | None = 2, folds: int = 7, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score`` of every row; rows with crc32(id) mod ``folds`` = ``fold`` are not
    learned from (``fold`` None: all are)."""
    spark = docs.sparkSession
    held = F.coalesce(crc32_mod(id_col, folds) == F.lit(fold), F.lit(False)) if fold is not None else F.lit(False)
    learn = docs.where(~held)
    documents = learn.count()
    counted, path = scratch_path(spark, "hmm-words"), scratch_path(spark, "hmm-tokens")
    word_counts(learn, text_col).write.parquet(counted)
    alphabet, _ = make_alphabet(spark.read.parquet(counted), documents)
    drop_path(spark, counted)
    shared = spark.sparkContext.broadcast(alphabet)  # LISTED words at most
    buckets = 1 + int(alphabet.rare_counts.sum()) // BUCKET
    tokens = encode(docs, shared, held, buckets, path, id_col, text_col)
    tasks = str(tasks_of(tokens.count(), spark.sparkContext.defaultParallelism))
    with settings(spark, spark__sql__shuffle__partitions=tasks):  # in all passes, so that the blocks stay in place
        return _scored(docs, learn, tokens, buckets, documents, shared, path, id_col, text_col)


def _scored(docs: DataFrame, learn: DataFrame, tokens: DataFrame, buckets: int, documents: int, shared, path: str,
            id_col: str, text_col: str) -> DataFrame:
    """``score_documents`` from the encoded blocks on."""
    spark, alphabet = docs.sparkSession, shared.value
    blocks = placed(tokens, buckets)
    drop_path(spark, path)
    let_go(spark)
    sample = sample_of(learn, shared, documents, text_col)
    shared.destroy()  # the words themselves are not needed any more
    slim = alphabet.without_words()
    model, emissions, of_class, said = train(blocks, slim, sample)
    final = spark.sparkContext.broadcast((model, slim, of_class))
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, a, states = final.value
        every = math.log10(a.total + a.distinct + 1)
        listed, known, logged = m.listed(a)[1], a.symbol_counts > 0, np.log10(a.symbol_counts + 1.0) - every

        for b in batches:
            ids_type = b.schema.field("ids").type.value_type
            for r, held, classes, c, counts in blocks_of([b], states):
                emit = np.concatenate([listed, m.others(a, classes, counts)[1]])
                some = np.concatenate([known, c > 0])
                logs = np.concatenate([logged, np.log10(c + 1.0) - every])
                n = len(held)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["ids"], ids_type), pa.array([r["held_out"]] * n, pa.bool_()),
                     pa.array([len(x) for x in held], pa.int64()), pa.array([int(some[x].sum()) for x in held], pa.int64()),
                     pa.array([a.total] * n, pa.int64()), pa.array([float(logs[x].sum()) for x in held], pa.float64()),
                     pa.array(log_scores(held, m.start, m.move, emit), pa.float64())],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    with one_block_a_batch(spark):
        out = materialize(with_emissions(blocks, emissions).mapInArrow(
            run, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                 "base_score double, score double"))
    if said:
        drop_path(spark, said)
    return out
