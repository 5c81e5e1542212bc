"""Quality classifier: kernel ridge on document statistics.

Each text becomes a short row of statistics (lengths, character classes,
repetition).  They are standardised with means and deviations over all
documents; random Fourier features (cosines of random projections) then
approximate a Gaussian kernel over them.  Ridge scores solve the normal
equations, whose sums each partition adds up over its labelled rows and Spark
adds across partitions: a matrix of ``FEATURES`` squared, whatever the corpus.
Isotonic regression (pool adjacent violators over at most ``BINS`` score bins)
turns scores into probabilities.

Only the text is an input of a score.

Defined results: null text is the empty text and is scored like any other;
repeated rows get equal scores; repeated labels of an id count as their mean;
labels that are null or without a document are ignored; without any usable
label every score is 0.5; with one class only, its frequency; null ids pass
through; an empty table gives no rows; other columns pass ``keep_quality``
untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc32_mod, map_arrow, materialize, texts_of

FEATURES = 192
RIDGE = 1e-3       # times the number of labelled rows
WIDTH = 3.0        # of the Gaussian kernel, in standard deviations
BINS = 1000
SEED = 20
_CLIP = 6.0

STATISTICS = ("log_chars", "log_words", "word_length", "word_length_sd", "long_words", "letters", "upper", "digits",
              "spaces", "newlines", "high_bytes", "sentence_marks", "other_marks", "mark_kinds", "entropy",
              "distinct_words", "distinct_pairs", "repeated_lines", "line_length", "words_with_marks", "top_mark",
              "upper_words")

_LOWER, _UPPER = np.arange(97, 123), np.arange(65, 91)
_DIGIT = np.arange(48, 58)
_SENTENCE = np.array([ord(c) for c in ".,;:?'\"-"])
_OTHER = np.array([b for b in range(33, 127) if not chr(b).isalnum() and b not in _SENTENCE])


# Shares of a text are drawn towards these many characters or words of usual
# prose, so that a text of a few words does not look extreme.
_CHARS, _WORDS = 60.0, 10.0


def statistics(text: str) -> list[float]:
    """The statistics of a whole text (all 0 for the empty text)."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=len(words))
    share = count[count > 0] / n
    lines = raw.split(b"\n")
    pairs = set(zip(words, words[1:], strict=False))
    low, up, digit = int(count[_LOWER].sum()), int(count[_UPPER].sum()), int(count[_DIGIT].sum())
    other = count[_OTHER]
    tails = sum(1 for w in words if w[-1] in _TAILS)
    shouted = sum(1 for w in words if w.isupper())
    m = len(words)

    def by_char(x: float, usual: float) -> float:
        return (float(x) + usual * _CHARS) / (n + _CHARS)

    def by_word(x: float, usual: float) -> float:
        return (float(x) + usual * _WORDS) / (m + _WORDS)

    return [math.log1p(n), math.log1p(m), by_word(sizes.sum(), 5.0), math.sqrt(by_word(((sizes - sizes.mean()) ** 2).sum(), 9.0)),
            by_word((sizes > 14).sum(), 0.02), by_char(low + up, 0.78), by_char(up, 0.03), by_char(digit, 0.01),
            by_char(count[32] + count[9], 0.17), by_char(count[10], 0.005), by_char(count[128:].sum(), 0.03),
            by_word(count[_SENTENCE].sum(), 0.15), by_word(other.sum(), 0.02), float((other > 0).sum()),
            by_char(-(share * np.log2(share)).sum() * n, 4.2), by_word(len(set(words)), 0.7), by_word(len(pairs), 0.95),
            1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)), by_word(tails, 0.02), by_word(other.max(), 0.01),
            by_word(shouted, 0.02)]


_TAILS = frozenset(_OTHER.tolist())


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, th, x``: statistics of every row, with the text's hash."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [statistics(t) for t in texts_of(batch.column(2))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))],
                                          names=["doc_id", "th", "x"])

    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), text_col),
                     f"doc_id {dict(docs.dtypes)[id_col]}, th long, x array<double>", run)


class KernelRidge:
    """Random Fourier features, ridge weights and a calibration."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        rng = np.random.default_rng(SEED)
        d = len(mean)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.project = rng.standard_normal((d, FEATURES)) / WIDTH
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.edges, self.levels = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -_CLIP, _CLIP)
        f = np.cos(z @ self.project + self.phase) * math.sqrt(2 / FEATURES)
        return np.hstack([f, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def bins(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.round(raw * BINS / 2) + BINS / 4, 0, BINS).astype(np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.bins(self.raw(x)), self.edges, self.levels)


def isotonic(bins: np.ndarray, n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Non-decreasing frequencies by pooling adjacent violators."""
    pool: list[list[float]] = []
    for k, c, s in zip(range(len(bins)), n.tolist(), ones.tolist(), strict=True):
        pool.append([s, c, k])
        while len(pool) > 1 and pool[-2][0] * pool[-1][1] >= pool[-1][0] * pool[-2][1]:
            s2, c2, _ = pool.pop()
            pool[-1][0] += s2
            pool[-1][1] += c2
    out, at = np.zeros(len(bins)), 0
    for i, (s, c, start) in enumerate(pool):
        end = pool[i + 1][2] if i + 1 < len(pool) else len(bins)
        out[start:end] = s / c
        at = end
    assert at == len(bins)
    return out


def _rows(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def fit(stats: DataFrame, labelled: DataFrame) -> KernelRidge:
    """Fit on ``labelled(x, y)``; standardise over all ``stats(x)``."""
    d = len(STATISTICS)
    spark = stats.sparkSession
    bounded_batches(spark)
    got = stats.agg(*[F.avg(F.col("x")[i]).alias(f"a{i}") for i in range(d)],
                    *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d)]).first()
    model = KernelRidge(np.array([got[f"a{i}"] or 0.0 for i in range(d)]), np.array([got[f"s{i}"] or 0.0 for i in range(d)]))
    size = FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        seen = 0
        for b in batches:
            if b.num_rows:
                f = model.features(_rows(b.column(0), d))
                y = b.column(1).to_numpy(zero_copy_only=False)
                total[:, :size] += f.T @ f
                total[:, size] += f.T @ y
                seen += b.num_rows
        if seen:  # one row per line of the matrix
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()),
                                              pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    lines = (labelled.select("x", "y").mapInArrow(sums, "i int, row array<double>")
             .select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect())
    if not lines:
        return model
    a = np.zeros((size, size + 1))
    for r in lines:
        a[r["i"], r["j"]] = r["v"]
    n = a[size - 1, size - 1]  # the constant feature's square: labelled rows
    ridge = np.eye(size) * RIDGE * n
    ridge[-1, -1] = 1e-9 * n
    model.weights = np.linalg.solve(a[:, :size] + ridge, a[:, size])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.bins(model.raw(_rows(b.column(0), d)))), b.column(1)],
                                                 names=["bin", "y"])

    table = (labelled.select("x", "y").mapInArrow(binned, "bin long, y double").groupBy("bin")
             .agg(F.count("*").alias("n"), F.sum("y").alias("ones")).orderBy("bin").collect())
    edges = np.array([r["bin"] for r in table], dtype=float)
    model.levels = isotonic(edges, np.array([r["n"] for r in table]), np.array([r["ones"] for r in table]))
    model.edges = edges
    return model


def training_rows(stats: DataFrame, labels: DataFrame, learn) -> DataFrame:
    """``x, y`` of the rows that ``learn`` (a condition on doc_id) allows."""
    y = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
         .agg(F.avg(F.col("quality").cast("double")).alias("y")))
    return stats.where(learn).join(y, "doc_id").select("x", "y")


def quality_scores(docs: DataFrame, labels: DataFrame, held: int | None = 1, folds: int = 3, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id, th, held_out, score, predicted`` of every row; labels of rows
    with crc32(id) mod ``folds`` = ``held`` are not learned from (``held``
    None: all are)."""
    stats = materialize(document_statistics(docs, id_col, text_col))
    fold = crc32_mod("doc_id", folds)
    out = F.coalesce(fold == F.lit(held), F.lit(False)) if held is not None else F.lit(False)
    model = docs.sparkSession.sparkContext.broadcast(fit(stats, training_rows(stats, labels, ~out)))  # fixed size
    d = len(STATISTICS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.value.score(_rows(batch.column(3), d)) if batch.num_rows else np.zeros(0)
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                                          names=["doc_id", "th", "held_out", "score", "predicted"])

    return map_arrow(stats.select("doc_id", "th", out.alias("held_out"), "x"),
                     f"doc_id {dict(docs.dtypes)[id_col]}, th long, held_out boolean, score double, predicted int", run)


def keep_quality(docs: DataFrame, labels: DataFrame, held: int | None = 1, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    scores = quality_scores(docs, labels, held, id_col=id_col, text_col=text_col)
    nothing = F.lit(0).cast(dict(docs.dtypes)[id_col])
    key = ["__id", "__none", "__th"]
    bad = (scores.where("predicted = 0").select(F.coalesce("doc_id", nothing).alias("__id"),
                                                F.col("doc_id").isNull().alias("__none"), F.col("th").alias("__th")))
    keyed = (docs.withColumn("__id", F.coalesce(id_col, nothing)).withColumn("__none", F.col(id_col).isNull())
             .withColumn("__th", F.xxhash64(text_col)))
    return keyed.join(bad, key, "left_anti").select(*docs.columns)
