"""The text operators against brute force, on awkward rows and a given table."""

import array
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import tokenizers
import xxhash

from gridcast.llm import bpe, hmm, kernel_quality, line_runs, packing, simhash, winnow
from gridcast.llm.common import table
from gridcast.llm.queries import ORACLE, QUERIES, vocabulary

from .edge import docs, texts

SF = "/root/testdata/sf0.001"
BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def given(spark, name="documents"):
    return [(r[0], r[1]) for r in table(spark, SF, name).select("doc_id", "text").collect()]


@pytest.fixture(scope="module", params=["edge", "given"])
def data(request, spark):
    if request.param == "edge":
        return docs(spark), texts()
    return table(spark, SF, "documents"), given(spark)


def nothing(spark):
    return docs(spark, []).limit(0)


def sha(s):
    return hashlib.sha256(s.encode("utf-8")).hexdigest()


# -- packing ---------------------------------------------------------------

def check_packing(rows, want):
    tok = tokenizers.Tokenizer.from_file(BYTE)
    expect = Counter()
    for i, t in want:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        for k, (s, n) in enumerate(packing.pieces_of(len(ids), 1024)):
            expect[i, k, s, n, zlib.crc32(array.array("I", ids[s:s + n]).tobytes())] += 1
            assert n == 1024 or k == 0
    assert Counter(r[:5] for r in rows) == expect
    bins = {}
    for r in rows:
        bins.setdefault(r[5], []).append((r[6], r[3]))
    for places in bins.values():
        at = 0
        for off, n in sorted(places):
            assert off == at
            at += n
        assert at <= 1024
    return len(bins)


def test_packing(data):
    df, want = data
    rows = rows_of(packing.pack(df, BYTE))
    n = check_packing(rows, want)
    total = sum(r[3] for r in rows)
    assert n <= math.ceil(total / 1024) * 1.1 + 2


def test_packing_nothing(spark):
    assert rows_of(packing.pack(nothing(spark), BYTE)) == []


def test_best_two_fit_uses_each_piece_once_and_beats_plain_greedy():
    rng = np.random.default_rng(3)
    counts = {int(n): int(c) for n, c in zip(rng.choice(np.arange(1, 1025), 300, False), rng.integers(1, 500, 300))}
    used = Counter()
    patterns = packing.best_two_fit(dict(counts))
    for lens, times in patterns:
        assert sum(lens) <= 1024
        for n in lens:
            used[n] += times
    assert used == counts
    bins = sum(t for _, t in patterns)
    assert bins <= 1.1 * sum(n * c for n, c in counts.items()) / 1024 + sum(c for n, c in counts.items() if n > 512)
    # one of two pieces that fit the expanded gap more tightly: 600 + 300 -> 600 + 250 + 174
    assert sorted(packing.best_two_fit({600: 1, 300: 1, 250: 1, 174: 1})[0][0]) == [174, 250, 600]


# -- simhash ---------------------------------------------------------------

def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps):
    fps = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.arange(len(fps))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(fps))])
        if (new == label).all():
            return label
        label = new


def test_simhash(data):
    df, want = data
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(df).select(
        "doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id").collect()), key=str)
    fps = [plain_fingerprint(t) for _, t in want]
    label = plain_groups(fps)
    low = {}
    for (i, _), k in zip(want, label):
        low[k] = min([x for x in (low.get(k), i) if x is not None], default=None)
    assert got == sorted(((i, f"{f:016x}", low[k]) for (i, _), f, k in zip(want, fps, label)), key=str)


def test_simhash_keeps_one_row_of_each_group(data):
    df, want = data
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    label = plain_groups([plain_fingerprint(t) for _, t in want])
    groups = {}
    for (i, t), k in zip(want, label):
        groups.setdefault(k, []).append((i is None, i or 0, xxhash64_of(t), i, t))
    expect = sorted([min(g, key=lambda x: x[:2])[3] for g in groups.values()], key=str)
    got = kept.select("doc_id", "text").collect()
    assert sorted([r[0] for r in got], key=str) == expect
    assert {(r[0], r[1]) for r in got} <= set(want)


def xxhash64_of(text):
    return 0


def test_simhash_links_a_chain_and_large_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, dtype=np.uint64)
    fps = {int(base)}
    now = int(base)
    for _ in range(300):  # a chain in which neighbours differ in up to 3 bits
        for b in rng.choice(64, rng.integers(1, 4), False):
            now ^= 1 << int(b)
        fps.add(now)
    fps = np.array(sorted(fps), dtype=np.uint64)
    xor = fps[:, None] ^ fps[None, :]
    i, j = np.nonzero((np.bitwise_count(xor) <= 3) & (np.arange(len(fps))[:, None] < np.arange(len(fps))[None, :]))
    for a, b in zip(i, j):  # pigeonring: a viable start, and an equal next or next but one segment
        x = np.array([fps[a] ^ fps[b]])
        assert any(len(simhash.chain_ok(x, s)) and any(
            not int(x[0]) & (simhash.SEGMENTS[s] | simhash.SEGMENTS[(s + k) % 5]) for k in (1, 2)) for s in range(5))


def test_simhash_hot_key_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = np.random.default_rng(6)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.choice(64, (80, 2))})
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    links = simhash.links(df).collect()
    assert len(links) < 40 * len(fps)
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for u, v in links:
        u, v = u % (1 << 64), v % (1 << 64)
        assert bin(u ^ v).count("1") <= 3
        parent[root(u)] = root(v)
    label = plain_groups(fps)
    assert len({root(f) for f in fps}) == len(set(label.tolist()))


def test_simhash_nothing(spark):
    assert rows_of(simhash.simhash_groups(nothing(spark))) == []
    assert rows_of(simhash.keep_one(nothing(spark))) == []


# -- BPE -------------------------------------------------------------------

def test_bpe_round_trip(data):
    df, want = data
    tok = tokenizers.Tokenizer.from_file(WORD)
    expect = []
    for i, t in want:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        expect.append((i, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert sorted(rows_of(bpe.round_trip(df, WORD)), key=str) == sorted(expect, key=str)


def test_bpe_ids_and_long_words():
    tok, own = tokenizers.Tokenizer.from_file(WORD), bpe.codec(WORD)
    rng = np.random.default_rng(1)
    letters = list("abcdeéthinan'sßΣ0½日́- .!</w>")
    odd = ["".join(rng.choice(letters, rng.integers(1, 40))) for _ in range(1500)] + ["a" * 5000, "abc" * 3000, "ha" * 77]
    for t in odd:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == tok.decode(ids, skip_special_tokens=False)


def test_bpe_nothing(spark):
    assert rows_of(bpe.round_trip(nothing(spark), WORD)) == []
    assert rows_of(bpe.encode_ids(docs(spark, [(1, None), (2, "Hello hello")]), WORD).orderBy("doc_id")) == [
        (1, []), (2, tokenizers.Tokenizer.from_file(WORD).encode("Hello hello", add_special_tokens=False).ids)]


# -- line dedup ------------------------------------------------------------

def plain_lines(want, min_docs=3):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    holders = {}
    for i, t in want:
        if i is not None:
            for x in set((t or "").split("\n")):
                if len(key(x)) >= 20:
                    holders.setdefault(key(x), set()).add(i)
    out = []
    for i, t in want:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or len(key(x)) < 20 or len(holders[key(x)]) < min_docs
                or i == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_line_dedup(data, batches):
    df, want = data
    expect = [(i, n, d, sha(t)) for i, n, d, t in plain_lines(want)]
    assert sorted(rows_of(line_runs.line_report(df, batches=batches)), key=str) == sorted(expect, key=str)


def test_line_dedup_texts(data):
    df, want = data
    out = line_runs.drop_lines(df, count_col="n_chars")
    assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    expect = [(i, t, len(t)) for i, _, _, t in plain_lines(want)]
    assert sorted(rows_of(out.select("doc_id", "text", "n_chars")), key=str) == sorted(expect, key=str)


def test_line_runs_compact(spark):
    store = line_runs.LineRuns(2, fanout=2)
    for k in range(5):
        store.add(spark.createDataFrame([(100 - k, 1, 1), (100 - k, 2, k)], "doc_id long, h1 long, h2 long"))
    assert sum(len(level) for level in store.levels) < 5
    merged = {(r["h1"], r["h2"]): (r["docs"], r["owner"]) for r in store.merged().collect()}
    assert merged[1, 1][0] >= 3 and merged[1, 1][1] == 100
    assert all(merged[2, k] == (1, 100 - k) for k in range(5))


def test_line_dedup_nothing(spark):
    assert rows_of(line_runs.line_report(nothing(spark))) == []
    assert rows_of(line_runs.drop_lines(nothing(spark))) == []


# -- winnowing -------------------------------------------------------------

def plain_winnow(h, w):
    w = min(w, len(h))
    at = []
    for i in range(len(h) - w + 1):
        k = max(range(i, i + w), key=lambda j: (-int(h[j]), j))
        if not at or at[-1] != k:
            at.append(k)
    return at


def test_winnow_matches_windows_and_shifts():
    text = ("the quick brown fox jumps over the lazy dog, aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa éß日本 " * 3)
    h = winnow.rolling_hashes(winnow._code_points(text))
    assert len(h) == len(text) - winnow.K + 1
    assert h[5] == winnow.rolling_hashes(winnow._code_points(text[5:5 + winnow.K]))[0]
    got, at = winnow.winnow(text)
    assert at.tolist() == plain_winnow(h, winnow.W)
    assert (h[at] == got).all()
    shared = "a passage of at least thirty code points that both texts hold"
    a, b = winnow.winnow("xyz" * 9 + shared)[0], winnow.winnow(shared + "qrs" * 11)[0]
    assert len(shared) >= winnow.K + winnow.W - 1 and set(a.tolist()) & set(b.tolist())


@pytest.mark.parametrize("ranges", [1, 4])
def test_edited_fingerprints(data, ranges):
    df, want = data
    got = winnow.edited_fingerprints(df, ranges=ranges).collect()
    assert sorted([r["doc_id"] for r in got], key=str) == sorted([i for i, _ in want], key=str)
    unique = Counter(i for i, _ in want)
    order = sorted({i for i, n in unique.items() if n == 1 and i is not None})
    text = {i: t or "" for i, t in want}
    name = {}
    for r in got:
        i = r["doc_id"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if unique[i] == 1 and i is not None:
            assert name.setdefault(text[i], r["fingerprint"]) == r["fingerprint"]
            assert r["n_chars"] == len(text[i])
    for a, b in zip(order, order[1:]):
        if any(a <= i <= b for i, n in unique.items() if n > 1 and i is not None):
            continue
        r = next(r for r in got if r["doc_id"] == a)
        q = len(text[a]) // 4
        edited = text[a][:len(text[a]) - q] + text[b][:q]
        assert r["edited_sha256"] == sha(edited)
        assert r["edited_fingerprint"] == winnow.digest(*winnow.winnow(edited))
        sets = [np.unique(winnow.winnow(t)[0]) for t in (text[a], edited, text[b])]
        assert r["near_edited"] == winnow.likeness(sets[0], sets[1])
        assert r["near_next"] == winnow.likeness(sets[0], sets[2])


def test_fingerprints_nothing_and_one(spark):
    assert rows_of(winnow.edited_fingerprints(nothing(spark), ranges=3)) == []
    one = winnow.edited_fingerprints(docs(spark, [(5, "abcdefgh")]), ranges=3).collect()
    assert one[0]["edited_sha256"] == sha("abcdef" + "ab") and one[0]["near_next"] == 1.0
    listed = winnow.document_fingerprints(docs(spark, [(5, "abcdefgh"), (6, None)])).orderBy("doc_id").collect()
    assert len(listed[0]["hashes"]) == 1 and listed[0]["positions"] == [0] and listed[1]["hashes"] == []


# -- language model --------------------------------------------------------

def test_hmm_counts_and_scores(data):
    df, want = data
    got = hmm.score_documents(df).collect()
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in want]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in want}
    count = Counter(w for i, ws in tokens if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    expect = sorted([(i, held[i], len(ws), sum(count[w] > 0 for w in ws), n,
                      round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 5)) for i, ws in tokens], key=str)
    assert sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5))
                   for r in got], key=str) == expect
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_hmm_rare_words_go_by_join(spark, monkeypatch):
    monkeypatch.setattr(hmm, "LISTED", 20)
    monkeypatch.setattr(hmm, "OWN", 5)
    df = table(spark, SF, "documents")
    got = {r["doc_id"]: r for r in hmm.score_documents(df).collect()}
    monkeypatch.undo()
    full = {r["doc_id"]: r for r in hmm.score_documents(df).collect()}
    assert all(abs(got[i]["base_score"] - full[i]["base_score"]) < 1e-6 and got[i]["n_known"] == full[i]["n_known"] for i in full)


def test_hmm_words_beyond_the_listed_keep_their_states(spark, monkeypatch):
    """Words of one ending, neither listed nor symbols of the sample: those of
    the one kind of document are likelier beside its common word."""
    monkeypatch.setattr(hmm, "OWN", 2)
    monkeypatch.setattr(hmm, "LISTED", 2)
    rng = np.random.default_rng(1)

    def text(common, kind):
        return " ".join(x for _ in range(15) for x in (common * 2, f"{kind}{rng.integers(30):02d}xyz"))
    ids = [i for i in range(900) if zlib.crc32(str(i).encode()) % 7 != 2][:200]
    own, other = [i for i in range(900) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [(i, text("ab"[n % 2], "ab"[n % 2])) for n, i in enumerate(ids)]
    got = {r["doc_id"]: r["score"] - r["base_score"]
           for r in hmm.score_documents(docs(spark, [*rows, (own, text("a", "a")), (other, text("a", "b"))])).collect()}
    assert got[own] > got[other] + 3


def test_hmm_probabilities_sum_to_one(spark):
    df = docs(spark, [(1, "a b c a"), (2, "b d e"), (4, "a f")])
    a, _ = hmm.make_alphabet(hmm.word_counts(df), 3)
    model, _ = hmm.seeded([], a)
    _, emit, _ = model.emissions(a, [], np.zeros((0, hmm.STATES)))
    assert np.allclose(emit.sum(axis=0), 1)  # the unseen are one word per class


def test_hmm_pieces_are_the_whole_sequence(monkeypatch):
    rng = np.random.default_rng(3)
    model = [x / x.sum(axis=a, keepdims=True) for x, a in (
        (rng.random(3), 0), (rng.random((3, 3)), 1), (rng.random((5, 3)), 0))]
    seqs = [rng.integers(0, 5, n) for n in (17, 4, 8, 9)]
    want, scores = hmm.expected(seqs, *model), hmm.log_scores(seqs, *model)
    monkeypatch.setattr(hmm, "HOLD", 4)
    assert all(np.allclose(a, b) for a, b in zip(hmm.expected_of(seqs, *model), want, strict=True))
    assert np.allclose(hmm.log_scores(seqs, *model), scores)


def test_hmm_trains_on_all_documents_until_no_gain(spark, monkeypatch):
    """Every round reads all training documents, and the likelihood rises up to
    the stop; long documents are in the sample."""
    likes = []
    plain = hmm.one_round
    monkeypatch.setattr(hmm, "START_TOKENS", 3)
    monkeypatch.setattr(hmm, "START_DOCS", 5)
    sample = []
    first = hmm.first_model
    monkeypatch.setattr(hmm, "first_model", lambda s, size: sample.append(s) or first(s, size))

    def watched(*args):
        rows, emissions = plain(*args)
        likes.append(rows[hmm._LIKE, 0])
        assert abs(rows[0].sum() - args[3].documents) < 1e-6
        return rows, emissions
    monkeypatch.setattr(hmm, "one_round", watched)
    hmm.score_documents(docs(spark)).count()
    assert [len(x) for x in sample[0]] and max(map(len, sample[0])) == 3
    gains = [(b - a) / abs(b) for a, b in zip(likes, likes[1:])]
    assert len(likes) > 2 and all(g >= hmm.GAIN for g in gains[:-1]) and -1e-6 < gains[-1] < hmm.GAIN


def test_hmm_bounds_hold_for_words_of_any_count(spark, monkeypatch):
    monkeypatch.setattr(hmm, "OWN", 3)
    monkeypatch.setattr(hmm, "LISTED", 6)
    counts = [5_000_000_000, 3_000_000, 900_000, 400_000, 300_000, 200_000, 150_000, 120_000, 1500, 1499, 7, 1]
    words = spark.createDataFrame([(f"w{i}".encode(), c) for i, c in enumerate(counts)], "word binary, c long")
    a, listed_from = hmm.make_alphabet(words, 4)
    assert a.own == 3 and sorted(a.listed) == [f"w{i}".encode() for i in range(6)]
    assert 150_000 < listed_from <= 200_000
    tied = spark.createDataFrame([(f"w{i}".encode(), 200_000) for i in range(9)], "word binary, c long")
    a, listed_from = hmm.make_alphabet(tied, 4)
    assert a.own == 0 and a.listed == [] and listed_from > 200_000


def test_hmm_forward_is_exact():
    rng = np.random.default_rng(0)
    k, size = 3, 5
    start, move, emit = (x / x.sum(axis=a, keepdims=True) for x, a in (
        (rng.random(k), 0), (rng.random((k, k)), 1), (rng.random((size, k)), 0)))
    seqs = [rng.integers(0, size, n) for n in (4, 1, 6, 4)]
    s = hmm.Steps(seqs)
    scale, rows, _ = hmm.forward(s, start, move, emit, True)
    logs = np.zeros(len(seqs))
    logs[s.order] = np.bincount(s.which, weights=np.log(scale))

    def paths(seq):
        p = start * emit[seq[0]]
        for x in seq[1:]:
            p = np.array([sum(p[a] * move[a, b] for a in range(k)) * emit[x, b] for b in range(k)])
        return math.log(p.sum())
    assert np.allclose(logs, [paths(x) for x in seqs])
    model, before = (start, move, emit), -np.inf
    for _ in range(6):  # Baum-Welch does not lose likelihood (but for its small smoothing)
        a, b, c, like = hmm.expected(seqs * 50, *model)
        assert abs(a.sum() - 200) < 1e-6 and abs(c.sum() - 50 * sum(map(len, seqs))) < 1e-6
        assert like >= before - 1e-3 * abs(like)
        before, model = like, hmm.improved(a, b, c)


def test_hmm_beats_the_base_on_held_out_texts(spark):
    got = [r for r in hmm.score_documents(table(spark, "/root/testdata/sf0.01", "documents")).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > 0.95 * sum(r["base_score"] for r in got)


def test_hmm_nothing(spark):
    assert rows_of(hmm.score_documents(nothing(spark))) == []
    only = hmm.score_documents(docs(spark, [(1, "a b")]), fold=zlib.crc32(b"1") % 7).collect()
    assert only[0]["train_tokens"] == 0 and only[0]["base_score"] == 0.0 and only[0]["n_known"] == 0


# -- quality ---------------------------------------------------------------

def test_quality_scores_every_row(data, spark):
    df, want = data
    labels = table(spark, SF, "labels")
    got = kernel_quality.quality_scores(df, labels).collect()
    assert sorted([r["doc_id"] for r in got], key=str) == sorted([i for i, _ in want], key=str)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_quality_held_out_accuracy_and_blindness(spark):
    sf = "/root/testdata/sf0.01"
    df, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = {r["doc_id"]: r for r in kernel_quality.quality_scores(df, labels).collect()}
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [i for i in y if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == y[i] for i in held]) > 0.95
    # labels of held-out rows change nothing, and neither do other columns
    flipped = labels.withColumn("quality", (1 - labels.quality))
    import pyspark.sql.functions as F
    mixed = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).union(
        flipped.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1))
    again = {r["doc_id"]: r for r in kernel_quality.quality_scores(
        df.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")), mixed).collect()}
    assert all(abs(again[i]["score"] - got[i]["score"]) < 1e-9 for i in got)


def test_quality_without_labels_and_nothing(spark):
    none = table(spark, SF, "labels").limit(0)
    assert {r["score"] for r in kernel_quality.quality_scores(docs(spark), none).collect()} == {0.5}
    odd = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (5, None, 0), (None, 0, 0), (777, 0, 0)],
                                "doc_id long, quality int, toxic int")
    assert {round(r["score"], 6) for r in kernel_quality.quality_scores(docs(spark), odd).collect()} <= {1.0, 0.5}
    assert rows_of(kernel_quality.quality_scores(nothing(spark), table(spark, SF, "labels"))) == []
    kept = kernel_quality.keep_quality(docs(spark), none)
    assert kept.columns == docs(spark).columns and kept.count() == len(texts())


def test_isotonic():
    got = kernel_quality.isotonic(np.arange(5), np.array([1, 1, 2, 1, 1]), np.array([0, 1, 0, 1, 1]))
    assert np.allclose(got, [0, 1 / 3, 1 / 3, 1, 1])


def test_packing_long_white_space():
    tok, enc = tokenizers.Tokenizer.from_file(BYTE), packing.encoder(BYTE)
    for text in (" " * 2_000_000, "a" + " \n" * 500_000 + "b", "x " + "\t" * 99_999 + "y", " " * 100_000):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_bpe_code_points_of_all_planes():
    tok, own = tokenizers.Tokenizer.from_file(WORD), bpe.codec(WORD)
    r = random.Random(6)
    points = [0x1C89, 0xA7DA, 0x10D50, 0x18E00, 0x2FE0, 0x323B0, 0xE0001, 0xE01EF, 0x10FFFF, *range(0xA7C0, 0xA7E0), *range(0x10D40, 0x10D90)]
    points += [r.randrange(0x80, 0x110000) for _ in range(20000)]
    texts = [f"Ab{chr(c)}c {chr(c)}" for c in points if not 0xD800 <= c < 0xE000]
    texts += ["".join(chr(r.choice([r.randrange(32, 0xD800), r.randrange(0xE000, 0x20000)])) for _ in range(40)) for _ in range(500)]
    wrong = [t for t in texts if own.encode(t) != tok.encode(t, add_special_tokens=False).ids]
    assert not wrong, [hex(ord(c)) for c in wrong[0]]


def test_registered_names():
    assert [f"op{n}_" for n in range(1, 14)] == sorted((k[:k.index("_") + 1] for k in QUERIES), key=lambda x: int(x[2:-1]))
    assert set(ORACLE) <= set(QUERIES)
