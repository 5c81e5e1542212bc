"""Repeat removal, hard negatives and whitening against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcast.llm import hard_negatives, repeats, whitening
from gridcast.llm.common import table
from gridcast.llm.queries import QUERIES

from .edge import docs, texts

SF = "/root/testdata/sf0.001"


# -- repeats -----------------------------------------------------------------

def plain_repeats(rows, span):
    """Rows in the order that decides what is earlier -> what is left."""
    seen, out = set(), []
    for _, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - span + 1):
            w = data[p:p + span]
            if w in seen:
                gone[p:p + span] = b"\1" * span
            seen.add(w)
        spans = sum(1 for i in range(len(data)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def report(df):
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def plain_report(rows, span=repeats.SPAN):
    return sorted((i, n, gone, spans, hashlib.sha256(left).hexdigest())
                  for (i, _), (n, gone, spans, left) in zip(ordered(rows), plain_repeats(ordered(rows), span), strict=True))


def test_windows_equal_iff_seeds_and_segments_meet():
    data = np.random.default_rng(0).integers(97, 100, 5000).astype(np.uint8)
    h = repeats.gram_hashes(data, 8)
    by = {}
    for i, v in enumerate(h.tolist()):
        by.setdefault(v, set()).add(data[i:i + 8].tobytes())
    assert len(h) == 4993 and all(len(x) == 1 for x in by.values())
    start, n, seed = repeats.seed_runs(data, 20, 8)
    assert start[0] == 0 and (start[1:] == start[:-1] + n[:-1]).all() and n.sum() == 5000 - 19
    for s, m, v in zip(start.tolist(), n.tolist(), seed.tolist(), strict=True):
        places = [max(i for i in range(p, p + 13) if h[i] == h[p:p + 13].min()) for p in range(s, s + m)]
        assert len(set(places)) == 1 and int(h[places[0]]) == v


def test_longest_previous_factors():
    rnd = random.Random(4)
    for _ in range(30):
        parts = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(12, 60))) for _ in range(3)]
        data = np.frombuffer("".join(parts).encode(), np.uint8)
        span = 10
        starts, group = [], []
        at = 0
        for k, p in enumerate(parts):
            starts += range(at, at + len(p) - span + 1)
            group += [k // 2] * (len(p) - span + 1)
            at += len(p)
        got = repeats.longest_previous(data, np.array(starts), np.array(group), span)
        raw = data.tobytes()
        for k, (s, g) in enumerate(zip(starts, group, strict=True)):
            best = 0
            for s2, g2 in zip(starts[:k], group[:k], strict=True):
                if g2 == g:
                    m = 0
                    while m < span and raw[s + m] == raw[s2 + m]:
                        m += 1
                    best = max(best, m)
            assert got[k] == best


@pytest.mark.parametrize("hot", [1, 2, repeats.HOT])
def test_repeats_small_spans_against_brute_force(spark, hot):
    rnd = random.Random(hot)
    rows = [(i, "".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 120)))) for i in range(40)]
    rows += [(50 + i, rows[i][1][:40] + "é" * i + rows[i + 1][1]) for i in range(10)]
    rows += [(70, "x" * 300), (71, "x" * 200 + "y"), (72, None), (73, ""), (74, "ab" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert report(repeats.repeat_report(df, 16, 8, hot)) == plain_report(rows, 16)


def test_repeats_edge_table(spark):
    rows = [r for r in texts() if r[0] is not None and r[0] != 9]
    assert report(repeats.repeat_report(docs(spark, rows))) == plain_report(rows)
    left = {r["doc_id"]: bytes(r["kept"]) for r in repeats.remove_repeats(docs(spark, rows)).collect()}
    assert left == {i: x[3] for (i, _), x in zip(ordered(rows), plain_repeats(ordered(rows), repeats.SPAN), strict=True)}
    assert repeats.repeat_report(docs(spark, rows).limit(0)).collect() == []


def test_repeats_rows_without_and_with_shared_ids(spark):
    long = " ".join(str(k) for k in range(80))
    rows = [(None, long), (3, "a" + long), (3, long), (3, long), (1, long[:150]), (None, long + "tail"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(tuple(r) for r in repeats.repeat_report(df).fillna(-1, ["doc_id"]).collect())
    want = sorted((-1 if i is None else i, n, g, s, hashlib.sha256(x).hexdigest()) for (i, _), (n, g, s, x) in
                  zip(ordered(rows), plain_repeats(ordered(rows), repeats.SPAN), strict=True))
    assert got == want


def test_repeats_in_pieces_and_small_buffers(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 64)
    text = ("The same words come again and again, " * 9).encode()
    whole = np.concatenate([x[2] + 0 for x in repeats.runs_of(text)])
    n = np.concatenate([x[3] for x in repeats.runs_of(text)])
    assert n.sum() == len(text) - 99 and (whole[1:] == whole[:-1] + n[:-1]).all()


def test_repeats_given_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert report(QUERIES["op13_repeat_removal"](spark, SF)) == plain_report(rows)


# -- hard negatives ------------------------------------------------------------

def plain_negatives(rows):
    """Contract, row by row, for rows ``(vec_id, label, vector)``."""
    good = []
    for k, (i, label, v) in enumerate(rows):
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        good.append((k, i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in v]))
    dim = max((len(v) for *_, v in good), default=0)
    good = [(k, i, lab, v + [0] * (dim - len(v))) for k, i, lab, v in good]
    out = []
    for k, i, label, v in good:
        if i % 50:
            continue
        score = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, m, lab) for m, j, lab, w in good if m != k]
        for ps, pid, *_ in sorted(x for x in score if x[3] == label)[:5]:
            fit = sorted(x for x in score if x[3] != label and 50 * -ps <= 100 * -x[0] <= 95 * -ps)[:3]
            out += [(i, pid, r, x[1], -ps, -x[0]) for r, x in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(i, lab, v, 1, 2, 3) for i, lab, v in rows],
                               "vec_id long, label int, embedding array<double>, row int, block int, rank int").repartition(3)
    lab = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hard_negatives.mine(
        hard_negatives.integer_vectors(df, lab, F.col("vec_id") % 50 == 0)).collect())


def vectors(seed, n, dim=12, labels=3):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(labels, dim))
    lab = r.integers(0, labels, n)
    x = centre[lab] * 0.6 + r.normal(size=(n, dim)) * 0.5
    return [(int(i * 5), int(a), [float(c) for c in v]) for i, (a, v) in enumerate(zip(lab, x, strict=True))]


@pytest.mark.parametrize("block", [7, 4096])
def test_hard_negatives_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rows = vectors(block, 120)
    want = plain_negatives(rows)
    assert want and mined(spark, rows) == want


def test_hard_negatives_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(3, 60, 4) + [(None, 1, [1.0] * 4), (1000, None, [1.0] * 4), (1050, 1, None), (1100, 1, []),
                                (1150, 1, [nan, 1.0, 1.0, 1.0]), (1200, 2, [1.0, None, 1.0, 1.0]), (1250, 2, [inf, 0.0, 0.0, 0.0]),
                                (1300, 7, [0.5, 0.5, 0.5, 0.5]), (50, 1, [0.3, -0.4, 0.2, 0.1]), (50, 1, [0.3, -0.4, 0.2, 0.1]),
                                (3, 2, [0.3, -0.4, 0.2, 0.1]), (4, 2, [0.3, -0.4, 0.2, 0.1]), (100, 1, [0.0] * 4), (101, 1, [0.5, 0.25])]
    assert mined(spark, rows) == plain_negatives(rows)
    assert mined(spark, [(None, None, None)]) == [] and mined(spark, [(50, 1, [1.0])]) == []


def test_scan_prunes_but_keeps_whole_results():
    r = np.random.default_rng(1)
    x = r.integers(-200, 200, (3000, 32))
    block = hard_negatives.Columns(np.arange(3000), np.arange(3000), np.zeros(3000, int), x)
    anchor = x[17] * np.array([8] * 4 + [1] * 28)
    seen = []

    def shrink(low, high):
        seen.append(len(low))
        assert (low <= high).all()
        return high >= hard_negatives.kth_best(low, 5)

    alive, score = block.scan(anchor, np.arange(3000), shrink)
    exact = x @ anchor
    assert (score == exact[alive]).all() and set(np.argsort(-exact)[:5]) <= set(alive) and seen[-1] < 600


def test_hard_negatives_given_table(spark):
    rows = [(r["vec_id"], r["label"], list(r["embedding"])) for r in table(spark, SF, "embeddings").collect()]
    got = sorted(tuple(r) for r in QUERIES["op11_hard_negatives"](spark, SF).collect())
    assert got == plain_negatives(rows) and got


# -- whitening -----------------------------------------------------------------

def plain_whitening(rows, keep=32):
    good = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) and abs(x) < 1e13 for x in v)]
    dim = max(len(v) for _, v in good)
    x = [[int(np.floor(64 * float(c))) + 1000000 for c in v + [0.0] * (dim - len(v))] for _, v in good]
    n, s = len(x), [sum(col) for col in zip(*x, strict=True)]
    dev = [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    z = np.array([[(n * a - b) / n for a, b in zip(r, s, strict=True)] for r in x])
    cov = z.T @ z / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:keep], u[:, ::-1][:, :keep]
    return [i for i, _ in good], n, dev, z @ u / np.sqrt(np.maximum(e, 1e-300)), e / np.trace(cov), e


def check_whitening(df, rows):
    ids, n, dev, w, explained, e = plain_whitening(rows)
    got = {}
    for r in df.collect():
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(got) == set(ids)
    errors = set()
    sign = {}
    for k, i in enumerate(ids):
        assert sorted(got[i]) == list(range(1, len(e) + 1))
        for c, r in got[i].items():
            assert r["n"] == n and r["deviation"] == (dev[k] if dev[k] < 1 << 63 else None)
            assert abs(r["explained"] - explained[c - 1]) <= 1e-9
            errors.add(r["identity_error"])
            if e[c - 1] <= e[0] * 1e-12:
                assert r["whitened"] is None
                continue
            if c not in sign and abs(w[k, c - 1]) > 1e-6:
                sign[c] = 1 if r["whitened"] * w[k, c - 1] > 0 else -1
            assert abs(r["whitened"] - sign.get(c, 1) * w[k, c - 1]) < 1e-7
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_whitening_against_brute_force(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(r.normal(size=(300, 6)) @ r.normal(size=(6, 6)) * 3)]
    rows += [(500, None), (501, []), (502, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (503, [float("nan")] * 6), (504, [float("inf")] * 6),
             (505, [1e300] * 6), (506, [0.25, -0.5]), (507, [20.0, 1.0, 0.0, -30.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, n int, component int")
    check_whitening(whitening.whiten(df.repartition(4)), rows)


def test_whitening_pair_sums_are_exact():
    y = np.random.default_rng(2).integers(-(1 << 50), 1 << 50, (500, 3))
    got = whitening.pair_sums(y)
    rows = [[int(v) for v in r] for r in y]
    want = [sum(r[i] for r in rows) for i in range(3)]
    for i in range(3):
        want += [sum((r[i] + (r[j] if j != i else 0)) ** 2 for r in rows) for j in range(i, 3)]
    assert got == want


def test_whitening_deviations_beyond_a_long_are_null():
    y = np.array([[1, 2], [1 << 31, 5], [1 << 40, 0], [3, (1 << 31) - 9]])
    sums = np.array([int(v) for v in y.sum(axis=0)], object)
    want = [sum((4 * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in y]
    got = whitening._deviations(y, 4, sums)
    assert got == [v if v < 1 << 63 else None for v in want] and None in got
    small = whitening._deviations(y // 1024, 4, sums // 1024)
    assert None not in small[:2]


def test_whitening_flat_and_empty(spark):
    kind = "vec_id long, embedding array<float>"
    rows = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [1.0, 2.0])], kind)).collect()
    assert len(rows) == 6 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None
                                  and r["deviation"] == 0 and r["n"] == 3 for r in rows)
    line = whitening.whiten(spark.createDataFrame([(k, [k * 1.0, k * 2.0]) for k in range(9)], kind)).collect()
    assert {r["component"] for r in line if r["whitened"] is None} == {2} and line[0]["identity_error"] < 1e-12
    assert whitening.whiten(spark.createDataFrame([(1, None)], kind)).collect() == []


def test_whitening_given_table(spark):
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in table(spark, SF, "embeddings").collect()]
    check_whitening(QUERIES["op12_embedding_whitening"](spark, SF), rows)
