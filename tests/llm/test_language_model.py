"""The language model end to end against plain Baum-Welch, a text at a time in
one process; the quality classifier against ridge over the whole table."""

import math
import zlib

import numpy as np
import pytest

from gridcast.llm import hmm, kernel_quality
from gridcast.llm.common import table

SF = "/root/testdata/sf0.01"


def texts(n=40):
    rng = np.random.default_rng(5)
    kinds = [[f"{k}{i}" for i in range(25)] for k in ("sun", "rain", "fog")]
    out = []
    for i in range(n):
        own = kinds[i % 3]
        out.append((i, " ".join(own[int(x)] for x in rng.zipf(1.6, int(rng.integers(3, 60))) % 25)))
    return [*out, (100, None), (101, "Sun1 new words ONLY here"), (102, "sun1 " * 300)]


class Plain:
    """The model with dictionaries of words and loops over tokens."""

    def __init__(self, model, alphabet, listed, of_class, count):
        self.a, self.rate = alphabet, model.rate
        self.start, self.move, self.back = model.start, model.move, model.back
        self.own = {w: model.own[i] for i, w in enumerate([*listed, None])}
        for w, c in count.items():
            if w not in self.own:
                self.own[w] = c * of_class[hmm.ending(w)] * self.rate

    def kind(self, w):
        return hmm.ENDINGS if w is None else hmm.ending(w)

    def emission(self, w):
        own = self.own.get(w, np.zeros(hmm.STATES))
        return own + self.back[self.kind(w)] / (1.0 if w is None else self.a.class_norm[self.kind(w)]), own

    def alpha(self, words):
        rows, like, a = [], 0.0, None
        for w in words:
            a = (self.start if a is None else a @ self.move) * self.emission(w)[0]
            like += math.log(a.sum())
            a = a / a.sum()
            rows.append(a)
        return rows, like

    def again(self, corpus):
        starts, moves, own, back, like = np.zeros(8), np.zeros((8, 8)), {}, np.zeros((hmm.ENDINGS + 1, 8)), 0.0
        for words in corpus:
            rows, got = self.alpha(words)
            like += got
            beta = np.ones(8)
            for t in range(len(words) - 1, -1, -1):
                gamma = rows[t] * beta / (rows[t] @ beta)
                e, mine = self.emission(words[t])
                own[words[t]] = own.get(words[t], 0) + gamma * mine / e
                back[self.kind(words[t])] += gamma * (1 - mine / e)
                if t:
                    x = np.outer(rows[t - 1], e * beta) * self.move
                    moves += x / x.sum()
                    beta = self.move @ (e * beta)
                    beta = beta / beta.sum()
                else:
                    starts += gamma
        self.start, self.move, _ = hmm.improved(starts, moves, np.ones((1, 8)))
        self.rate = (1 - self.a.mix) / sum(own.values())
        self.own = {w: x * self.rate for w, x in own.items()}
        back += hmm._SMOOTH
        self.back = self.a.mix * back / back.sum(axis=0)
        return like


@pytest.mark.parametrize("listed,hold,bucket", [(1 << 18, 2_000_000, 1 << 18), (4, 150, 16)])
def test_scores_are_those_of_plain_baum_welch(spark, monkeypatch, listed, hold, bucket):
    monkeypatch.setattr(hmm, "LISTED", listed)
    monkeypatch.setattr(hmm, "OWN", min(listed, 6))
    monkeypatch.setattr(hmm, "HOLD", hold)     # the second: many blocks, one text in pieces,
    monkeypatch.setattr(hmm, "BUCKET", bucket)  # and words in many buckets
    kept, make, rounds = [], hmm.make_alphabet, hmm.one_round
    monkeypatch.setattr(hmm, "make_alphabet", lambda *x: kept.append(make(*x)[0]) or (kept[0], 0))
    first = []
    monkeypatch.setattr(hmm, "one_round", lambda *x: first.append((x[2], x[4])) or rounds(*x))
    rows = texts()
    got = {r["doc_id"]: r for r in hmm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")
                                                         .repartition(3)).collect()}
    words = {i: [*hmm.tokens_of(t or ""), None] for i, t in rows}
    learn = [w for i, w in words.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    count = {}
    for w in learn:
        for x in w[:-1]:
            count[x] = count.get(x, 0) + 1
    plain = Plain(first[0][0], kept[0], kept[0].listed, first[0][1], count)
    likes = [plain.again(learn) for _ in first]
    assert len(got) == len(rows) and len(first) > 2
    assert all(b - a >= hmm.GAIN * abs(b) for a, b in zip(likes[:-1], likes[1:-1]))
    for i, w in words.items():
        assert got[i]["score"] == pytest.approx(plain.alpha(w)[1] / math.log(10), rel=2e-4), i


@pytest.mark.parametrize("cut", [1, 5, 8, 16])
def test_pieces_side_by_side_give_the_sums_of_whole_sequences(monkeypatch, cut):
    r, n = np.random.default_rng(1), 300
    start, move, emit = r.dirichlet(np.ones(8)), r.dirichlet(np.ones(8) * 0.3, 8), r.dirichlet(np.ones(n) * 0.2, 8).T + 1e-9
    some = [r.integers(0, n, k).astype(np.int32) for k in (1, 5, 7, 8, 9, 16, 17, 100, 40, 63, 64, 65, 3)]
    monkeypatch.setattr(hmm, "CUT", 1 << 30)
    want, steps = hmm.expected(some, start, move, emit), []
    monkeypatch.setattr(hmm, "CUT", cut)
    plain = hmm.forward
    monkeypatch.setattr(hmm, "forward", lambda s, *x: steps.append(s.steps) or plain(s, *x))
    got = hmm.expected(some, start, move, emit)
    assert steps == [cut]  # 100 before: one a token of the longest
    assert all(np.allclose(x, y, rtol=1e-9, atol=1e-11) for x, y in zip(got, want, strict=True))


def test_sums_of_listed_words_are_sent_by_few_tasks(spark, monkeypatch):
    assert [hmm.tasks_of(n, 6) for n in (0, 5, 300, 16_000)] == [1, 5, 12, 250]
    monkeypatch.setattr(hmm, "tasks_of", lambda blocks, cores: min(blocks, 3))
    monkeypatch.setattr(hmm, "HOLD", 50)
    seen, plain = [], hmm.placed
    monkeypatch.setattr(hmm, "placed", lambda *x: seen.append(plain(*x)) or seen[-1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    hmm.score_documents(spark.createDataFrame(texts(), "doc_id long, text string")).count()
    assert seen[0].count() > 3 and seen[0].rdd.getNumPartitions() == 3  # as many as shuffles have, before
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_blocks_do_not_move_in_a_round(spark, monkeypatch):
    """The tokens are read where the checkpoint put them: no exchange of the
    blocks' side of the join."""
    seen = []
    plain = hmm.with_emissions
    monkeypatch.setattr(hmm, "with_emissions", lambda b, e: seen.append(plain(b, e)) or seen[-1])
    hmm.score_documents(spark.createDataFrame(texts(), "doc_id long, text string")).count()
    for df in seen[1:]:
        assert "symbols" in df.columns
        plan = df._jdf.queryExecution().executedPlan().toString()
        blocks = plan[plan.index("symbols"):]
        assert plan.count("Exchange hashpartitioning") == 1 and "Exchange" not in plan[:plan.index("Scan ExistingRDD")], plan
        assert "collect_list" in blocks


def test_quality_weights_are_those_of_ridge_over_the_whole_table(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    quality = {r["doc_id"]: float(r["quality"]) for r in labels.collect() if r["quality"] is not None}
    stats = kernel_quality.document_statistics(docs)
    learn = ~(kernel_quality.crc32_mod("doc_id", 3) == 1)
    model = kernel_quality.fit(stats, kernel_quality.training_rows(stats, labels, learn))
    rows = docs.select("doc_id", "text").collect()
    x = np.array([kernel_quality.statistics(r["text"] or "") for r in rows])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.deviation, x.std(axis=0))
    fitted = np.array([r["doc_id"] in quality and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 for r in rows])
    y = np.array([quality.get(r["doc_id"], 0.0) for r in rows])[fitted]
    z = np.clip((x - x.mean(axis=0)) / np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1), -6, 6)
    f = np.hstack([np.cos(z @ model.project + model.phase) * math.sqrt(2 / kernel_quality.FEATURES), np.ones((len(x), 1))])
    # ridge as least squares with extra rows, not by normal equations
    n = fitted.sum()
    extra = np.sqrt(np.append(np.full(kernel_quality.FEATURES, kernel_quality.RIDGE * n), 1e-9 * n))
    weights = np.linalg.lstsq(np.vstack([f[fitted], np.diag(extra)]), np.append(y, np.zeros(len(extra))), rcond=None)[0]
    assert np.allclose(f @ weights, f @ model.weights, atol=1e-6)
    scores = {r["doc_id"]: r for r in kernel_quality.quality_scores(docs, labels).collect()}
    bins = model.bins(f @ weights)[fitted]
    levels = {}  # isotonic frequencies by the min-max formula
    at = np.unique(bins)
    c, s = np.array([(bins == b).sum() for b in at]), np.array([y[bins == b].sum() for b in at])
    cc, cs = np.append(0, np.cumsum(c)), np.append(0, np.cumsum(s))
    for k, b in enumerate(at):
        levels[b] = max(min((cs[j + 1] - cs[i]) / (cc[j + 1] - cc[i]) for j in range(k, len(at))) for i in range(k + 1))
    for r, b in zip(rows, model.bins(f @ weights), strict=True):
        if b in levels:
            assert scores[r["doc_id"]]["score"] == pytest.approx(levels[b], abs=1e-9)
