"""Archives, vectors, conversations, components and the pipeline."""

import base64
import gzip
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridcast.llm import components, metric_join, preference, warc
from gridcast.llm.common import table
from gridcast.llm.queries import QUERIES

from .edge import docs
from .test_text_operators import check_packing, plain_fingerprint, plain_groups, plain_lines

SF = "/root/testdata/sf0.001"


# -- archives --------------------------------------------------------------

def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows],
                                 "page_id long, url string, html string, sha1 string, copy int").repartition(2)


PAGES = [(1, "http://a/ b", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é日" * 90000),
         (6, "u", "é日" * 90000), (7, "u", "WARC/1.1\r\n\r\n\r\n\r\nx"), (8, "u", "\r\n"), (9, "same", "row"), (9, "same", "row"),
         (None, "u", "no id")]


def plain_records(rows):
    rows = sorted(((i, (h or "").encode()) for i, _, h in rows), key=lambda r: (r[0] is None, r[0] or 0))
    first, out = {}, []
    for i, p in rows:
        new = p not in first
        first.setdefault(p, i)
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if new else "revisit",
                    None if new else first[p]))
    return out


def test_warc_round_trip(spark):
    got = [tuple(r) for r in warc.archive_report(spark, pages(spark, PAGES)).collect()]
    assert sorted(got, key=str) == sorted(plain_records(PAGES), key=str)


def test_warc_pages_without_ids_and_long_urls(spark):
    rows = [*PAGES, (None, "v", "no id"), (None, None, "row"), (20, "http://h/" + "é" * 1_000_000, "long url"), (-1, "u", "<p>one</p>")]
    got = [tuple(r) for r in warc.archive_report(spark, pages(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(plain_records(rows), key=str) and len(got) == len(rows)


def test_warc_keeps_a_long_url_whole(spark, tmp_path):
    url = "http://h/" + "a" * 2_000_000
    manifest = warc.write_archives(warc.records_of(pages(spark, [(1, url, "x")])), str(tmp_path), archives=1)
    path = manifest.first()["path"].replace("file://", "")
    assert f"WARC-Target-URI: {url}\r\n".encode() in gzip.open(path).read()
    assert warc.read_archives(manifest).first()["bytes_so_far"] == 1


def test_warc_against_sql(spark, tmp_path):
    import duckdb

    from gridcast.llm.queries import ORACLE
    rows = [*PAGES, (None, "v", "no id"), (None, None, "row")]
    df = pages(spark, rows)
    df.write.parquet(str(tmp_path / "p"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/p/*.parquet'")
    want = con.execute(ORACLE["op5_warc"]).fetchall()
    got = [tuple(r) for r in warc.archive_report(spark, df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_warc_smaller_payloads_are_all_responses(spark):
    got = {r["page_id"]: r["record_type"] for r in
           warc.archive_report(spark, pages(spark, PAGES[:6]), min_revisit_bytes=11).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "response", 5: "response", 6: "revisit"}


def test_warc_files_are_archives_and_chunks_rebuild_payloads(spark, tmp_path):
    manifest = warc.write_archives(warc.records_of(pages(spark, PAGES)), str(tmp_path), archives=2, chunk=1000)
    files = [r["path"] for r in manifest.collect()]
    raw = b"".join(gzip.open(f.replace("file://", "")).read() for f in files)
    assert raw.count(b"WARC-Type: ") == 11 and raw.count(b"WARC-Refers-To: <urn:uuid:") == 4
    rows = warc.read_archives(manifest, chunk=700).where("record_type = 'response'").collect()
    parts = {}
    for r in rows:
        assert r["chunk"] is None or len(r["chunk"]) <= 700
        parts.setdefault(r["page_id"], {})[r["chunk_no"]] = r["chunk"]
        if r["last"]:
            assert r["payload_digest"] == r["declared_digest"]
    whole = {i: b"".join(p[k] for k in range(len(p))).decode() for i, p in parts.items()}
    assert whole[5] == "é日" * 90000 and whole[3] == "" and whole[7] == PAGES[6][2]


def test_warc_given_table_and_nothing(spark):
    rows = [tuple(r) for r in table(spark, SF, "pages").select("page_id", "url", "html").collect()]
    got = [tuple(r) for r in QUERIES["op5_warc"](spark, SF).collect()]
    assert sorted(got, key=str) == sorted(plain_records(rows), key=str)
    assert warc.archive_report(spark, pages(spark, PAGES).limit(0)).collect() == []


def test_warc_broken_archive_is_an_error(spark, tmp_path):
    manifest = warc.write_archives(warc.records_of(pages(spark, PAGES[:1])), str(tmp_path), archives=1)
    path = manifest.first()["path"].replace("file://", "")
    whole = open(path, "rb").read()
    open(path, "wb").write(whole[:-12])
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_archives(manifest).collect()


# -- vectors ---------------------------------------------------------------

def plain_vectors(rows, t=0.95):
    dim = max((len(v) for _, v in rows if v), default=1)
    m = np.zeros((len(rows), dim))
    ok = np.zeros(len(rows), bool)
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            m[k, :len(v)] = np.array(v, dtype=float) / np.abs(v).max()
            ok[k] = True
    n = np.where(ok, np.sqrt((m * m).sum(1)), 1)
    near = (m @ m.T / n[:, None] / n[None, :] >= t) & ok[:, None] & ok[None, :]
    np.fill_diagonal(near, False)
    label = np.arange(len(rows))
    while True:
        new = np.array([min([label[k], *label[near[k]]]) for k in range(len(rows))])
        if (new == label).all():
            break
        label = new
    low = {}
    for (i, _), k in zip(rows, label):
        low[k] = min([x for x in (low.get(k), i) if x is not None], default=None)
    return sorted([(i, int(near[k].sum()), low[label[k]], i == low[label[k]]) for k, (i, _) in enumerate(rows)], key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "c") for i, v in rows], "vec_id long, embedding array<double>, label int, rep string")


def clustered(n, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    return [(k, (centres[k % 12] * rng.uniform(0.5, 3) + rng.normal(size=16) * spread).tolist()) for k in range(n)]


@pytest.mark.parametrize("spread", [0.05, 0.25, 1.0])
def test_metric_join(spark, spread, monkeypatch):
    monkeypatch.setattr(metric_join, "BLOCK", 16)
    rows = clustered(400, 1, spread)
    got = [tuple(r) for r in metric_join.near_duplicates(vectors(spark, rows).repartition(3)).collect()]
    assert sorted(got, key=str) == plain_vectors(rows)


def test_metric_join_awkward_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]),
            (8, [float("inf"), 1.0]), (9, [1.0]), (10, [1.0, 0.0]), (10, [1.0, 0.0]), (None, [0.0, 1.0]), (12, [-0.0, 5.0]),
            (13, [0.0, 5.0]), (14, [1e200, 1e200]), (15, [1e-200, 1e-200])]
    got = [tuple(r) for r in metric_join.near_duplicates(vectors(spark, rows)).collect()]
    assert sorted(got, key=str) == plain_vectors(rows)
    assert metric_join.near_duplicates(vectors(spark, rows).limit(0)).collect() == []
    assert len(metric_join.near_duplicates(vectors(spark, rows[2:6])).collect()) == 4


def test_metric_join_given_table(spark):
    rows = [(r[0], [float(x) for x in r[1]]) for r in table(spark, SF, "embeddings").select("vec_id", "embedding").collect()]
    got = [tuple(r) for r in QUERIES["op7_embedding_near_dedup"](spark, SF).collect()]
    assert sorted(got, key=str) == plain_vectors(rows)


def test_more_pivots_where_they_separate():
    tight = np.array([v for _, v in clustered(600, 2, 0.02)])
    tight /= np.linalg.norm(tight, axis=1)[:, None]
    assert len(metric_join.choose_pivots(tight, 10_000_000, 0.316)) >= 8


@pytest.mark.parametrize("spread", [0.1, 0.25, 1.0])
def test_metric_join_of_many_cells_and_tiles(spark, spread, monkeypatch):
    chosen = metric_join.choose_pivots
    monkeypatch.setattr(metric_join, "choose_pivots", lambda sample, n, eps: chosen(sample, 10_000_000, eps))
    monkeypatch.setattr(metric_join, "BLOCK", 8)
    monkeypatch.setattr(metric_join, "PLANES", 3)
    monkeypatch.setattr(metric_join, "TILE_BYTES", 60 * (16 * 4 + 40))
    rows = [(k, np.float32(v).tolist()) for k, v in clustered(500, 5, spread)]
    rows += [(1000 + k, v) for k, v in rows[:40]] + [(2000, rows[0][1])] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = [tuple(r) for r in metric_join.near_duplicates(df).collect()]
    assert sorted(got, key=str) == plain_vectors(rows)


def test_metric_join_writes_no_copies(spark, monkeypatch):
    """What tasks hand on is in proportion to the vectors, however many blocks they meet."""
    given, frame = spark.sparkContext.accumulator(0), type(spark.range(0))

    def counted(self, fn, *a, map_in_arrow=frame.mapInArrow, **b):
        def run(batches):
            for x in fn(batches):
                given.add(x.nbytes)
                yield x
        return map_in_arrow(self, run, *a, **b)

    monkeypatch.setattr(frame, "mapInArrow", counted)
    monkeypatch.setattr(metric_join, "BLOCK", 16)
    rows = list(enumerate(np.random.default_rng(3).normal(size=(1500, 64)).tolist()))
    assert len(metric_join.near_duplicates(vectors(spark, rows)).collect()) == 1500
    assert given.value < 5 * 1500 * 64 * 8


# -- components ------------------------------------------------------------

def test_components_of_a_path_a_star_and_loops(spark):
    links = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 40)] + [(7, 7), (2000, 2001), (2001, 2000),
                                                                                     (2000, 2001), (None, 3), (4, None)]
    random.Random(1).shuffle(links)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{1000 + k: 1000 for k in range(40)}, 2000: 2000, 2001: 2000}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


# -- preferences -----------------------------------------------------------

CONV = "conv_id long, turn long, role string, text string, split int, part string"


def conversation(spark, rows):
    return spark.createDataFrame([(*r, 1, "p") for r in rows], CONV)


def rendered(rows):
    out = {}
    for r in rows:
        out.setdefault((r["pair_id"], r["part"]), []).append(r)
    texts = {}
    for key, rs in out.items():
        rs.sort(key=lambda r: r["start"])
        text = ""
        for r in rs:
            assert r["start"] == len(text) and r["length"] == len(r["rendered"])
            text += r["rendered"]
        texts[key] = (text, [text[r["train_start"]:r["train_end"]] for r in rs if r["train_start"] is not None])
    return texts


def test_preferences_prefix_and_masks(spark, monkeypatch):
    monkeypatch.setattr(preference, "TURNS", 2)
    chosen = preference.turns_of(conversation(spark, [
        (1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "good"), (1, 3, "user", "more"), (1, 4, "assistant", "é👍"),
        (2, 0, "user", None), (2, 1, "assistant", "same"), (3, 0, "user", "only chosen"), (4, 5, "user", "a"), (4, 5, "user", "a"),
        (None, 0, "user", "x"), (5, None, "user", "x")]))
    rejected = preference.turns_of(conversation(spark, [
        (1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "bad"), (2, 0, "user", ""), (2, 1, "assistant", "same"),
        (4, 5, "tool", "a"), (6, 0, "assistant", "only rejected")]))
    got = rendered(preference.format_preferences(chosen, rejected).collect())
    head = lambda role: f"<|im_start|>{role}\n"
    end = "<|im_end|>\n"
    assert got[1, "prompt"] == (head("system") + "s" + end + head("user") + "q" + end, [])
    assert got[1, "chosen"] == (head("assistant") + "good" + end + head("user") + "more" + end + head("assistant") + "é👍" + end,
                                ["good" + end, "é👍" + end])
    assert got[1, "rejected"] == (head("assistant") + "bad" + end, ["bad" + end])
    assert set(got) == {(1, "prompt"), (1, "chosen"), (1, "rejected"), (2, "prompt"), (3, "chosen"), (4, "chosen"),
                        (4, "rejected"), (6, "rejected")}
    assert got[2, "prompt"][1] == [] and got[4, "chosen"][1] == []
    empty = conversation(spark, []).limit(0)
    assert preference.format_preferences(preference.turns_of(empty), preference.turns_of(empty)).collect() == []


def test_preferences_against_sql(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.execute(preference.SQL)
    names = [d[0] for d in want.description]
    got = QUERIES["op8_preference_format"](spark, SF)
    assert got.columns == names
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


def test_preferences_of_every_turn(spark):
    rows = QUERIES["op8_preference_format"](spark, SF).collect()
    given = {(r["conv_id"], r["turn"]) for r in table(spark, SF, "conversations").collect() if None not in (r["conv_id"], r["turn"])}
    assert {(r["conv_id"], r["turn"]) for r in rows if r["part"] != "rejected"} == given
    turns = preference.turns_of(conversation(spark, [
        (2, 0, "user", "q"), (2, 1, "assistant", "two"), (2, 2, "user", "thanks"), (3, 0, "assistant", "three"),
        (4, 0, "user", "no reply"), (6, 0, "assistant", "no partner"), (6, 1, "user", "ok")]))
    got = {k: v[0].replace("<|im_end|>\n", ";") for k, v in
           rendered(preference.format_pairs(preference.reply_pairs(turns)).collect()).items()}
    head = lambda role, text: f"<|im_start|>{role}\n{text};"
    assert got == {(2, "prompt"): head("user", "q"), (2, "chosen"): head("assistant", "two") + head("user", "thanks"),
                   (2, "rejected"): head("assistant", "three") + head("user", "thanks"),
                   (3, "chosen"): head("assistant", "three"), (3, "rejected"): head("assistant", "two"),
                   (4, "prompt"): head("user", "no reply"), (6, "chosen"): head("assistant", "no partner") + head("user", "ok"),
                   (6, "rejected"): head("user", "ok")}


# -- pipeline --------------------------------------------------------------

def test_pipeline_stages_against_brute_force(spark):
    from gridcast.llm import kernel_quality
    rows = table(spark, SF, "documents")
    source = {r["doc_id"]: r for r in rows.collect()}
    bad = {r["doc_id"] for r in kernel_quality.quality_scores(rows, table(spark, SF, "labels")).collect() if not r["predicted"]}
    kept = [(i, r["text"]) for i, r in source.items() if i not in bad]
    lines = [(i, t) for i, _, _, t in plain_lines(kept)]
    label = plain_groups([plain_fingerprint(t) for _, t in lines])
    first = {}
    for (i, t), k in zip(lines, label):
        first[k] = min(first.get(k, (i, t)), (i, t))
    check_packing([tuple(r) for r in corpus_pipeline.run(spark, SF).collect()], list(first.values()))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup",
                                                            "best-fit packing"]


def test_pipeline_on_awkward_rows(spark):
    df = docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
        df = spark.createDataFrame(out.collect(), df.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() >= df.count()
    empty = docs(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    assert df.where(F.col("text").isNull()).count() == 0
