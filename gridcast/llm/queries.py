"""Registered queries of the numbered operators (``opN_<name>``).

Each applies its operator with production parameters to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, hard_negatives, hmm, kernel_quality, line_runs, metric_join, packing, preference, repeats, simhash,
               warc, whitening, winnow)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file (a parameter of the operators)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@register("op1_best_fit_packing")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"))


@register("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    g = simhash.simhash_groups(table(spark, sf, "documents"))
    return g.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


@register("op3_bpe_round_trip")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"))


@register("op4_line_dedup")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return line_runs.line_report(table(spark, sf, "documents"))


@register("op5_warc")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archive_report(spark, table(spark, sf, "pages"))


@register("op6_document_fingerprints")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return winnow.edited_fingerprints(table(spark, sf, "documents"))


@register("op7_embedding_near_dedup")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return metric_join.near_duplicates(table(spark, sf, "embeddings"))


@register("op8_preference_format")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    rows = preference.format_pairs(preference.reply_pairs(preference.turns_of(table(spark, sf, "conversations"))))
    return rows.select(F.col("pair_id").alias("conv_id"), "part", "turn", F.md5("rendered").alias("rendered_md5"), "start",
                       "length", "train_start", "train_end")


ORACLE["op8_preference_format"] = preference.SQL


@register("op9_hmm_score")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return hmm.score_documents(table(spark, sf, "documents"))


@register("op10_quality_classifier")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    scores = kernel_quality.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return scores.drop("th")


@register("op11_hard_negatives")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.integer_vectors(table(spark, sf, "embeddings"), moved, F.col("vec_id") % 50 == 0)
    return hard_negatives.mine(rows)


@register("op12_embedding_whitening")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


@register("op13_repeat_removal")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.repeat_report(table(spark, sf, "documents"))


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE["op4_line_dedup"] = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= {line_runs.MIN_CHARS} GROUP BY key
    HAVING count(DISTINCT doc_id) >= {line_runs.MIN_DOCS}),
d AS (SELECT k.*, c.owner IS NOT NULL AND c.owner <> doc_id AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id"""

ORACLE["op5_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, strlen(h) AS n, array_to_string(list_transform(string_split(sha1(h), ''), lambda c:
    ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110',
     '1111'][strpos('0123456789abcdef', c)]), '') AS bits, min(page_id) OVER (PARTITION BY h) AS first,
    row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST) = 1 AS response FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda j:
        CAST(substr(bits, CAST(i * 5 + j + 1 AS BIGINT), 1) AS INTEGER) * (16 >> CAST(j AS INTEGER)))) AS BIGINT), 1)), '') AS payload_digest,
    CASE WHEN response THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN NOT response THEN first END AS refers_to
FROM s"""

ORACLE["op7_embedding_near_dedup"] = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a, v b
    WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {metric_join.THRESHOLD}),
r AS (SELECT vec_id AS u, vec_id AS w FROM v UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u),
n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u),
c AS (SELECT u, min(w) AS component_id FROM r GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON c.u = vec_id LEFT JOIN n ON n.u = vec_id"""

ORACLE["op11_hard_negatives"] = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
f AS (SELECT vec_id, label, list_transform(v, lambda x: floor(x * {hard_negatives.SCALE})) AS v FROM e
    WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM f a, f b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {hard_negatives.POSITIVES}),
n AS (SELECT p.*, s.other AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS rank
    FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND {hard_negatives.LOW} * positive_score <= 100 * s.score
    AND 100 * s.score <= {hard_negatives.HIGH} * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n
WHERE rank <= {hard_negatives.NEGATIVES}"""
