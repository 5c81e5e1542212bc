"""Preference formatting of chosen and rejected conversations.

Turns that both conversations begin with alike (role and text) are the common
prefix; it is rendered once, as the prompt.  What follows is rendered as two
completions.  A completion's mask trains the text and end mark of assistant
turns; headers, other roles and the whole prompt are masked out.

Everything is a row per rendered turn, placed by offsets within its part, so
a conversation of any length is never one value or one task: turns meet by
(pair, turn), the split is a minimum per pair, and offsets come from sums per
block of turns and a window over the blocks.  What rows meet by pair alone is
a written table of a row per pair, so that Spark can split a long conversation.

Defined results: turns without a pair id or number are left out; repeated rows
of a turn count once (of different rows the smallest role, then text); null
role or text is empty; gaps in the numbering are allowed; equal conversations
are all prompt; a side without turns gives no rows of that part; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Turns whose lengths are summed together.
TURNS = 256
HEAD = ("<|im_start|>", "\n")   # before and after the role
TAIL = "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def turns_of(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """``pair_id, turn, role, text`` with one row per turn."""
    rows = conversations.where(F.col(id_col).isNotNull() & F.col(turn_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("pair_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    first = F.row_number().over(Window.partitionBy("pair_id", "turn").orderBy("role", "text"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def side_by_side(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``pair_id, turn, chosen, rejected``: both sides' turns (role and text,
    null where a side has none), written once."""
    a = chosen.select("pair_id", "turn", F.struct("role", "text").alias("chosen"))
    b = rejected.select("pair_id", "turn", F.struct("role", "text").alias("rejected"))
    return materialize(a.join(b, ["pair_id", "turn"], "full_outer"))


def common_prefix(both: DataFrame) -> DataFrame:
    """``pair_id, split``: number of the first turn that differs (null if the
    conversations are equal)."""
    differs = ~F.col("chosen").eqNullSafe(F.col("rejected"))
    return both.groupBy("pair_id").agg(F.min(F.when(differs, F.col("turn"))).alias("split"))


def format_pairs(both: DataFrame) -> DataFrame:
    """Rendered turns of every pair of ``pair_id, turn, chosen, rejected``:
    ``pair_id, part`` (prompt, chosen, rejected), ``turn, rendered, start,
    length, train_start, train_end`` (offsets in code points within the part;
    nothing trained: both null)."""
    split = materialize(common_prefix(both))
    shared = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    sides = F.when(shared, F.array(F.struct(F.lit("prompt").alias("part"), F.col("chosen").alias("t")))).otherwise(
        F.array(F.struct(F.lit("chosen").alias("part"), F.col("chosen").alias("t")),
                F.struct(F.lit("rejected").alias("part"), F.col("rejected").alias("t"))))
    rows = (both.join(split, "pair_id").select("pair_id", "turn", F.inline(sides)).where("t is not null")
            .select("pair_id", "turn", "part", "t.role", F.concat(F.lit(HEAD[0]), "t.role", F.lit(HEAD[1])).alias("head"), "t.text")
            .withColumn("rendered", F.concat("head", "text", F.lit(TAIL)))
            .withColumn("length", F.length("rendered").cast("long"))
            .withColumn("block", F.floor(F.col("turn") / F.lit(TURNS))))
    sums = rows.groupBy("pair_id", "part", "block").agg(F.sum("length").alias("total"))
    earlier = Window.partitionBy("pair_id", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("pair_id", "part", "block", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("pair_id", "part", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    placed = (rows.withColumn("inner", F.coalesce(F.sum("length").over(within), F.lit(0)))
              .join(sums, ["pair_id", "part", "block"])
              .withColumn("start", F.col("before") + F.col("inner")))
    trained = (F.col("part") != "prompt") & (F.col("role") == TRAINED_ROLE)
    begin = F.col("start") + F.length("head")
    return placed.select("pair_id", "part", "turn", "rendered", "start", "length",
                         F.when(trained, begin).alias("train_start"),
                         F.when(trained, F.col("start") + F.col("length")).alias("train_end"))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """:func:`format_pairs` of chosen and rejected conversations (``pair_id,
    turn, role, text`` each)."""
    return format_pairs(side_by_side(chosen, rejected))


def reply_pairs(turns: DataFrame) -> DataFrame:
    """Pairs made from one table of turns, with every turn in: a conversation,
    and the same with its last assistant turn's text replaced by the last reply
    of its partner (ids 2k and 2k + 1 are partners; without a partner's reply
    the rejected side lacks the turn).  Turns after it stay on both sides;
    conversations without an assistant turn are equal pairs, hence all prompt."""
    replies = materialize(turns.where(F.col("role") == TRAINED_ROLE).groupBy("pair_id")
                          .agg(F.max_by(F.struct("turn", "text"), "turn").alias("last")))
    other = replies.select(F.col("pair_id").bitwiseXOR(F.lit(1).cast("long")).alias("pair_id"), F.col("last.text").alias("reply"))
    swap = materialize(replies.select("pair_id", F.col("last.turn").alias("last")).join(other, "pair_id", "left"))
    own = F.struct("role", "text")
    swapped = F.when(F.col("reply").isNotNull(), F.struct(F.lit(TRAINED_ROLE).alias("role"), F.col("reply").alias("text")))
    return materialize(turns.join(swap, "pair_id", "left").select(
        "pair_id", "turn", own.alias("chosen"),
        F.when(F.col("last").isNull() | (F.col("turn") != F.col("last")), own).otherwise(swapped).alias("rejected")))


#: The registered query in SQL (DuckDB).
SQL = f"""
WITH t0 AS (SELECT CAST(conv_id AS BIGINT) AS pair_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role,
    coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
t AS (SELECT * FROM t0 QUALIFY row_number() OVER (PARTITION BY pair_id, turn ORDER BY role, text) = 1),
la AS (SELECT pair_id, max(turn) AS last FROM t WHERE role = '{TRAINED_ROLE}' GROUP BY 1),
k AS (SELECT t.*, last FROM t LEFT JOIN la USING (pair_id)),
ch AS (SELECT pair_id, turn, role, text FROM k),
re AS (SELECT pair_id, turn, role, text FROM k WHERE last IS NULL OR turn <> last
    UNION ALL SELECT la.pair_id, la.last, '{TRAINED_ROLE}', p.text FROM la JOIN k p
        ON p.pair_id = xor(la.pair_id, 1) AND p.turn = p.last),
sp AS (SELECT coalesce(ch.pair_id, re.pair_id) AS pair_id, min(CASE WHEN ch.turn IS NULL OR re.turn IS NULL
        OR ch.role <> re.role OR ch.text <> re.text THEN coalesce(ch.turn, re.turn) END) AS split
    FROM ch FULL OUTER JOIN re ON ch.pair_id = re.pair_id AND ch.turn = re.turn GROUP BY 1),
s AS (SELECT 'chosen' AS side, * FROM ch UNION ALL SELECT 'rejected', * FROM re),
r AS (SELECT s.*, CASE WHEN split IS NULL OR turn < split THEN 'prompt' ELSE side END AS part,
    '<|im_start|>' || role || chr(10) AS head FROM s JOIN sp USING (pair_id)
    WHERE side = 'chosen' OR NOT (split IS NULL OR turn < split)),
x AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS rendered FROM r),
o AS (SELECT *, length(rendered) AS n, CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM x)
SELECT pair_id AS conv_id, part, turn, md5(rendered) AS rendered_md5, start, CAST(n AS BIGINT) AS length,
    CAST(CASE WHEN part <> 'prompt' AND role = '{TRAINED_ROLE}' THEN start + length(head) END AS BIGINT) AS train_start,
    CAST(CASE WHEN part <> 'prompt' AND role = '{TRAINED_ROLE}' THEN start + n END AS BIGINT) AS train_end
FROM o"""
