"""Preference formatting of chat conversations (DataFrame operations only).

A row with two arrays of turns, chosen and rejected, becomes a prompt, the rendering of their longest common prefix of
turns, and two completions, the renderings of what remains.  Each completion has a mask: the spans of code points
(start, length) that the model is to learn, the texts and end marks of assistant turns; role headers and the turns of
others are masked out.  Turns are null-safe equal when role and text are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, read_table

START, END = "<|im_start|>", "<|im_end|>\n"
LEARNED_ROLE = "assistant"
SPANS = "array<struct<start:int,length:int>>"


def header(turn: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(turn["role"], F.lit("")), F.lit("\n"))


def body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t), body(t))), "")


def learned_spans(turns: Column) -> Column:
    """Spans of the assistant turns' bodies in render(turns): one pass that carries the position."""
    none = F.array().cast(SPANS)
    first = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        a, n = acc["at"] + F.length(header(t)), F.length(body(t))
        span = F.array(F.struct(a.alias("start"), n.alias("length")))
        return F.struct((a + n).alias("at"), F.when(t["role"] == LEARNED_ROLE, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, first, add, lambda acc: acc["spans"])


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    n = F.least(F.size(chosen), F.size(rejected))
    same = F.transform(F.slice(chosen, F.lit(1), n), lambda t, i: F.get(rejected, i).eqNullSafe(t))
    first_other = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first_other > 0, first_other - 1).otherwise(n)


def preference_format(pairs: DataFrame, *, chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """pairs with prompt, chosen_text, rejected_text, chosen_mask, rejected_mask, n_common in place of the two arrays of struct(role, text).

    A null array counts as empty; equal conversations give two empty completions.  Other columns are kept, whatever
    their names; the two arrays are read before, so a column that has one of the new names, in any case, is replaced.
    Repeated rows stay, and an empty table gives an empty result.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    new = ("prompt", "chosen_text", "rejected_text", "chosen_mask", "rejected_mask", "n_common")
    replaced = {c.lower() for c in (chosen_col, rejected_col, *new)}
    kept = [c for c in pairs.columns if c.lower() not in replaced]
    p, c, r = free_names(pairs, "_p", "_c", "_r")
    d = pairs.select(*[F.col(f"`{x}`") for x in kept], F.coalesce(chosen_col, none).alias(c), F.coalesce(rejected_col, none).alias(r))
    d = d.withColumn("n_common", common_turns(F.col(c), F.col(r)))
    rest = lambda a: F.slice(a, F.col("n_common") + 1, F.greatest(F.size(a), F.lit(1)))
    d = d.withColumns({p: F.slice(c, F.lit(1), F.col("n_common")), c: rest(c), r: rest(r)})
    return d.select(
        *[F.col(f"`{x}`") for x in kept],
        "n_common",
        render(F.col(p)).alias("prompt"),
        render(F.col(c)).alias("chosen_text"),
        render(F.col(r)).alias("rejected_text"),
        learned_spans(F.col(c)).alias("chosen_mask"),
        learned_spans(F.col(r)).alias("rejected_mask"),
    )


def conversations_as_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) from (conv_id, turn, role, text), in order of turn, then role and text; null turns first.

    Turns that are repeated stay.  Turns without a conversation id are one conversation, with a null id.
    """
    s = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(s.alias("_t")).select("conv_id", F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def with_other_replies(convs: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected): the rejected conversation ends with the last assistant turn of the partner (the id with its lowest bit flipped) instead of its own.

    Without a partner, or if either has no assistant turn, the rejected one is the conversation up to that turn.  A
    null id has no partner.
    """
    mine = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == LEARNED_ROLE, i)))
    d = convs.withColumn("_last", mine).withColumn("_reply", F.when(F.col("_last").isNotNull(), F.get("turns", F.col("_last"))))
    other = d.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("_id"), F.col("_reply").alias("_other"))
    kept = F.slice("turns", F.lit(1), F.coalesce("_last", F.size("turns")))
    swapped = F.when(F.col("_other").isNotNull() & F.col("_last").isNotNull(), F.concat(kept, F.array("_other"))).otherwise(kept)
    return d.join(other, F.col("conv_id") == F.col("_id"), "left").select("conv_id", F.col("turns").alias("chosen"), swapped.alias("rejected"))


def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = preference_format(with_other_replies(conversations_as_turns(read_table(spark, sf_dir, "conversations"))))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["length"].cast("string"))), ",")
    return d.withColumns({"chosen_mask": spans("chosen_mask"), "rejected_mask": spans("rejected_mask"), "n_common": F.col("n_common").cast("long")})


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM conversations
), l AS (SELECT conv_id, max(i) FILTER (role = 'assistant') AS last, count(*) AS n FROM t GROUP BY conv_id),
r AS (SELECT t.conv_id, t.role, t.text FROM t JOIN l ON t.conv_id = l.conv_id AND t.i = l.last),
c AS (SELECT conv_id, 'c' AS side, i, role, text FROM t),
x AS (
  SELECT t.conv_id, 'r' AS side, t.i, t.role, t.text FROM t JOIN l ON t.conv_id = l.conv_id WHERE t.i < coalesce(l.last, l.n + 1)
  UNION ALL
  SELECT l.conv_id, 'r', l.last, r.role, r.text FROM l JOIN r ON r.conv_id = xor(l.conv_id, 1) WHERE l.last IS NOT NULL
), k AS (
  SELECT l.conv_id, least(coalesce((SELECT max(i) FROM x WHERE x.conv_id = l.conv_id), 0), l.n) AS shorter,
    (SELECT min(c.i) FROM c JOIN x ON c.conv_id = x.conv_id AND c.i = x.i
      WHERE c.conv_id = l.conv_id AND (c.role IS DISTINCT FROM x.role OR c.text IS DISTINCT FROM x.text)) AS other FROM l
), m AS (SELECT conv_id, coalesce(other - 1, shorter) AS n_common FROM k),
s AS (
  SELECT a.*, m.n_common, '<|im_start|>' || coalesce(role, '') || chr(10) AS h, coalesce(text, '') || '<|im_end|>' || chr(10) AS b
  FROM (SELECT * FROM c UNION ALL SELECT * FROM x) a JOIN m ON a.conv_id = m.conv_id
), p AS (
  SELECT *, sum(length(h) + length(b)) OVER (PARTITION BY conv_id, side ORDER BY i) - length(b) AS spot FROM s WHERE i > n_common
), o AS (
  SELECT conv_id, side, string_agg(h || b, '' ORDER BY i) AS txt,
    string_agg(spot || ':' || length(b), ',' ORDER BY i) FILTER (role = 'assistant') AS mask FROM p GROUP BY conv_id, side
)
SELECT m.conv_id, m.n_common, coalesce((SELECT string_agg(h || b, '' ORDER BY i) FROM s WHERE s.conv_id = m.conv_id AND side = 'c' AND i <= s.n_common), '') AS prompt,
  coalesce(a.txt, '') AS chosen_text, coalesce(b.txt, '') AS rejected_text, coalesce(a.mask, '') AS chosen_mask, coalesce(b.mask, '') AS rejected_mask
FROM m LEFT JOIN o a ON a.conv_id = m.conv_id AND a.side = 'c' LEFT JOIN o b ON b.conv_id = m.conv_id AND b.side = 'r'
"""
