"""Preference pairs from chosen and rejected conversations, with DataFrame functions only.

The longest common prefix of turns (same role, same text) is rendered once as prompt; what follows is rendered as two
completions, whose masks are the spans of assistant text. A conversation is one training sample and is held in one row.

Defined results: null roles and texts are empty; turns with the same number are ordered by role and text, null numbers first;
repeated rows are turns of their own; equal conversations have a prompt and two empty completions; a conversation without
assistant turn, or without a counterpart, has an empty completion on that side; a null conv_id is a conversation of its own;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TURN_HEAD, TURN_END = "<|{role}|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>) in turn order."""
    filled = turns.select(
        "conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    ordered = filled.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    mismatch = F.array_position(F.zip_with(chosen, rejected, lambda a, b: a.eqNullSafe(b)), F.lit(False))
    return F.when(mismatch == 0, F.size(chosen)).otherwise(mismatch - 1).cast("int")


def _head(role: Column) -> Column:
    before, after = TURN_HEAD.split("{role}")
    return F.concat(F.lit(before), role, F.lit(after))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t["role"]), t["text"], F.lit(TURN_END))), "")


def trained_spans(turns: Column) -> Column:
    """Spans ``start:end`` (characters of the rendered turns) of what is trained on: texts of the trained role with
    their end marks, joined by commas."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(_head(t["role"]))
        end = begin + F.length(t["text"]) + len(TURN_END)
        span = F.concat(F.when(state["spans"] == "", F.lit("")).otherwise(F.lit(",")), begin.cast("string"), F.lit(":"), end.cast("string"))
        spans = F.when(t["role"] == TRAINED_ROLE, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def preference_rows(pairs: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected), both arrays of turns, to one row per pair: pair_id, n_common, prompt, chosen,
    chosen_mask, rejected, rejected_mask."""
    rows = pairs.select("pair_id", "chosen", "rejected", common_turns(F.col("chosen"), F.col("rejected")).alias("n_common"))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.size(c))
    parts = rows.select("pair_id", "n_common", F.slice("chosen", F.lit(1), F.col("n_common")).alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return parts.select(
        "pair_id", "n_common", rendered(F.col("p")).alias("prompt"), rendered(F.col("c")).alias("chosen"), trained_spans(F.col("c")).alias("chosen_mask"),
        rendered(F.col("r")).alias("rejected"), trained_spans(F.col("r")).alias("rejected_mask"))


def swapped_replies(turns: DataFrame) -> DataFrame:
    """Pairs from plain conversations: the chosen side is a conversation up to its last assistant turn, the rejected side has
    in that place the last assistant turn of its neighbour (ids 2k and 2k+1 are neighbours), or nothing."""
    whole = conversations(turns)
    is_reply = F.transform("turns", lambda t: t["role"] == TRAINED_ROLE)
    last = F.size("turns") - F.array_position(F.reverse(is_reply), F.lit(True)).cast("int") + 1
    place = F.when(F.array_contains(is_reply, True), last)
    cut = whole.select("conv_id", F.col("turns"), place.alias("place"))
    replies = cut.where(F.col("place").isNotNull()).select(
        F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.element_at("turns", F.col("place")).alias("other"))
    joined = cut.join(replies, "conv_id", "left")
    before = F.slice("turns", F.lit(1), F.coalesce(F.col("place") - 1, F.size("turns")))
    chosen = F.when(F.col("place").isNull(), F.col("turns")).otherwise(F.slice("turns", F.lit(1), F.coalesce("place", F.lit(0))))
    rejected = F.when(F.col("place").isNull() | F.col("other").isNull(), before).otherwise(F.concat(before, F.array("other")))
    return joined.select(F.col("conv_id").alias("pair_id"), chosen.alias("chosen"), rejected.alias("rejected"))


SQL = r"""
WITH numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n FROM conversations),
places AS (SELECT conv_id, max(CASE WHEN role = 'assistant' THEN n END) AS place, max(n) AS n_turns FROM numbered GROUP BY conv_id),
replies AS (SELECT n.conv_id, n.role, n.text, n.n FROM numbered n JOIN places p ON n.conv_id = p.conv_id AND n.n = p.place),
sides AS (
  SELECT n.conv_id, 'c' AS side, n.n, n.role, n.text FROM numbered n JOIN places p ON n.conv_id IS NOT DISTINCT FROM p.conv_id
  WHERE n.n <= coalesce(p.place, p.n_turns)
  UNION ALL
  SELECT n.conv_id, 'r', n.n, n.role, n.text FROM numbered n JOIN places p ON n.conv_id IS NOT DISTINCT FROM p.conv_id
  WHERE p.place IS NULL OR n.n < p.place
  UNION ALL
  SELECT p.conv_id, 'r', p.place, r.role, r.text FROM places p JOIN replies r ON r.conv_id = xor(p.conv_id, 1) WHERE p.place IS NOT NULL),
mismatch AS (
  SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, min(coalesce(a.n, b.n)) AS n
  FROM (SELECT * FROM sides WHERE side = 'c') a FULL JOIN (SELECT * FROM sides WHERE side = 'r') b
    ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND a.n = b.n
  WHERE a.n IS NULL OR b.n IS NULL OR a.role <> b.role OR a.text <> b.text GROUP BY 1),
common AS (
  SELECT p.conv_id, coalesce(m.n - 1, coalesce(p.place, p.n_turns)) AS n_common
  FROM places p LEFT JOIN mismatch m ON p.conv_id IS NOT DISTINCT FROM m.conv_id),
turns AS (
  SELECT s.conv_id, s.side, s.n, s.role, s.text, s.n <= c.n_common AS shared, '<|' || s.role || '|>' || chr(10) AS head
  FROM sides s JOIN common c ON s.conv_id IS NOT DISTINCT FROM c.conv_id),
placed AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS shown,
         sum(length(head) + length(text) + 8) OVER (PARTITION BY conv_id, side, shared ORDER BY n) - length(text) - 8 AS begin FROM turns),
joined AS (
  SELECT conv_id, string_agg(shown, '' ORDER BY n) FILTER (side = 'c' AND shared) AS prompt,
         string_agg(shown, '' ORDER BY n) FILTER (side = 'c' AND NOT shared) AS chosen,
         string_agg(begin || ':' || (begin + length(text) + 8), ',' ORDER BY n) FILTER (side = 'c' AND NOT shared AND role = 'assistant') AS chosen_mask,
         string_agg(shown, '' ORDER BY n) FILTER (side = 'r' AND NOT shared) AS rejected,
         string_agg(begin || ':' || (begin + length(text) + 8), ',' ORDER BY n) FILTER (side = 'r' AND NOT shared AND role = 'assistant') AS rejected_mask
  FROM placed GROUP BY conv_id)
SELECT c.conv_id AS pair_id, CAST(c.n_common AS INTEGER) AS n_common, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen,
       coalesce(chosen_mask, '') AS chosen_mask, coalesce(rejected, '') AS rejected, coalesce(rejected_mask, '') AS rejected_mask
FROM common c LEFT JOIN joined j ON c.conv_id IS NOT DISTINCT FROM j.conv_id
"""
