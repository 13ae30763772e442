"""Multi-party chat formatting: one rendering of a dialogue for each participant, by native expressions.

Participants are the distinct roles of a dialogue but SYSTEM. In a participant's rendering its own turns are the assistant's,
the others' are users' under their names, and system turns stay what they are:

    <|system|>            <|assistant|>         <|user name=NAME|>
    text<|end|>           text<|end|>           text<|end|>

The mask has the character spans to learn from: the text and end mark of the assistant's turns. Turns are in order of turn
(null last), then role and text. A marker within a text or name is broken up ("<|" becomes "< |"), so none can be forged.

Defined cases: a null role is the participant "unknown"; a null text is empty; rows with a null dialogue id are one dialogue;
repeated rows are turns of their own; turns that tie in all three are alike, so their order doesn't show; very long texts are rendered
whole; other columns are left out, whatever their names; a dialogue of system turns alone has no participant and no rendering; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SYSTEM, UNKNOWN, END = "system", "unknown", "<|end|>\n"
SYSTEM_HEAD, OWN_HEAD, USER_HEAD = "<|system|>\n", "<|assistant|>\n", ("<|user name=", "|>\n")


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _named(role: Column) -> Column:
    """The length of a user's head."""
    return F.length(role) + sum(map(len, USER_HEAD))


def rotate_perspectives(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, speaker, n_turns, n_targets, rendered, mask): mask is an array of (start, end), in characters."""
    role, text = _safe(F.coalesce(F.col(role_col), F.lit(UNKNOWN))), _safe(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.select(F.col(id_col).alias("id"), F.col(turn_col).isNull().alias("late"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    # Where each turn ends in a rendering that is nobody's; in a speaker's own, each turn of theirs so far moves it by the same number.
    head = F.when(F.col("role") == SYSTEM, F.lit(len(SYSTEM_HEAD))).otherwise(_named(F.col("role")))
    so_far = W.partitionBy("id").orderBy("late", "turn", "role", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.withColumn("upto", F.sum(head + F.length("text") + len(END)).over(so_far))
    dialogues = placed.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("late", "turn", "role", "text", "upto"))).alias("turns"))
    speakers = F.array_distinct(F.filter(F.transform("turns", lambda t: t["role"]), lambda r: r != SYSTEM))
    each = dialogues.select("id", "turns", F.explode(speakers).alias("speaker"))

    def part(t: Column) -> Column:
        user = F.concat(F.lit(USER_HEAD[0]), t["role"], F.lit(USER_HEAD[1]))
        shown = F.when(t["role"] == SYSTEM, F.lit(SYSTEM_HEAD)).when(t["role"] == F.col("speaker"), F.lit(OWN_HEAD)).otherwise(user)
        return F.concat(shown, t["text"], F.lit(END))

    moved = F.lit(len(OWN_HEAD)) - _named(F.col("speaker"))

    def span(t: Column, nth: Column) -> Column:
        end = t["upto"] + (nth + 1) * moved
        return F.struct((end - F.length(t["text"]) - len(END)).cast("int").alias("start"), end.cast("int").alias("end"))

    own = F.filter("turns", lambda t: t["role"] == F.col("speaker"))
    return each.select(
        "id", "speaker", F.size("turns").alias("n_turns"), F.size(own).alias("n_targets"),
        F.array_join(F.transform("turns", part), "").alias("rendered"), F.transform(own, span).alias("mask"),
    )


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return rotate_perspectives(turns).select(F.col("id").alias("conv_id"), "speaker", F.col("n_turns").cast("bigint").alias("n_turns"), F.col("n_targets").cast("bigint").alias("n_targets"), "rendered", spans.alias("mask"))


OP3_SQL = """
WITH t AS (SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
p AS (
  SELECT s.conv_id, s.speaker, t.turn, t.role, t.text, t.role = s.speaker AS own,
    CASE WHEN t.role = 'system' THEN '<|system|>' WHEN t.role = s.speaker THEN '<|assistant|>' ELSE '<|user name=' || t.role || '|>' END || chr(10) AS head,
    t.text || '<|end|>' || chr(10) AS body
  FROM s JOIN t ON s.conv_id IS NOT DISTINCT FROM t.conv_id),
q AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS LAST, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM p)
SELECT conv_id, speaker, count(*) AS n_turns, count(*) FILTER (own) AS n_targets,
  string_agg(head || body, '' ORDER BY turn NULLS LAST, role, text) AS rendered,
  string_agg((upto - length(body))::BIGINT || '-' || upto::BIGINT, ',' ORDER BY upto) FILTER (own) AS mask
FROM q GROUP BY conv_id, speaker
"""
