"""Chat formatting with Spark expressions only: turns are sorted, neighbours of one role merged, and all concatenated.

A block is <turn ROLE>, a line feed, its texts with <next> between those of merged turns, </turn> and a line feed. In roles and texts \\, <
and > are written \\e, \\l and \\g, so no text can hold a mark, and reading back is exact. Loss spans cover the assistant's texts.

Cases: a null text or role counts as empty; turns without number come first; equal turns all stay, ordered by role and text;
rows without conv_id form one conversation; other columns than conv_id, turn, role and text are not read; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: the role whose texts are learnt.
LEARNT = "assistant"
ESCAPES = (("\\", "\\e"), ("<", "\\l"), (">", "\\g"))


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, formatted (string) and loss_spans (array of start, end in code points; one for each assistant turn) of each conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    back = F.lag("role").over(order)
    head = F.when(back == F.col("role"), F.lit("<next>")).otherwise(F.concat(F.when(back.isNull(), "").otherwise("</turn>\n"), F.lit("<turn "), escape(F.col("role")), F.lit(">\n")))
    numbered = clean.select("conv_id", "role", F.row_number().over(order).alias("n"), head.alias("head"), escape(F.col("text")).alias("body"))
    by_number = Window.partitionBy("conv_id").orderBy("n")
    placed = numbered.withColumn("stop", F.sum(F.char_length("head") + F.char_length("body")).over(by_number))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "role", "head", "body", "stop"))).alias("turns"))
    merged = F.concat(F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"])), ""), F.lit("</turn>\n"))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == LEARNT), lambda t: F.struct((t["stop"] - F.char_length(t["body"])).alias("start"), t["stop"].alias("end")))
    return whole.select("conv_id", merged.alias("formatted"), spans.alias("loss_spans"))


def parsed(column: str) -> Column:
    """The turns that a formatted string was made from: array of role, text."""
    blocks = F.filter(F.split(column, "<turn "), lambda b: b != "")
    role = lambda b: unescape(F.substring_index(b, ">\n", 1))
    body = lambda b: F.substring_index(F.substring(b, F.char_length(F.substring_index(b, ">\n", 1)) + 3, F.char_length(b)), "</turn>", 1)
    return F.flatten(F.transform(blocks, lambda b: F.transform(F.split(body(b), "<next>"), lambda t: F.struct(role(b).alias("role"), unescape(t).alias("text")))))


def read_back(done: DataFrame) -> DataFrame:
    """The columns of op7, all from the formatted string; what is learnt by the loss spans."""
    turns = done.select("conv_id", "formatted", "loss_spans", parsed("formatted").alias("turns"))
    everything = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(everything, 256).alias("turns_sha256"),
        F.char_length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def query(conversations: DataFrame) -> DataFrame:
    """op7: all conversations, and one more (-7) whose texts look like control strings."""
    spark = conversations.sparkSession
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_back(formatted(conversations.select("conv_id", "turn", "role", "text").unionByName(extra)))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS same FROM c),
n AS (SELECT *, length(text) + length(text) - length(translate(text, '\<>', '')) AS chars FROM t)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN same THEN 6 ELSE length(role) + 16 END) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
