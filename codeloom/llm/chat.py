"""Chat formatting: every assistant turn becomes an example of its own.

An example is all turns up to one assistant turn, rendered; only that reply is trainable, given as a span of the
rendered text.  Turns behind the last reply (or of a conversation without any) make a closing example without a
span, so that nothing of a conversation is lost.

A turn is rendered as ``<s>[INST] role [/INST] text </s>``.  Control strings inside roles and texts are escaped with
one more backslash than stands before them, so that ``read_turns`` gives back exactly what went in.

Defined results: turns come in the order of ``turn`` (null first), then role, then text; null roles and texts count as
empty; rows with a null conv_id are one conversation; repeated rows are turns of their own; equal turns come in any
order, which changes nothing.  Long texts are taken whole.  An empty table gives no examples.  Further columns are
ignored, whatever their names.  A conversation is put together in one row of one task, as its digest needs it whole: a
single conversation beyond the size of a row cannot be formatted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import slim

# The template.
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST] ", " </s>"
CONTROL = r"\\*(?:</?s>|\[/?INST\])"
REPLY = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\({CONTROL})", "$1")


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_length): code points, start from 0; length null without a reply."""
    rows = slim(turns, "conv_id", "turn", "role", "text").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    before = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE))
    # before and inside are computed once for each turn
    parts = whole.select("conv_id", F.transform("turns", lambda t: F.struct(
        before(t).alias("before"), escape(t["text"]).alias("inside"), (t["role"] == REPLY).alias("reply"))).alias("parts"))
    n = F.size("parts")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("parts", i)["reply"] | (i == n))
    each = parts.select("conv_id", "parts", F.posexplode(ends).alias("example", "n"))
    joined = lambda parts: F.array_join(F.transform(parts, lambda p: F.concat(p["before"], p["inside"], F.lit(CLOSE))), "")
    last = F.element_at("parts", F.col("n"))
    return each.select(
        "conv_id", "example", joined(F.slice("parts", 1, F.col("n") - 1)).alias("context"), last.alias("last"),
    ).select(
        "conv_id", "example", F.concat("context", "last.before", "last.inside", F.lit(CLOSE)).alias("formatted"),
        (F.length("context") + F.length("last.before")).alias("loss_start"),
        F.when(F.col("last.reply"), F.length("last.inside")).alias("loss_length"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a rendered text."""
    pieces = F.split(formatted, CLOSE, -1)
    inner = F.slice(pieces, 1, F.size(pieces) - 1)
    pattern = r"(?s)^<s>\[INST\] (.*?) \[/INST\] (.*)$"
    return F.transform(inner, lambda p: F.struct(
        unescape(F.regexp_extract(p, pattern, 1)).alias("role"), unescape(F.regexp_extract(p, pattern, 2)).alias("text")))


def trainable(formatted: Column, start: Column, length: Column) -> Column:
    """The text under the loss mask, unescaped; null without a mask."""
    return unescape(F.substring(formatted, start + 1, length))


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the examples, a row for each conversation."""
    loss = F.when(F.col("loss_length").isNotNull(), trainable(F.col("formatted"), F.col("loss_start"), F.col("loss_length")))
    whole = formatted.select("conv_id", "example", "formatted", loss.alias("loss")).groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"),
        F.sum(F.length("formatted")).alias("formatted_chars"))
    read = whole.select("conv_id", "formatted_chars", read_turns(F.col("longest")).alias("turns"), F.array_join(F.col("losses.loss"), "").alias("loss"))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(F.transform("turns", line), ""), "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars")


def op4(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-1).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit("</s>[INST] ok [/INST]"))
    return digests(examples(turns.union(odd)))


# The template's lengths: a turn adds 24 code points to its escaped role and text.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(role, '\\*(?:</?s>|\[/?INST\])', '\\\0', 'g')) + length(regexp_replace(text, '\\*(?:</?s>|\[/?INST\])', '\\\0', 'g')) + 24 AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place, count(*) OVER (PARTITION BY conv_id) AS n
  FROM t
), s AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM e
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR place = n) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
