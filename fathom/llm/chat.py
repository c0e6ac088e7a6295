"""Chat formatting by multi-party perspective rotation, as DataFrame expressions.

Every speaker of a conversation gets a rendering of it: own turns as the assistant's, all other turns as those of named users, system
turns as such.  The mask marks what the assistant says, its end mark included, as spans of code points; the rest is context.

A conversation is one example.  ``turns`` cuts conversations that are too long for one value into examples of that many turn numbers;
a speaker who says nothing in an example has a rendering with an empty mask there.

Defined results: a null role is the speaker ``unknown``, a null text is empty, null turn numbers come first and belong to the first
example, rows of one turn number are ordered by role and text, repeated rows are turns of their own, rows without a conversation id are
one conversation; conversations with only system turns have no speaker and no rendering, an empty table has no rows.  Texts of any
length are rendered whole.  A mark inside a role or a text (``<|`` anywhere, ``|>`` in a role) gets a backslash between its two
characters, and one more if it has some already, so that no text can end its turn or begin another; taking one away gives the text
back.  Only the four named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CONTEXT = "system"
UNKNOWN = "unknown"
ASSISTANT = "<|assistant|>\n"
END = "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def head(role: Column) -> Column:
    """What opens a turn of any speaker but the assistant."""
    name = F.regexp_replace(escaped(role), r"\|(\\*)>", r"|\\$1>")
    return F.when(role == CONTEXT, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))


def rotate(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", turns: int | None = None) -> DataFrame:
    """(conv_id, example, speaker, rendered, mask) with mask as array of struct(start, stop)."""
    t = rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(UNKNOWN)).alias("role"), escaped(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    t = t.withColumn("example", F.lit(0).cast("long") if turns is None else F.coalesce(F.floor(F.col("turn") / turns), F.lit(0)).cast("long")).withColumn("head", head(F.col("role")))
    speakers = t.where(F.col("role") != CONTEXT).select("conv_id", F.col("role").alias("speaker")).distinct()
    # where a turn starts if nobody is the assistant; the assistant's own turns before it only change that by their heads
    before = Window.partitionBy("conv_id", "example").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("at", F.coalesce(F.sum(F.length("head") + F.length("text") + len(END)).over(before), F.lit(0)))
    parts = t.groupBy("conv_id", "example").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "at", "head"))).alias("said"))
    s, p = speakers.alias("s"), parts.alias("p")
    both = p.join(s, F.col("p.conv_id").eqNullSafe(F.col("s.conv_id"))).select("p.conv_id", "example", "speaker", "said")
    me = F.col("speaker")
    pieces = F.transform("said", lambda x: F.concat(F.when(x["role"] == me, F.lit(ASSISTANT)).otherwise(x["head"]), x["text"], F.lit(END)))

    def span(x: Column, own: Column) -> Column:
        start = x["at"] + own * (len(ASSISTANT) - F.length(x["head"])) + len(ASSISTANT)
        return F.struct(start.cast("int").alias("start"), (start + F.length(x["text"]) + len(END)).cast("int").alias("stop"))

    mask = F.transform(F.filter("said", lambda x: x["role"] == me), span)
    return both.select("conv_id", "example", "speaker", F.array_join(pieces, "").alias("rendered"), mask.alias("mask"))


def digest(rendered: DataFrame) -> DataFrame:
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return rendered.select("conv_id", "example", "speaker", F.length("rendered").cast("long").alias("n_chars"), F.size("mask").cast("long").alias("n_spans"), F.sha2("rendered", 256).alias("rendered_sha256"), spans.alias("mask"))


SQL = rf"""WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '{UNKNOWN}') AS role, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> '{CONTEXT}'),
x AS (SELECT t.conv_id, speaker, turn, role, text, CASE WHEN role = speaker THEN '<|assistant|>' || chr(10) WHEN role = '{CONTEXT}' THEN '<|system|>' || chr(10)
 ELSE '<|user name=' || regexp_replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') || '|>' || chr(10) END AS head FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
y AS (SELECT *, head || text || '<|end|>' || chr(10) AS piece FROM x),
z AS (SELECT *, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM y)
SELECT conv_id, CAST(0 AS BIGINT) AS example, speaker, CAST(sum(length(piece)) AS BIGINT) AS n_chars, count(*) FILTER (WHERE role = speaker) AS n_spans, sha256(string_agg(piece, '' ORDER BY turn NULLS FIRST, role, text)) AS rendered_sha256,
coalesce(string_agg(CAST(base + length(head) AS VARCHAR) || ':' || CAST(base + length(piece) AS VARCHAR), ',' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = speaker), '') AS mask
FROM z GROUP BY 1, 2, 3"""
