"""Chat formatting: every participant's view of a dialogue.

For each participant of a conversation (each distinct speaker but the system) the whole dialogue is
rendered once, with that speaker as the assistant and all others as named users; the loss mask covers
what that speaker says. The rendered view is kept turn by turn, with its place in the view, so a
conversation of any length is never one row nor one group: places come from sums over blocks of turns.

A view is the concatenation of its segments in ``position`` order; a segment is::

    <|assistant|>\\n{text}\\n<|end|>\\n     <|user name="x"|>\\n{text}\\n<|end|>\\n     <|system|>\\n{text}\\n<|end|>\\n

``mask_start`` and ``mask_end`` delimit the characters to learn (text and ``<|end|>``) in the view;
both are null where the segment is not the participant's.

Nothing in a text or name can pass for a marker: in texts a backslash is put before the ``|`` of ``<|`` (and one
more where there are some), and marks in names are written as ``%`` and their code, so different names stay different.

Defined results: a null text is the empty text; a null or empty speaker is named ``unknown``; an empty table gives
no rows; rows without a conversation are dropped; turns without a number come last; equal numbers are ordered by speaker
and text, and repeated rows stay repeated; a conversation of system turns only has no view; extra
columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "\n<|end|>\n"
#: Turns of a block, within which places are summed in order.
BLOCK = 512


# Characters that names cannot hold, and what is written for them; the first must come first.
CODES = (("%", "%25"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("|", "%7C"), ("\n", "%0A"))


def _name(name: Column) -> Column:
    for mark, code in CODES:
        name = F.replace(name, F.lit(mark), F.lit(code))
    return name


def _text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def views(turns: DataFrame, speaker: str = "role", system: str = "system") -> DataFrame:
    """``conv_id, participant, position, turn, is_target, segment, view_start, mask_start, mask_end``
    from rows ``conv_id, turn, <speaker>, text``. ``view_start`` counts characters from the view's start."""
    name = F.coalesce(F.when(F.trim(F.col(speaker)) != "", F.col(speaker)), F.lit("unknown"))
    t = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), name.alias("speaker"), _text(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    t = t.filter("conv_id is not null").withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit((1 << 62))).cast("long"))
    who = t.filter(F.col("speaker") != system).select("conv_id", F.col("speaker").alias("participant")).distinct()
    v = t.join(who, "conv_id").withColumn("is_target", F.col("speaker") == F.col("participant"))
    head = F.when(F.col("is_target"), F.lit("<|assistant|>\n")).when(F.col("speaker") == system, F.lit("<|system|>\n"))
    head = head.otherwise(F.concat(F.lit('<|user name="'), _name(F.col("speaker")), F.lit('"|>\n')))
    v = v.withColumn("head", head).withColumn("segment", F.concat("head", "text", F.lit(END)))
    v = v.withColumns({"n": F.length("segment").cast("long"), "n_head": F.length("head").cast("long")})

    view = ["conv_id", "participant"]
    sums = v.groupBy(*view, "block").agg(F.sum("n").alias("chars"), F.count("*").alias("turns"))
    before = Window.partitionBy(*view).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*view, "block", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"), F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("turns_before"))
    inside = Window.partitionBy(*view, "block").orderBy(F.col("turn").asc_nulls_last(), "speaker", "text")
    v = v.withColumns({"row": F.row_number().over(inside), "upto": F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    v = v.join(sums, [*view, "block"])
    start = F.col("chars_before") + F.col("upto") - F.col("n")
    target = lambda x: F.when(F.col("is_target"), x)
    return v.select(
        "conv_id", "participant", (F.col("turns_before") + F.col("row") - 1).cast("long").alias("position"), "turn", "is_target", "segment",
        start.alias("view_start"), target(start + F.col("n_head")).alias("mask_start"), target(start + F.col("n") - 1).alias("mask_end"),
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, CASE WHEN trim(role) <> '' THEN role ELSE 'unknown' END AS speaker, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), who AS (
  SELECT DISTINCT conv_id, speaker AS participant FROM t WHERE speaker <> 'system'
), v AS (
  SELECT t.conv_id, who.participant, t.turn, t.speaker = who.participant AS is_target, t.speaker, t.text,
    CASE WHEN t.speaker = who.participant THEN '<|assistant|>' || chr(10) WHEN t.speaker = 'system' THEN '<|system|>' || chr(10)
         ELSE '<|user name="' || replace(replace(replace(replace(replace(replace(t.speaker, '%', '%25'), '"', '%22'), '<', '%3C'), '>', '%3E'), '|', '%7C'), chr(10), '%0A') || '"|>' || chr(10) END AS head
  FROM t JOIN who ON t.conv_id = who.conv_id
), s AS (SELECT *, head || text || chr(10) || '<|end|>' || chr(10) AS segment FROM v
), p AS (
  SELECT *, row_number() OVER w - 1 AS position, CAST(sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) - length(segment) AS view_start
  FROM s WINDOW w AS (PARTITION BY conv_id, participant ORDER BY turn ASC NULLS LAST, speaker, text)
)
SELECT conv_id, participant, position, turn, is_target, segment, view_start,
  CASE WHEN is_target THEN view_start + length(head) END AS mask_start,
  CASE WHEN is_target THEN view_start + length(segment) - 1 END AS mask_end
FROM p
"""
