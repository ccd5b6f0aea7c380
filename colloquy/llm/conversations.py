"""Rebuilding conversations from loose message rows.

The rows are an event log: rows with the same conversation and index are versions of one turn, of which the
latest received, then the largest row id, holds (a create, its edits and its retries). The folded
turns are ordered by index, read for their speaker, and validated.

No conversation is ever collected. Turns are numbered in two levels: within blocks of indices,
and over the block counts, so a conversation of any size is spread over its blocks. Alternation needs no
neighbour either: a kept conversation has the user at every even place.

Defined results: a conversation with a null index, numbering not consecutive from 0 or 1, a holding row
without speaker, with an unknown one or with two that disagree is dropped as a whole, and so is one whose
user and assistant turns are blank, don't alternate, don't begin with user or don't end with assistant, or one of whose holding rows has no row_id.
Rows without conversation are dropped. Repeated rows fold into one; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A block is 4096 indices.
BLOCK_BITS = 12
USER, ASSISTANT, ASIDE = "user", "assistant", "aside"
#: Anything but white space, separators, and control and format characters.
NON_BLANK = r"[^\s\p{Z}\p{Cc}\p{Cf}]"


def speaker(column: Column) -> Column:
    """'' for none, '?' for an unknown one."""
    name = F.lower(F.regexp_replace(F.coalesce(column, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(name == "human", USER).when(name.isin("", USER, ASSISTANT, "system", "tool"), name).otherwise("?")


def folded(rows: DataFrame) -> DataFrame:
    """The holding version of each turn: conv_id, msg_index, row_id, speaker ('?' if it has no clear one), blank."""
    role, sender = speaker(F.col("role")), speaker(F.col("sender"))
    said = F.when(role == sender, role).when(role == "", sender).when(sender == "", role).otherwise("?")
    state = F.struct("received_at", "row_id", F.when(said == "", "?").otherwise(said).alias("said"), (~F.coalesce(F.col("text"), F.lit("")).rlike(NON_BLANK)).alias("blank"))
    newest = rows.where("conv_id is not null").groupBy("conv_id", "msg_index").agg(F.max(state).alias("v"))
    return newest.select("conv_id", "msg_index", "v.row_id", F.col("v.said").alias("said"), F.col("v.blank").alias("blank"))


def rebuilt(rows: DataFrame) -> DataFrame:
    """conv_id, pos, role, row_id of every turn of each whole conversation.

    The numbered turns are used twice, for the blocks' figures and for the result. Both uses read the same columns, so Spark makes
    the two exchanges behind them once.
    """
    turns = folded(rows).withColumn("block", F.shiftright(F.coalesce(F.col("msg_index"), F.lit(0)), BLOCK_BITS)).withColumn("turn", F.col("said").isin(USER, ASSISTANT).cast("int"))
    in_block = Window.partitionBy("conv_id", "block").orderBy("msg_index")
    turns = turns.withColumn("at", F.sum("turn").over(in_block) - F.col("turn"))
    off = lambda parity: F.sum(F.when((F.col("turn") == 1) & ((F.col("said") == USER) != ((F.col("at") + parity) % 2 == 0)), 1).otherwise(0))
    blocks = turns.groupBy("conv_id", "block").agg(
        F.count("*").alias("n"), F.sum("turn").alias("turns"), F.count("msg_index").alias("indexed"), F.min("msg_index").alias("low"), F.max("msg_index").alias("high"),
        F.sum((F.col("said") == "?").cast("int")).alias("unclear"), F.sum((F.col("blank") & (F.col("turn") == 1)).cast("int")).alias("blanks"),
        off(0).alias("off_even"), off(1).alias("off_odd"), F.count("row_id").alias("rows"),
    )
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy("conv_id")
    blocks = blocks.withColumn("start", F.coalesce(F.sum("turns").over(before), F.lit(0)))
    total = lambda c: F.sum(c).over(everywhere)
    first = F.min("low").over(everywhere)
    blocks = blocks.withColumn(
        "whole",
        (total("n") == total("indexed")) & (total("rows") == total("n")) & first.isin(0, 1) & (F.max("high").over(everywhere) - first + 1 == total("n")) & (total("unclear") == 0) & (total("blanks") == 0)
        & (total(F.when(F.col("start") % 2 == 0, F.col("off_even")).otherwise(F.col("off_odd"))) == 0) & (total("turns") > 0) & (total("turns") % 2 == 0),
    )
    kept = blocks.where("whole").select("conv_id", "block", "start")
    return turns.where("turn = 1 and not blank").join(kept, ["conv_id", "block"]).select("conv_id", (F.col("start") + F.col("at")).cast("int").alias("pos"), F.col("said").alias("role"), "row_id")


FOUND_SQL = r"""
WITH clean AS (
  SELECT *, CASE WHEN r = 'human' THEN 'user' ELSE r END AS r1, CASE WHEN s = 'human' THEN 'user' ELSE s END AS s1
  FROM (SELECT *, lower(regexp_replace(coalesce(role, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS r,
               lower(regexp_replace(coalesce(sender, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS s FROM message_rows WHERE conv_id IS NOT NULL)
), held AS (
  SELECT *, CASE WHEN r1 = s1 THEN r1 WHEN r1 = '' THEN s1 WHEN s1 = '' THEN r1 ELSE '?' END AS said,
         row_number() OVER (PARTITION BY conv_id, msg_index ORDER BY received_at DESC NULLS LAST, row_id DESC) AS version
  FROM clean
), turns AS (SELECT * FROM held WHERE version = 1),
numbered AS (
  SELECT conv_id FROM turns GROUP BY conv_id
  HAVING count(*) = count(msg_index) AND min(msg_index) IN (0, 1) AND max(msg_index) - min(msg_index) + 1 = count(*)
     AND bool_and(said IN ('user', 'assistant', 'system', 'tool'))
), spoken AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY msg_index) - 1 AS pos
  FROM turns WHERE conv_id IN (SELECT conv_id FROM numbered) AND said IN ('user', 'assistant')
), whole AS (
  SELECT conv_id FROM spoken GROUP BY conv_id
  HAVING count(*) % 2 = 0 AND bool_and(said = CASE WHEN pos % 2 = 0 THEN 'user' ELSE 'assistant' END)
     AND bool_and(regexp_matches(coalesce(text, ''), '[^\s\p{Z}\p{Cc}\p{Cf}]'))
)
SELECT conv_id, CAST(pos AS INTEGER) AS pos, said AS role, row_id FROM spoken WHERE conv_id IN (SELECT conv_id FROM whole)
"""
