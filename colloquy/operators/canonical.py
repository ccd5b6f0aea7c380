"""The canonical stream: usable messages in order, densely numbered.

Messages are spread by conversation and block of ``BLOCK`` indices, so a conversation with a third of all messages is many groups.
They are numbered within their block; only conversations that reach a second block need the counts of earlier blocks added, and those are
found from the index column alone, so ordinary tables pay one exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.common import spread
from colloquy.functions import text as T

BLOCK = 4096
LAST = 2**31 - 1  # where messages without index go


def delivered_once(messages: DataFrame) -> DataFrame:
    """conv_id, block, msg_id, idx, role, text of each message with a role, a text and a conversation, once."""
    rows = messages.select("conv_id", "msg_id", "idx", "role", "text").where(F.col("role").isin(*T.ROLES) & F.col("text").isNotNull() & F.col("conv_id").isNotNull())
    rows = rows.withColumn("block", F.floor(F.coalesce("idx", F.lit(LAST)) / BLOCK))
    return spread(rows, "conv_id", "block").dropDuplicates(["conv_id", "block", "msg_id"])  # patterns over texts follow, heavy for their bytes


def canonical(messages: DataFrame) -> DataFrame:
    """conv_id, idx, role, text, norm of the messages that have a role and a text; idx counts those kept, from 0.

    Null and blank texts, other roles and null conversations are dropped; messages without index come last; ties of idx go by msg_id.
    """
    rows = delivered_once(messages).withColumn("norm", T.normalized("text")).where("norm <> ''")
    inside = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_last("idx"), "msg_id")
    rows = rows.withColumn("nth", F.row_number().over(inside))
    long = messages.where((F.col("idx") >= BLOCK) | F.col("idx").isNull()).select("conv_id").distinct()
    counts = rows.join(long, "conv_id", "left_semi").groupBy("conv_id", "block").agg(F.max("nth").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("conv_id", "block", F.sum("n").over(before).alias("base")).where("base > 0")
    numbered = rows.join(bases, ["conv_id", "block"], "left")
    return numbered.select("conv_id", (F.col("nth") - 1 + F.coalesce("base", F.lit(0))).cast("int").alias("idx"), "role", "text", "norm")


SQL = f"""
base AS (SELECT DISTINCT msg_id, conv_id, idx AS place, role, text FROM canonical_messages WHERE role IN ('user', 'assistant') AND text IS NOT NULL AND conv_id IS NOT NULL),
normed AS (SELECT *, {T.normalized_sql('text')} AS norm FROM base),
canon AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY place NULLS LAST, msg_id) - 1 AS INTEGER) AS idx, role, text, norm FROM normed WHERE norm <> '')
"""
