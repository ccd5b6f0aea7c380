"""Greedy chunks of messages and groups of notes by size, and resuming from a prefix of known hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import folds


def greedy(most: int):
    """A new chunk begins where a non-empty one would outgrow ``most``; a larger piece is its own chunk."""

    def step(state: object, size: object) -> tuple[object, int]:
        chunk, used = state or (0, None)
        if used is not None and used + size > most:
            return (chunk + 1, size), chunk + 1
        return (chunk, (used or 0) + size), chunk

    return step


def chunked(canon: DataFrame, most: int) -> DataFrame:
    """conv_id, idx, size (of its block, as compiling reads it) and the chunk of each message."""
    rows = canon.select("conv_id", "idx", T.block_length("idx", "role", "text").cast("bigint").alias("size"))
    return folds.running(rows, "conv_id", ["idx"], "size", greedy(most), "chunk")


def chunks(canon: DataFrame, most: int) -> DataFrame:
    """One row per chunk: its messages and characters."""
    return chunked(canon, most).groupBy("conv_id", "chunk").agg(F.count("*").alias("messages"), F.sum("size").alias("chars"), F.min("idx").alias("first_index"), F.max("idx").alias("last_index"))


def resume(old: DataFrame, new: DataFrame) -> DataFrame:
    """Where work on a conversation goes on: after the old hashes if they are a prefix of the new ones, else at 0.

    old and new are conv_id, idx, hash. Prefixes are compared row by row by a join on the place, so no list is built.
    """
    same = old.alias("o").join(new.alias("n"), ["conv_id", "idx"], "left").select("conv_id", F.col("n.hash").eqNullSafe(F.col("o.hash")).alias("same"))
    known = same.groupBy("conv_id").agg(F.count("*").alias("known"), F.bool_and("same").alias("prefix"))
    sizes = new.groupBy("conv_id").agg(F.count("*").alias("messages"))
    start = F.when(F.col("prefix"), F.col("known")).otherwise(0)
    return sizes.join(known, "conv_id", "left").select("conv_id", "messages", F.coalesce(start, F.lit(0)).cast("bigint").alias("start"), F.coalesce(F.col("prefix"), F.lit(False)).alias("resumed"))
