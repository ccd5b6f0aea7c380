"""Counts, hashes and digests of conversations, and reviews of their order.

The digest of a conversation is one SHA-256 over all its message hashes in order, so it can't be merged from parts. It is folded
over sorted rows with a running hash, together with the counts and the first and last hashes: a conversation of any length takes constant memory,
none is collected, and all of a report comes from one exchange.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import folds


def hashed(canon: DataFrame) -> DataFrame:
    return canon.withColumn("hash", T.message_hash("role", "norm"))


class Digest:
    """A digest over hashes in order."""

    def __init__(self) -> None:
        self.state = None

    def add(self, value: str) -> None:
        if self.state is None:
            self.state = hashlib.sha256(value.encode())
        else:
            self.state.update(b"\n" + value.encode())

    def rows(self) -> list[tuple]:
        return [(self.state.hexdigest(),)]


class Report:
    """Counts, digest, first and last hashes, and the last hash of each role."""

    SCHEMA = "message_count long, user_count long, assistant_count long, conversation_digest string, first_message_hash string, last_message_hash string, last_user_hash string, last_assistant_hash string"

    def __init__(self) -> None:
        self.digest, self.count, self.first, self.last = Digest(), 0, None, None
        self.roles: dict[str, tuple[int, str]] = {}

    def add(self, role: str, value: str) -> None:
        self.digest.add(value)
        self.count += 1
        self.first, self.last = self.first or value, value
        self.roles[role] = (self.roles.get(role, (0, ""))[0] + 1, value)

    def rows(self) -> list[tuple]:
        of = {role: self.roles.get(role, (0, None)) for role in T.ROLES}
        return [(self.count, of["user"][0], of["assistant"][0], *self.digest.rows()[0], self.first, self.last, of["user"][1], of["assistant"][1])]


def digests(rows: DataFrame) -> DataFrame:
    """conv_id and the digest over ``hash`` in the order of ``idx``."""
    return folds.folded(rows, "conv_id", ["idx"], ["hash"], Digest, "conversation_digest string")


def report(canon: DataFrame) -> DataFrame:
    """One row per conversation."""
    return folds.folded(hashed(canon), "conv_id", ["idx"], ["role", "hash"], Report, Report.SCHEMA)


def sequence(canon: DataFrame) -> DataFrame:
    """Neighbours of one role, first and last roles, first and last index of each role.

    Neighbours are compared within blocks of indices, and where two blocks meet by the blocks' ends.
    """
    order = Window.partitionBy("conv_id", "block").orderBy("idx")
    rows = canon.select("conv_id", "idx", "role", F.shiftright("idx", folds.BLOCK_BITS).alias("block"))
    rows = rows.withColumn("same", (F.lag("role").over(order) == F.col("role")).cast("int"))
    at = lambda role: F.when(F.col("role") == role, F.col("idx"))
    blocks = rows.groupBy("conv_id", "block").agg(
        F.coalesce(F.sum("same"), F.lit(0)).alias("same"), F.min_by("role", "idx").alias("first"), F.max_by("role", "idx").alias("last"),
        *[f(at(r)).alias(f"{n}_{r}") for r in T.ROLES for n, f in (("first", F.min), ("last", F.max))],
    )
    joint = (F.lag("last").over(Window.partitionBy("conv_id").orderBy("block")) == F.col("first")).cast("int")
    return blocks.withColumn("joint", F.coalesce(joint, F.lit(0))).groupBy("conv_id").agg(
        F.sum(F.col("same") + F.col("joint")).cast("bigint").alias("same_role_transitions"), F.min_by("first", "block").alias("first_role"), F.max_by("last", "block").alias("last_role"),
        F.min("first_user").alias("first_user_index"), F.max("last_user").alias("last_user_index"), F.min("first_assistant").alias("first_assistant_index"), F.max("last_assistant").alias("last_assistant_index"),
    )


def tails(canon: DataFrame) -> DataFrame:
    """The last text of each role."""
    last = lambda role: F.max_by("text", F.when(F.col("role") == role, F.col("idx")))
    return canon.groupBy("conv_id").agg(last("user").alias("last_user_text"), last("assistant").alias("last_assistant_text"))


def tokens(canon: DataFrame, titles: DataFrame) -> DataFrame:
    """Token estimates of the source in two forms, of which each is rounded up once, and the share of the first in the second.

    The first is the normalised text behind its role, line by line; the second the title and the blocks that compiling reads. titles: conv_id, title.
    """
    size = F.length("norm") + F.length("role") + 3
    rows = canon.groupBy("conv_id").agg((F.sum(size) + F.count("*") - 1).alias("chars"), F.sum(T.block_length("idx", "role", "text")).alias("block_chars"), F.max(F.length("norm")).cast("bigint").alias("longest"))
    head = F.when(F.coalesce("title", F.lit("")) != "", F.length("title") + 3).otherwise(0)
    rows = rows.join(titles, "conv_id", "left").withColumn("block_chars", F.col("block_chars") + head)
    return rows.select("conv_id", T.token_estimate("chars").alias("source_tokens"), T.token_estimate("block_chars").alias("block_tokens"), T.token_estimate("longest").alias("longest_tokens")).withColumn("ratio", F.try_divide(F.col("source_tokens"), F.col("block_tokens")))


def compared(recorded: DataFrame, computed: DataFrame, fields: list[str]) -> DataFrame:
    """Recorded and recomputed reports side by side: whether each field agrees, null equal to null."""
    joined = recorded.alias("a").join(computed.alias("b"), "conv_id", "left")
    agree = [F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")) for f in fields]
    same = agree[0]
    for a in agree[1:]:
        same = same & a
    return joined.select("conv_id", *[x.alias(f"{f}_agrees") for f, x in zip(fields, agree)], same.alias("consistent"))
