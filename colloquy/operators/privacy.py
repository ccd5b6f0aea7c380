"""Secrets in conversations: counts, redaction and its review. Reports hold counts and hashes, never text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import folds, integrity

NAMES = [name for name, _, _ in T.SECRETS]
STEPS = [T.KEY_MATERIAL, *NAMES]


def counts(canon: DataFrame) -> DataFrame:
    """Counts of each secret over the joined text of each conversation, and whether there are none.

    Only a bearer token can lie across two messages, where one ends in the word and the next begins with the token; these joints
    are found from the neighbours' ends, within blocks of indices and where blocks meet, so the texts themselves are never joined.
    """
    opens = F.col("text").rlike(rf"(?iu)Bearer(?<!{T.WORD}Bearer){T.WS}*\z")
    begins = F.col("text").rlike(rf"^{T.WS}*[A-Za-z0-9._~+/-]{{20,}}")
    order = Window.partitionBy("conv_id", "block").orderBy("idx")
    rows = canon.select("conv_id", "idx", F.shiftright("idx", folds.BLOCK_BITS).alias("block"), opens.alias("opens"), begins.alias("begins"), *[T.secret_count("text", p).alias(n) for n, p, _ in T.SECRETS])
    rows = rows.withColumn("bearer_token", F.col("bearer_token") + (F.coalesce(F.lag("opens").over(order), F.lit(False)) & F.col("begins")).cast("bigint"))
    blocks = rows.groupBy("conv_id", "block").agg(*[F.sum(n).alias(n) for n in NAMES], F.min_by("begins", "idx").alias("begins"), F.max_by("opens", "idx").alias("opens"))
    joint = F.coalesce(F.lag("opens").over(Window.partitionBy("conv_id").orderBy("block")), F.lit(False)) & F.col("begins")
    out = blocks.withColumn("bearer_token", F.col("bearer_token") + joint.cast("bigint")).groupBy("conv_id").agg(*[F.sum(n).alias(n) for n in NAMES])
    total = sum((F.col(n) for n in NAMES[1:]), F.col(NAMES[0]))
    return out.withColumn("safe_to_share", total == 0)


def markers(rows: DataFrame, key: str, source: Column | str) -> DataFrame:
    """Counts of the runtime markers in a raw source."""
    return rows.select(key, *[T.secret_count(source, f"(?iu){m}").alias(m.lower().replace("-", "_")) for m in T.MARKERS])


def redacted(canon: DataFrame) -> DataFrame:
    """The redacted text of each message and the count of each step. Each step is a projection of its own, so no pattern runs twice."""
    rows = canon.withColumn("redacted", F.col("text"))
    for name, pattern in [(T.KEY_MATERIAL, T.KEY_BLOCK), *((n, p) for n, p, _ in T.SECRETS)]:
        rows = rows.withColumn(name, T.secret_count("redacted", pattern)).withColumn("redacted", F.regexp_replace("redacted", pattern, T.REDACTED.format(name)))
    return rows.withColumn("redacted", T.normalized("redacted"))


class Review:
    """Counts, totals of each step, what is left, and the digests before and after."""

    SCHEMA = "message_count long, " + ", ".join(f"{n} long" for n in STEPS) + ", affected_messages long, remaining long, source_digest string, redacted_digest string"

    def __init__(self) -> None:
        self.before, self.after = integrity.Digest(), integrity.Digest()
        self.count = self.affected = self.left = 0
        self.steps = [0] * len(STEPS)

    def add(self, source: str, after: str, left: int, *steps: int) -> None:
        self.before.add(source)
        self.after.add(after)
        self.count += 1
        self.left += left
        if any(steps):
            self.affected += 1
            self.steps = [a + b for a, b in zip(self.steps, steps)]

    def rows(self) -> list[tuple]:
        return [(self.count, *self.steps, self.affected, self.left, *self.before.rows()[0], *self.after.rows()[0])]


def review(canon: DataFrame) -> DataFrame:
    """Per conversation: digests before and after, totals, affected messages, and what a second scan still finds; one pass and one exchange of hashes and counts."""
    left = sum((T.secret_count("redacted", p) for _, p, _ in T.SECRETS[1:]), T.secret_count("redacted", T.SECRETS[0][1]))
    rows = redacted(canon).select("conv_id", "idx", T.message_hash("role", "norm").alias("source"), T.message_hash("role", "redacted").alias("after"), left.alias("left"), *STEPS)
    return folds.folded(rows, "conv_id", ["idx"], ["source", "after", "left", *STEPS], Review, Review.SCHEMA)


def evidence(canon: DataFrame) -> DataFrame:
    """One row per affected message: its place, the hash of the original and the counts."""
    rows = redacted(canon)
    affected = sum((F.col(n) for n in STEPS[1:]), F.col(STEPS[0])) > 0
    return rows.where(affected).select("conv_id", "idx", "role", T.message_hash("role", "norm").alias("source_message_sha256"), *STEPS)
