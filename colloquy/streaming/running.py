"""Running counts and bursts over a stream of delivered messages. These go beyond what a single transcript offers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as T


def deduplicated(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each message once within the watermark; state is dropped after ``delay``."""
    return messages.withColumn("received_at", F.to_timestamp("received_at")).withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["msg_id"])


def counts(messages: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Messages, users' messages and estimated tokens per window of receipt."""
    rows = deduplicated(messages, delay).where(F.col("role").isin(*T.ROLES) & F.col("text").isNotNull())
    return rows.groupBy(F.window("received_at", window)).agg(
        F.count("*").alias("messages"), F.sum((F.col("role") == "user").cast("bigint")).alias("user_messages"), F.sum(T.token_estimate(F.length("text"))).alias("tokens")
    ).select(F.col("window.start").alias("start"), "messages", "user_messages", "tokens")
