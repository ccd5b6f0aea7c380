"""The registered queries of this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.common import table
from colloquy.llm import conversations, mixing, pairs, pii, spam, splitting, tokenizer

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.found(table(spark, sf, "canonical_messages"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.rebuilt(table(spark, sf, "message_rows"))


def _pii_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf, "canonical_messages"), table(spark, sf, "gemini_activity"), table(spark, sf, "name_list")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.found(*_pii_tables(spark, sf))


def p3_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return pii.redacted(*_pii_tables(spark, sf))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.found(table(spark, sf, "canonical_messages"), table(spark, sf, "checkpoint_report"))


def p6_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split(splitting.oversized(table(spark, sf, "canonical_messages"), table(spark, sf, "checkpoint_report")))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenizer.encoded(table(spark, sf, "documents"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p8_invariants(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.invariants(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return spam.found(table(spark, sf, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_redacted, p6_found, p6_pieces, p7_ids, p8_mix, p8_shares, p8_invariants, p9_found)}

SQL: dict[str, str] = {"p2_found": conversations.FOUND_SQL, "p6_found": splitting.FOUND_SQL, "p8_invariants": "SELECT DISTINCT source, true AS within_cap, true AS own_documents, true AS target_kept FROM mix_targets WHERE source IS NOT NULL"}
