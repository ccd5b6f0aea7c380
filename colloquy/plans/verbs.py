"""One function per task over a folder of files of any known format, each a DataFrame keyed by ``conv_id`` or a list of files for ``sinks.write_files``.

A conversation is a file; its key is the hash of its path, and :func:`paths` tells which is which. Files that can't be read appear in :func:`inspect` with their status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import checkpoint as checkpoints
from colloquy.operators import compile as compiling
from colloquy.operators import conformance, integrity, privacy
from colloquy.sources import reader, sinks

KEY = F.xxhash64("path").alias("conv_id")


def opened(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The messages and the headers of the readable files."""
    rows = reader.read(spark, path).where("status = 'ok'")
    canon = rows.select(KEY, "idx", "role", "text", T.normalized("text").alias("norm"))
    heads = rows.where("idx = 0").select(KEY, "path", "title", "source_kind", "fingerprint", "created_at", "updated_at", "raw_node_count", F.lit(None).cast("timestamp_ntz").alias("imported_at"))
    return canon, heads


def paths(spark: SparkSession, path: str) -> DataFrame:
    return opened(spark, path)[1].select("conv_id", "path")


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """Status, integrity and secret counts of each file."""
    canon, _ = opened(spark, path)
    files = reader.read(spark, path).select(KEY, "path", "status", "source_kind").distinct()
    return files.join(integrity.report(canon), "conv_id", "left").join(privacy.counts(canon), "conv_id", "left")


def verify(spark: SparkSession, path: str, show_tail: bool = False) -> DataFrame:
    canon, _ = opened(spark, path)
    out = integrity.report(canon)
    return out.join(integrity.tails(canon), "conv_id") if show_tail else out


def conform(spark: SparkSession, path: str) -> DataFrame:
    canon, heads = opened(spark, path)
    return conformance.report(canon.withColumn("msg_id", F.col("idx").cast("long")), heads)


def smoke(spark: SparkSession, path: str) -> DataFrame:
    """Whether each file conforms, and nothing else."""
    return conform(spark, path).select("conv_id", "conforms")


def extract(spark: SparkSession, path: str) -> DataFrame:
    canon, heads = opened(spark, path)
    return sinks.standard_files(canon, heads.select("conv_id", "title")).where("path not like '%.aicb'")


def redact(spark: SparkSession, path: str) -> DataFrame:
    return sinks.redaction_files(opened(spark, path)[0])


def bundle(spark: SparkSession, path: str) -> DataFrame:
    canon, heads = opened(spark, path)
    return sinks.documents(canon, heads.select("conv_id", "title")).where("path like '%.aicb'")


def checkpoint(spark: SparkSession, path: str, budget: int | None = None, profile: str | None = None) -> DataFrame:
    canon, heads = opened(spark, path)
    return sinks.checkpoint_files(canon, checkpoints.selected(canon, heads.select("conv_id", "source_kind"), budget, profile))


def compile(spark: SparkSession, path: str, backend: str, map_model: str = "", final_model: str = "", **options) -> DataFrame:
    canon, heads = opened(spark, path)
    final = compiling.compiled(canon, backend, heads.select("conv_id", "title"), map_model, final_model, **options)
    return sinks.compile_files(final, compiling.mapped(canon, backend, map_model, options.get("chunk_chars", 120_000)))
