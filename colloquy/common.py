"""Small helpers shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpointed(frame: DataFrame) -> DataFrame:
    """``frame`` written to the shared checkpoint folder, with its lineage cut.

    The folder is the session's ``spark.checkpoint.dir``, which all executors share.
    Only a local session, which has no other machines, may do without: it gets a folder below its warehouse.
    """
    spark = frame.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = sc.getConf().get("spark.checkpoint.dir")
        if not place:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            place = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints-{uuid.uuid4().hex}"
        sc.setCheckpointDir(place)
    return frame.checkpoint(eager=True)


def python_partitions(frame: DataFrame, per_core: int = 2) -> DataFrame:
    """Spread a small, coarse scan over the cluster before a Python stage.

    A table that arrives as one file of one row group is one task; a round-robin exchange
    costs one pass over its bytes and is only added while the scan has fewer partitions than cores.
    The rows are the same either way.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    if frame.rdd.getNumPartitions() >= cores:
        return frame
    return frame.repartition(cores * per_core)


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """``frame`` hashed by ``keys`` over all shuffle partitions before a Python stage.

    Adaptive execution merges small partitions by their bytes, which would leave work in Python, heavy for its bytes, on few cores.
    """
    spark = frame.sparkSession
    return frame.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)
