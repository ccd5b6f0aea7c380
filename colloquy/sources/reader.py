"""Conversations from files of any known format, as DataFrames, and as the data source ``chat``."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from colloquy.common import python_partitions
from colloquy.sources import formats

SCHEMA = "path string, status string, source_kind string, title string, fingerprint string, created_at double, updated_at double, raw_node_count int, idx int, role string, text string"
ARROW = pa.schema([("path", pa.string()), ("status", pa.string()), ("source_kind", pa.string()), ("title", pa.string()), ("fingerprint", pa.string()), ("created_at", pa.float64()), ("updated_at", pa.float64()), ("raw_node_count", pa.int32()), ("idx", pa.int32()), ("role", pa.string()), ("text", pa.string())])


def rows_of(path: str, data: bytes | None) -> list[tuple]:
    """A row per message; one row with the error's code as status for a file that can't be read."""
    data = data or b""
    mark = hashlib.sha256(data).hexdigest()[:16]
    try:
        p = formats.parse(path, data)
    except formats.FormatError as e:
        return [(path, e.code, None, None, mark, None, None, None, None, None, None)]
    return [(path, "ok", p.kind, p.title, mark, p.created_at, p.updated_at, p.nodes, i, r, t) for i, (r, t) in enumerate(p.messages)]


def parsed(files: DataFrame) -> DataFrame:
    """files: path and content (binary). One bad file gives one status row and harms no other."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in rows_of(path, data)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW.types)] if rows else [pa.array([], t) for t in ARROW.types], schema=ARROW)

    return python_partitions(files.select("path", F.col("content").cast("binary").alias("content"))).mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a path, whatever its format."""
    return parsed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class ChatReader(DataSourceReader):
    #: Bytes of files read by one task.
    BYTES = 64 << 20

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        """Files packed by size; names and sizes are listed, no content is read."""
        import os

        root, found = self.options["path"], []
        stack = [root]
        while stack:
            with os.scandir(stack.pop()) if not os.path.isfile(root) else _one(root) as entries:
                for e in entries:
                    if e.is_dir(follow_symlinks=False):
                        stack.append(e.path)
                    elif e.is_file():
                        found.append((e.path, e.stat().st_size))
        packs, held = [[]], 0
        for path, size in sorted(found):
            if packs[-1] and held + size > self.BYTES:
                packs.append([])
                held = 0
            packs[-1].append(path)
            held += size
        return [Files(p) for p in packs if p]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            with open(path, "rb") as f:
                yield from rows_of(path, f.read())


def _one(path: str):
    """A listing of one file, like that of its folder."""
    import contextlib
    import os

    @contextlib.contextmanager
    def listing():
        with os.scandir(os.path.dirname(path) or ".") as entries:
            yield [e for e in entries if e.name == os.path.basename(path)]

    return listing()


class ChatSource(DataSource):
    """``spark.read.format("chat").load(path)``, after ``spark.dataSource.register(ChatSource)``; for shared file systems."""

    @classmethod
    def name(cls) -> str:
        return "chat"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ChatReader(self.options)
