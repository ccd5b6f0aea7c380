"""Encoding with a public byte-level byte-pair vocabulary.

Pre-tokens are found by the vocabulary's pattern. Each is encoded by a priority queue of merge ranks over a
doubly linked list of symbols: the lowest rank, then the leftmost pair, merges first, and entries whose
symbols have changed since are skipped. A pre-token of n bytes takes O(n log n), so a long run of one
character costs no more than ordinary text. Pre-tokens seen before are looked up in a bounded memory of each
worker, which changes only speed. Decoding joins the vocabulary's byte strings.

Defined results: null and empty texts have no ids; strings that look like special tokens are plain text; every document
gives one row.
"""

from __future__ import annotations

import base64
import heapq
import os
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.common import python_partitions

#: Where the vocabulary files are; a parameter of every entry below.
FOLDER = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")
NAME = "byte_bpe_50k"
#: How pre-tokens are found (fixed value of this vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMORY = 400_000


class Encoder:
    """A byte-pair vocabulary given as the bytes of a rank file."""

    def __init__(self, ranks: bytes):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.find = regex.compile(PATTERN).findall
        self.seen: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return (whole,)
        n = len(data)
        part: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(rank, i, 2) for i in range(n - 1) if (rank := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, size = heapq.heappop(queue)
            left = part[i]
            if left is None or (j := after[i]) >= n or len(left) + len(part[j]) != size:
                continue  # stale: one of the two has merged since
            joined = part[i] = left + part[j]
            part[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := ranks.get(joined + part[k])) is not None:
                    heapq.heappush(queue, (rank, i, len(joined) + len(part[k])))
            if (h := before[i]) >= 0 and (rank := ranks.get(part[h] + joined)) is not None:
                heapq.heappush(queue, (rank, h, len(part[h]) + len(joined)))
        return tuple(ranks[p] for p in part if p is not None)

    def ids_of(self, token: str) -> tuple[int, ...]:
        if len(self.seen) > MEMORY:
            self.seen.clear()
        ids = self.merge(token.encode("utf-8", "replace"))
        if len(token) <= 64:
            self.seen[token] = ids
        return ids

    def encode(self, text: str | None) -> array:
        out, seen = array("i"), self.seen
        for token in self.find(text or ""):
            out.extend(seen.get(token) or self.ids_of(token))
        return out

    def count(self, text: str | None) -> int:
        seen = self.seen
        return sum(len(seen.get(token) or self.ids_of(token)) for token in self.find(text or ""))

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


def rank_file(name: str = NAME, folder: str = FOLDER) -> bytes:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def encoder(ranks: bytes) -> Encoder:
    return Encoder(ranks)


def _shared(frame: DataFrame, name: str, folder: str):
    """The rank file as a broadcast: its size is that of the vocabulary, under 1 MB, whatever the data."""
    return frame.sparkSession.sparkContext.broadcast(rank_file(name, folder))


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = NAME, folder: str = FOLDER) -> DataFrame:
    """key and ids of each row."""
    ranks = _shared(documents, name, folder)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks.value)
        for batch in batches:
            ids, offsets = array("i"), array("i", [0])
            for t in batch.column(1).to_pylist():
                ids.extend(own.encode(t))
                offsets.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["key", "ids"])

    rows = python_partitions(documents.select(F.col(key).alias("key"), F.col(text).alias("text")))
    return rows.mapInArrow(run, f"key {documents.schema[key].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def counted(documents: DataFrame, keep: list[str], text: str = "text", name: str = NAME, folder: str = FOLDER) -> DataFrame:
    """The columns of keep and the number of tokens of each row."""
    ranks = _shared(documents, name, folder)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks.value)
        for batch in batches:
            counts = [own.count(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], [*keep, "tokens"])

    kinds = ", ".join(f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keep)
    return python_partitions(documents.select(*keep, F.col(text).alias("text_"))).mapInArrow(run, f"{kinds}, tokens long")
