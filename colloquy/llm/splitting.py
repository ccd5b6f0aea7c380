"""Splitting oversized texts at natural boundaries, with an overlap.

A token is four code points, so the prefix sums of token offsets are linear in the position; natural boundaries lie on
either side of white space and of the full stops and marks U+3002, U+FF01 and U+FF1F. Kinds of boundary (paragraph,
line, sentence, white space) are sorted arrays; a cut is the last boundary under the limit by binary search, of the
strongest kind in the last half of the piece. The next piece steps back by the overlap. Where no boundary is left under the
limit, the step back is shortened as far as it takes to reach one; only a run longer than the limit is cut hard.

Defined results: null and empty texts and texts within the limit are one piece; a null overlap is 0; an overlap of the
budget or more is taken as one token less than the budget; no limit means one piece; a report's limit below one token is none, and an error where it is given directly.
Repeated messages are split once. However many pieces a text has, they are made and handed on a few at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as T

CHARS = T.CHARS_PER_TOKEN
#: Characters of pieces handed on at once; a batch holds at least one piece.
BATCH_CHARS = 4_000_000

KINDS = [re.compile(p) for p in (r"\n\s*\n\s*", r"\n\s*", r"[.!?…]+[\"'»”’)\]]*\s+|[。！？]+", r"\s+|[。！？]")]


def boundaries(text: str) -> list[list[int]]:
    """Sorted places where a cut is natural, by kind from the strongest to the weakest; the last holds all."""
    kinds = [[m.end() for m in kind.finditer(text)] for kind in KINDS[:-1]]
    last: list[int] = []
    for m in KINDS[-1].finditer(text):
        if not last or last[-1] < m.start():
            last.append(m.start())
        last.extend(range(m.start() + 1, m.end()) if m.end() - m.start() > CHARS else ())
        if last[-1] < m.end():
            last.append(m.end())
    return [*kinds, last]


def under(places: list[int], low: int, limit: int) -> int | None:
    """The last place in (low, limit]."""
    i = bisect_right(places, limit)
    return places[i - 1] if i and places[i - 1] > low else None


def pieces(text: str | None, budget: int | None, overlap: int | None = None) -> Iterator[tuple[int, int, bool]]:
    """Start, end and whether the end is natural, of each piece."""
    if budget is None or not text or len(text) <= budget * CHARS:
        yield 0, len(text or ""), True
        return
    if budget < 1:
        raise ValueError("the limit is at least one token")
    size, back = budget * CHARS, min(max(overlap or 0, 0), budget - 1) * CHARS
    kinds, start, done = boundaries(text), 0, 0
    while len(text) - start > size:
        end = None
        for places in kinds[:-1]:
            end = end or under(places, max(done, start + size // 2), start + size)
        end = end or under(kinds[-1], done, start + size)
        if end is None:  # a shorter step back reaches the next boundary, if it is near enough
            i = bisect_right(kinds[-1], done)
            following = kinds[-1][i] if i < len(kinds[-1]) else len(text)
            if following - done <= size:
                start, end = following - size, following
        natural = end is not None
        end = end or max(start + size, done + 1)
        yield start, end, natural
        start, done = max(end - back, start + 1), end
    if done < len(text):
        yield start, len(text), True


def limits(reports: DataFrame) -> DataFrame:
    """conv_id, budget and overlap of the latest report (by created_at, then report_id) of each conversation that has a limit."""
    latest = reports.where("conv_id is not null").groupBy("conv_id").agg(F.max(F.struct("created_at", "report_id", "budget_tokens", "overlap_tokens", "profile")).alias("r"))
    profile: Column = F.lit(None).cast("int")
    for name, budget in T.PROFILES.items():
        profile = F.when(F.lower(F.trim("r.profile")) == name, budget).otherwise(profile)
    return latest.select("conv_id", F.coalesce("r.budget_tokens", profile).alias("budget"), F.coalesce("r.overlap_tokens", F.lit(0)).alias("overlap")).where("budget >= 1")


def oversized(messages: DataFrame, reports: DataFrame) -> DataFrame:
    """msg_id, text, budget and overlap of each message above the budget of its conversation.

    Which these are is found from ids and lengths alone. Then the texts above the smallest budget of all move once, by msg_id, so a
    conversation with a third of all messages is spread; the rest ends at the scan.
    """
    bounds = limits(reports)
    tokens = F.ceil(F.length("text") / CHARS)
    large = messages.where(tokens > bounds.agg(F.min("budget")).scalar())
    own = large.select("msg_id", "conv_id", tokens.alias("tokens")).join(bounds, "conv_id").where("tokens > budget").select("msg_id", "budget", "overlap").dropDuplicates(["msg_id"])
    return large.select("msg_id", "text").join(own, "msg_id").dropDuplicates(["msg_id"]).select("msg_id", "text", "budget", "overlap")


PIECES = "msg_id long, piece int, start int, end int, natural boolean, text string"


def split(rows: DataFrame, with_text: bool = True) -> DataFrame:
    """The pieces of rows of msg_id, text, budget and overlap."""
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for msg_id, text, budget, overlap in zip(*(c.to_pylist() for c in batch.columns)):
                for i, (s, e, n) in enumerate(pieces(text, budget, overlap)):
                    rows.append((msg_id, i, s, e, n, (text or "")[s:e] if with_text else None))
                    held += e - s if with_text else 64
                    if held >= BATCH_CHARS:
                        yield arrow(rows)
                        rows, held = [], 0
        yield arrow(rows)

    def arrow(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["msg_id", "piece", "start", "end", "natural", "text"])

    return rows.select("msg_id", "text", "budget", "overlap").mapInArrow(run, PIECES)


def found(messages: DataFrame, reports: DataFrame) -> DataFrame:
    cuts = split(oversized(messages, reports), with_text=False)
    return cuts.groupBy("msg_id").agg(F.when(F.bool_and("natural"), "natural").otherwise("forced").alias("cut"))


FOUND_SQL = """
WITH latest AS (
  SELECT conv_id, budget_tokens, profile, row_number() OVER (PARTITION BY conv_id ORDER BY created_at DESC NULLS LAST, report_id DESC) AS n FROM checkpoint_report WHERE conv_id IS NOT NULL
), bounds AS (
  SELECT conv_id, coalesce(budget_tokens, CASE lower(trim(profile)) WHEN 'lite' THEN 4000 WHEN 'standard' THEN 16000 WHEN 'full' THEN 64000 END) AS budget FROM latest WHERE n = 1
), large AS (
  SELECT DISTINCT msg_id, text, budget FROM canonical_messages JOIN bounds USING (conv_id) WHERE budget >= 1 AND ceil(length(text) / 4.0) > budget
)
SELECT msg_id, CASE WHEN list_max([length(x) FOR x IN regexp_split_to_array(text, '[\\s\\p{Z}\\x{85}\\x{1c}-\\x{1f}\\x{0b}。！？]')]) > 4 * budget THEN 'forced' ELSE 'natural' END AS cut FROM large
"""
