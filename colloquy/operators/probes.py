"""Looking into nested JSON of any schema: does a value occur, in which records, and what does the place look like without its content.

Documents are read as a stream of tokens (:mod:`colloquy.operators.nested`) without recursion, so neither depth nor size is bounded. Keys count as values.
Provider records are the outermost objects of a provider's form that hold a value; a minimal context is an innermost object that holds two values.
Sanitised structures keep keys, short structural words and the sought values, and nothing else.

Defined results: unreadable documents have status ``unreadable`` and no rows of their own; empty needles occur nowhere; a JSON Lines file is a document per
readable line; repeated keys count each, as an ambiguity must show.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.common import python_partitions
from colloquy.operators.nested import events

#: Words that are kept as they stand, as they say something about structure and nothing about content.
STRUCTURAL = frozenset("user assistant human system tool model text message messages content conversation request response true false null json markdown plain".split())
SUSPICIOUS_KEY = re.compile(r"@|[0-9a-f]{16,}|[0-9a-f]{8}-[0-9a-f]{4}-|token|secret|session|password|https?:|[\x00-\x1f]", re.I)
LONGEST_KEY = 120
# The forms of provider records: keys of which one must be there, and whether it must be a list (fixed values).
PROVIDERS = {"claude": (("chat_messages",), True), "gemini": (("header", "products", "safeHtmlItem"), False)}


def contains(text: str, needles: Iterable[str]) -> bool:
    """Whether a key or a string anywhere in a JSON text contains one of the needles; ValueError if it is no JSON."""
    wanted, hit = [n for n in needles if n], False
    for kind, value in events(text):
        hit = hit or kind in "ks" and any(n in value for n in wanted)
    return hit


class Node:
    """An open container on the way through a document."""

    __slots__ = ("start", "counts", "keys", "inner", "is_object", "key")

    def __init__(self, start: int, is_object: bool, needles: int):
        self.start, self.is_object, self.key = start, is_object, None
        self.counts, self.keys, self.inner = [0] * needles, {}, []


def spans(text: str, needles: list[str]) -> Iterator[tuple[int, int, dict[str, str], list[int], list[tuple[int, int]]]]:
    """Start and end event, kinds of the keys' values, counts of the needles and the contexts inside, of each object as it closes."""
    stack: list[Node] = []
    for at, (kind, value) in enumerate(events(text)):
        if kind in "{[":
            if stack and stack[-1].is_object:
                stack[-1].keys[stack[-1].key] = kind
            stack.append(Node(at, kind == "{", len(needles)))
        elif kind in "}]":
            node = stack.pop()
            if node.is_object:
                if all(node.counts) and not node.inner:
                    node.inner = [(node.start, at)]
                yield node.start, at, node.keys, node.counts, node.inner
            if stack:
                stack[-1].counts = [a + b for a, b in zip(stack[-1].counts, node.counts)]
                stack[-1].inner += node.inner
        else:
            if stack:
                if kind == "k":
                    stack[-1].key = value
                elif stack[-1].is_object:
                    stack[-1].keys[stack[-1].key] = kind
                if kind in "ks":
                    for i, n in enumerate(needles):
                        stack[-1].counts[i] += value.count(n) if n else 0


def records(text: str, provider: str, needle: str) -> list[tuple[int, int]]:
    """The outermost objects of the provider's form that hold the needle, as their first and last event."""
    keys, listed = PROVIDERS[provider]
    found = [(a, b) for a, b, own, counts, _ in spans(text, [needle]) if counts[0] and any(k in own and (not listed or own[k] == "[") for k in keys)]
    return [(a, b) for a, b in found if not any(c < a and b < d for c, d in found)]


def contexts(text: str, first: str, second: str) -> list[tuple[int, int]]:
    """The innermost objects that hold both values."""
    out: list[tuple[int, int]] = []
    for *_, inner in spans(text, [first, second]):
        out += inner
    return sorted(set(out))


def safe_key(key: str, hidden: int, needles: Iterable[str]) -> str:
    if not key or len(key) > LONGEST_KEY or SUSPICIOUS_KEY.search(key) or any(n in key for n in needles):
        return f"<redacted-key-{hidden}>"
    return key


def sanitised(text: str, span: tuple[int, int] | None, needles: list[str]) -> str:
    """The structure of a document, or of a span of its events, as JSON without content: numbers, strings and suspicious keys are hidden, structural words and the needles stay."""
    out: list[str] = []
    hidden: list[int] = []
    seen: list[set[str]] = []
    comma = False
    for at, (kind, value) in enumerate(events(text)):
        if span and not span[0] <= at <= span[1]:
            continue
        if kind in "}]":
            out.append(kind)
            if kind == "}":
                hidden.pop()
                seen.pop()
            comma = True
            continue
        if comma:
            out.append(", ")
        comma = kind not in "{[k"
        if kind in "{[":
            out.append(kind)
            if kind == "{":
                hidden.append(0)
                seen.append(set())
        elif kind == "k":
            name = safe_key(value, hidden[-1] + 1, needles)
            hidden[-1] += name.startswith("<redacted-key-")
            while name in seen[-1]:
                hidden[-1] += 1
                name = f"<redacted-key-{hidden[-1]}>"
            seen[-1].add(name)
            out.append(json.dumps(name, ensure_ascii=False) + ": ")
        elif kind == "s":
            held = " ".join(n for n in needles if n and n in value)
            out.append(json.dumps(held or (value if value in STRUCTURAL else "<redacted:string>"), ensure_ascii=False))
        else:
            out.append({"n": '"<redacted:number>"', "b": value, "-": "null"}[kind])
    return "".join(out)


def documents_of(path: str, content: str | None) -> Iterator[tuple[int, str | None]]:
    """Number and text of the documents of a file by its suffix; None for markup and other files, which are only counted."""
    suffix = path.rpartition(".")[2].lower()
    content = (content or "").removeprefix("﻿")
    if suffix in ("jsonl", "ndjson"):
        yield from ((i, line) for i, line in enumerate(x for x in content.splitlines() if x.strip()))
    else:
        yield 0, content if suffix == "json" else None


SCAN = "path string, document int, status string, first_count long, second_count long, contexts int, sanitised string"


def scan(files: DataFrame, first: str, second: str, most_chars: int | None = None, path: str = "path", content: str = "content") -> DataFrame:
    """One row per document of a file of unknown schema: how often both values occur and the sanitised minimal context if there is exactly one.

    A document of more than ``most_chars`` characters is an error in its row (``too_large``), never cut. HTML and other files have one row with status ``other``.
    """

    def judge(text: str | None) -> tuple:
        if text is None:
            return ("other", None, None, None, None)
        if most_chars is not None and len(text) > most_chars:
            return ("too_large", None, None, None, None)
        try:
            totals = [0, 0]
            for kind, value in events(text):
                if kind in "ks":
                    totals = [totals[0] + value.count(first), totals[1] + value.count(second)]
            found = contexts(text, first, second)
            return ("ok", *totals, len(found), sanitised(text, found[0], [first, second]) if len(found) == 1 else None)
        except ValueError:
            return ("unreadable", None, None, None, None)

    return mapped(files, path, content, lambda p, c: [(p, i, *judge(text)) for i, text in documents_of(p, c)], SCAN)


RECORDS = "path string, document int, record int, sanitised string"


def provider_records(files: DataFrame, provider: str, needle: str, path: str = "path", content: str = "content") -> DataFrame:
    """The sanitised provider records that hold a value; unreadable documents have none."""

    def rows(p: str, c: str | None) -> list[tuple]:
        out = []
        for i, text in documents_of(p, c):
            try:
                out += [(p, i, n, sanitised(text, span, [needle])) for n, span in enumerate(records(text, provider, needle))] if text is not None else []
            except ValueError:
                continue
        return out

    return mapped(files, path, content, rows, RECORDS)


def deep_contains(rows: DataFrame, key: str, column: str, needles: list[str]) -> DataFrame:
    """The key and whether a nested key or string of the JSON in ``column`` contains a needle; text that is no JSON is looked through as it stands."""

    def judge(k: object, text: str | None) -> list[tuple]:
        try:
            return [(k, contains(text or "null", needles))]
        except ValueError:
            return [(k, any(n and n in text for n in needles))]

    return mapped(rows, key, column, judge, f"{key} {rows.schema[key].dataType.simpleString()}, found boolean")


def mapped(rows: DataFrame, key: str, column: str, judge: Callable[[object, str | None], list[tuple]], schema: str) -> DataFrame:
    from colloquy.operators.folds import arrow_types

    names, types = arrow_types(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [row for k, text in zip(*(c.to_pylist() for c in batch.columns)) for row in judge(k, text)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * len(names), types)], names)

    return python_partitions(rows.select(key, F.col(column).cast("string").alias(column))).mapInArrow(run, schema)
