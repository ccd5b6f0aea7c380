"""Words of a text, and the longest common subsequence of two."""

from __future__ import annotations

import re
from collections.abc import Sequence

WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+(?:['’][^\W_]+)*")


def words(text: str) -> list[str]:
    return WORD.findall(text.casefold().replace("’", "'"))


def places_of(a: Sequence[str]) -> dict[str, int]:
    """The places of each word, as bits."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    return places


def common_subsequence(a: Sequence[str], b: Sequence[str], places: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, a row of bits at a time; places: those of ``a``, if at hand."""
    if not a or not b:
        return 0
    if places is None:
        places = places_of(a)
    full = row = (1 << len(a)) - 1
    for w in b:
        if m := places.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def shingles(t: Sequence[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}


def containment(a: set, b: set) -> float:
    """The share of ``a`` that lies in ``b``."""
    return len(a & b) / len(a) if a else 0.0
