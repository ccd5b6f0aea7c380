"""Secret counts and redaction of a single text in Python, for files that are read whole; the patterns are those of the columns."""

from __future__ import annotations

import re
from functools import reduce

from colloquy.functions import text as T

PATTERNS = {name: re.compile(plain) for name, _, plain in T.SECRETS}
KEY_BLOCK = re.compile(T.KEY_BLOCK.replace(r"\z", r"\Z"))


def counts(text: str) -> dict[str, int]:
    return {name: sum(1 for _ in pattern.finditer(text)) for name, pattern in PATTERNS.items()}


def redacted(text: str) -> tuple[str, dict[str, int]]:
    """The normalised text after every step of the table, and what each step has replaced; a step reads what the one before has left."""

    def step(state: tuple[str, dict[str, int]], entry: tuple[str, re.Pattern]) -> tuple[str, dict[str, int]]:
        left, n = entry[1].subn(T.REDACTED.format(entry[0]), state[0])
        return left, {**state[1], entry[0]: n}

    left, done = reduce(step, [(T.KEY_MATERIAL, KEY_BLOCK), *PATTERNS.items()], (text, {}))
    return T.normalized_text(left), done
