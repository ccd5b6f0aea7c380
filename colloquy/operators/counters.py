"""Token counters: by characters, by any function, by a public tokenizer's file, and by a service behind an injected call."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class CharacterCounter:
    """Nothing is 0 tokens, everything else at least 1: the characters by ``per_token``, rounded up. An estimate."""

    per_token: float = 4.0
    name: str = "characters"
    exact: bool = False

    def __post_init__(self) -> None:
        if not self.per_token > 0:
            raise ValueError("characters per token must be positive")

    def of_length(self, length: int) -> int:
        return max(1, math.ceil(length / self.per_token)) if length > 0 else 0

    def count(self, text: str) -> int:
        return self.of_length(len(text))


@dataclass(frozen=True)
class CallableCounter:
    """Counts by any function of a text; fails closed where that gives no count."""

    call: Callable[[str], int]
    name: str = "callable"
    exact: bool = False

    def count(self, text: str) -> int:
        n = int(self.call(text))
        if n < 0:
            raise ValueError("a counter gave a negative count")
        return n


@dataclass(frozen=True)
class NativeCounter:
    """Counts by a provider's own count endpoint; ``send`` makes the request and is injected, so nothing here uses a network."""

    send: Callable[[dict], dict]
    model: str
    field: str = "input_tokens"
    exact: bool = False

    @property
    def name(self) -> str:
        return f"native:{self.model}"

    def count(self, text: str) -> int:
        if not text:
            return 0
        answer = self.send({"model": self.model, "text": text})
        n = answer.get(self.field) if isinstance(answer, dict) else None
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise ValueError("a count endpoint gave no count")
        return n


def tokenizer_counter(ranks_file: str, pattern: str, name: str) -> CallableCounter:
    """An exact counter by the merge ranks of a public tokenizer, special tokens being plain text. The file is read where the counter is made."""
    try:
        import tiktoken
        from tiktoken.load import load_tiktoken_bpe
    except ImportError:
        raise ValueError("this counter needs the package tiktoken") from None
    encoding = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(ranks_file), special_tokens={})
    return CallableCounter(lambda text: len(encoding.encode_ordinary(text)), f"tokenizer:{name}", True)
