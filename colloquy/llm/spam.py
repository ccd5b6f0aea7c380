"""Keyword-stuffed pages and link lists.

A page is cut into lines and sentences, and each piece is reduced to a shape: bucketed counts of words and separators,
shares of capitals and function words, links, tags, prices, how it begins and ends, and how often its content words return.
Pieces of one shape are grouped. A fitted model (:mod:`colloquy.llm.spam_train`) tells from a shape whether it is that of a sentence or an entry of a record, or
none of a sentence: keywords, menus, links, tags, goods, stuffed phrases. A page is spam if non-sentence shapes hold more than half of its length
and few of them, at most ``FEW``, suffice for that half.

Unfinished lines that follow one another are weighed as one block, so that a list means the same with commas or with line ends.
Defined results: null, empty and blank texts are no spam; ties (exactly half) are no spam; each document counts for itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame

from colloquy.common import python_partitions
from colloquy.llm import weights
from colloquy.llm.languages import FUNCTION

#: So many shapes may make up the non-sentence half of a page.
FEW = 24
SPLIT = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+")
LINK = re.compile(r"<[a-z/!][^>]*>|\]\([^)\s]*\)|(?:https?:|www\.|//)\S+|(?<![\w@.-])[\w-]+(?:\.[\w-]+)*\.[a-z]{2,24}/\S*|(?<![\w@.-])(?-i:[a-z0-9-]{3,}(?:\.[a-z0-9-]+)*\.[a-z]{2,24})(?![\w.])\S*", re.I)
ANCHOR = re.compile(r"<a\b[^>]*>[^<]*</a>|\[[^\]\n]*\]\([^)\s]*\)", re.I)
TAG = re.compile(r"(?<!\S)(?:[#+@]|tags?:)[^\s,;]*[^\W\d_][^\s,;]*", re.I)
GOODS = re.compile(r"\bSKU\s?-?\d+|[$€£]\s?\d|\b\d+[.,]\d\d(?:\s?(?:€|EUR|USD|\$|£))?\s*$", re.I)
WORD = re.compile(r"[^\W\d_][^\W_]*(?:[@][^\W_]+)*(?:['’][^\W_]+)?|\d+[^\W\d_@][\w@]*")
SEPARATOR = re.compile(r"[|;,•·>»/\\~*]|\s[-–—]\s")
MAY_LINK = re.compile(r"[/<]|\.[a-z]{2}|\]\(", re.I)
DIGIT = re.compile(r"\d")
ENDED = re.compile(r"[.!?…:][\"'»”’)\]]*$|[)\]»”]$")
HEAD = re.compile(r"(?:[-*•]\s+)?[A-Z]\w{0,4}\.\s\d|\W*+[\w. ]*+[:：]\s*\d+\W*$")
LEADERS = re.compile(r"\.{3,}\s*\d+\s*$")


# Words of selling and of page navigation.
MARKET = frozenset(
    "buy cheap cheapest sale sales free best top deal deals discount online review reviews price prices order shop store offer kaufen günstig billig gratis beste angebot test vergleich preis bestellen acheter promo avis gratuit meilleur comparatif soldes pas cher comprar barato oferta opiniones mejor"
    " home login sitemap blog more next previous page contact cart menu faq about imprint start kontakt warenkorb accueil panier inicio carrito help news products".split()
)


def priced(piece: str) -> bool:
    return bool(DIGIT.search(piece)) and bool(GOODS.search(piece))


def is_ended(piece: str) -> bool:
    """Whether a piece ends as a sentence does; only its last characters tell."""
    return bool(ENDED.search(piece[-8:]))


def is_entry(piece: str) -> bool:
    """Whether a piece is an entry of a record: a table row, an agenda line with leaders, a numbered paper, a count, a trailing note in brackets."""
    return "\t" in piece or bool(HEAD.match(piece)) or piece[-1] == ")" and "(" in piece or piece[-1].isdigit() and "..." in piece and bool(LEADERS.search(piece[piece.rfind("...") - 1 :]))


def bucket(n: int) -> int:
    """0, 1, 2, 4, 8, ... as powers of two."""
    return n.bit_length()


def shape(piece: str) -> tuple:
    """What remains of a piece: its counts in buckets, its end and its repetition."""
    words = WORD.findall(piece.lower())
    n = len(words)
    others = [w for w in words if w not in FUNCTION]
    content = [w for w in others if len(w) > 2]
    distinct = len(set(content))
    most = 1 if distinct == len(content) else max(Counter(content).values())
    tokens = piece.split()
    capitals = len([w for w in tokens if (c := w[0]).isalpha() and not c.islower()])
    linked = sum(map(len, LINK.findall(piece))) + sum(map(len, ANCHOR.findall(piece))) if MAY_LINK.search(piece) else 0
    tagged = sum(map(len, TAG.findall(piece))) if "#" in piece or "+" in piece or "@" in piece or "tag" in piece else 0
    return (
        bucket(n),
        bucket(len(SEPARATOR.findall(piece))),
        round(4 * capitals / max(1, len(tokens))),
        round(8 * (n - len(others)) / max(1, n)),
        min(8, round(8 * linked / len(piece))) if linked else 0,
        min(8, round(8 * tagged / len(piece))) if tagged else 0,
        min(8, most) if content else 0,
        round(8 * distinct / max(1, len(content))),
        priced(piece),
        is_ended(piece),
        is_entry(piece),
        piece[0].islower() or piece[0] in "#+|>»",
        round(8 * len([w for w in content if w in MARKET]) / max(1, n)),
        piece.count("|") + piece.count(" > ") >= 3,
        piece.count(" ; ") >= 3,
    )


def features(s: tuple) -> dict[str, float]:
    """The features of a shape that the model weighs; those of finished pieces apart from those of open ones."""
    words, separators, capitals, function, linked, tagged, most, distinct, goods, ended, entry, low, market, barred, spaced = s
    end = "ended" if ended else "open"
    out = {
        end: 1.0, "linked": linked / 8, "tagged": tagged / 8, f"{end} words": words / 8, f"{end} separators": max(0, separators - 1) / 4, f"{end} separated": float(separators >= max(2, words - 1)),
        f"{end} capitals": capitals / 4, f"{end} function words": function / 8, f"{end} repeats": max(0, most - 2) / 6, f"{end} same words": (8 - distinct) / 8, f"{end} market": market / 8,
    }
    marks = (
        ("goods", goods and not ended), ("goods ended", goods and ended), ("entry", entry), (f"{end} begins low", low),
         (f"{end} no function word", not function and words > 1), (f"{end} few words", words <= 2), ("open all capitals", not ended and capitals == 4),
        ("open all capitals return", not ended and capitals == 4 and distinct <= 5),
        ("open returns", not ended and distinct <= 5 and words > 2), (f"{end} sells", market >= 2), ("open barred", barred and not ended), ("open spaced semicolons", spaced and not ended), ("mostly linked", linked >= 4 and not entry), ("linked entry", linked >= 4 and entry), ("partly linked", 2 <= linked < 4), ("mostly tagged", tagged >= 4), ("partly tagged", 2 <= tagged < 4), ("open one word", not ended and words <= 1), ("ended returns", ended and most >= 3 and distinct <= 4), ("ended short repeats", ended and most >= 3 and words <= 4),
    )
    for name, on in marks:
        if on:
            out[name] = 1.0
    return out


def score(s: tuple, table: Mapping[str, float] = weights.PIECE) -> float:
    """Above 0 for a shape that is none of a sentence or of an entry in a record."""
    return sum(table.get(k, 0.0) * v for k, v in features(s).items())


def pieces(text: str) -> Iterator[str]:
    """Sentences, record lines, and blocks of unfinished lines."""
    block: list[str] = []
    for line in text.splitlines():
        line = line.strip()
        if not line:
            continue
        if is_entry(line) and not (MAY_LINK.search(line) and LINK.search(line)):
            if block:
                yield " , ".join(block)
                block = []
            yield line
            continue
        for part in SPLIT.split(line):
            part = part.strip()
            if not part:
                continue
            if is_ended(part) or priced(part) or MAY_LINK.search(part) and LINK.search(part):
                if block:
                    yield " , ".join(block)
                    block = []
                yield part
            else:
                block.append(part)
    if block:
        yield " , ".join(block)


def shapes(text: str | None) -> dict[tuple, int]:
    """The length of each shape in a page."""
    out: dict[tuple, int] = {}
    for piece in pieces(text or ""):
        s = shape(piece)
        out[s] = out.get(s, 0) + len(piece)
    return out


class Judge:
    """Judges pages; remembers the scores of shapes, of which there are few."""

    MEMORY = 200_000

    def __init__(self, table: Mapping[str, float] = weights.PIECE):
        self.table, self.known = table, {}

    def bad(self, s: tuple) -> bool:
        got = self.known.get(s)
        if got is None:
            if len(self.known) > self.MEMORY:
                self.known.clear()
            got = self.known[s] = score(s, self.table) > 0
        return got

    def spam_share(self, text: str | None) -> float:
        by = shapes(text)
        return sum(n for s, n in by.items() if self.bad(s)) / max(1, sum(by.values()))

    def is_spam(self, text: str | None) -> bool:
        """Whether at most ``FEW`` non-sentence shapes hold more than half of the page."""
        by = shapes(text)
        largest = sorted((n for s, n in by.items() if self.bad(s)), reverse=True)
        return sum(largest[:FEW]) > 0.5 * sum(by.values())


def found(documents: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge()
        for batch in batches:
            keep = [i for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if judge.is_spam(t)]
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64())], ["doc_id"])

    return python_partitions(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long")
