"""The text that a reader sees in markup, in one pass of a pattern over it."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

PART = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)


@dataclass(frozen=True)
class Reading:
    """Elements whose content isn't shown, tags that are a line end, and tags whose end is one."""

    hidden: tuple[str, ...] = ()
    breaks: tuple[str, ...] = ()
    after: tuple[str, ...] = ()


def visible(text: str, how: Reading) -> str:
    """The visible text; character references are decoded once markup is gone."""
    out: list[str] = []
    at = 0
    while m := PART.search(text, at):
        out.append(text[at : m.start()])
        at, tag = m.end(), (m["tag"] or "").lower()
        if tag in how.hidden and not m["end"]:
            close = re.compile(rf"</{tag}\s*>", re.I).search(text, at)
            at = close.end() if close else len(text)
        elif tag in how.breaks or m["end"] and tag in how.after:
            out.append("\n")
    out.append(text[at:])
    return html.unescape("".join(out))
