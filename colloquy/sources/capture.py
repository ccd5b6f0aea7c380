"""Conversations from stored pages whose elements carry the author's role in an attribute."""

from __future__ import annotations

import html
import re

from colloquy.operators import markup

# The attribute, the roles, what is taken out, what ends a line, and the limits of a capture (fixed values).
ROLE_ATTRIBUTE = "data-message-author-role"
ROLES = ("user", "assistant")
REMOVED = ("script", "style", "noscript", "template", "button", "svg", "canvas", "input", "textarea", "select", "form")
BLOCKS = ("p", "div", "pre", "li", "tr", "section", "article", "blockquote")
MOST_MESSAGES, MOST_CHARS = 10_000, 5_000_000
SCHEMA_VERSION, ADAPTER = "paic-browser-capture-1", "role_attribute_v1"

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
READING = markup.Reading(hidden=tuple(t for t in REMOVED if t not in VOID), breaks=("br",), after=BLOCKS)
ATTRIBUTE = re.compile(rf"""\b{ROLE_ATTRIBUTE}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
# The steps of white space in a captured text: patterns and what they become, in order (fixed values).
SPACES = ((r"\u00a0", " "), (r"\r\n?", "\n"), (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n"))


class CaptureError(ValueError):
    """A page beyond the limits; it is refused, never cut."""


def normalised(text: str) -> str:
    for pattern, instead in SPACES:
        text = re.sub(pattern, instead, text)
    return text.strip()


def elements(page: str) -> list[tuple[str, str]]:
    """Role attribute and inner markup of the outermost elements that have one."""
    out: list[tuple[str, str]] = []
    tag, role, depth, start = "", "", 0, 0
    for m in markup.PART.finditer(page):
        name = (m["tag"] or "").lower()
        if not name:
            continue
        if depth:
            if name == tag and not m["rest"].endswith("/"):
                depth += -1 if m["end"] else 1
                if not depth:
                    out.append((role, page[start : m.start()]))
        elif not m["end"] and name not in VOID and (a := ATTRIBUTE.search(m["rest"])):
            tag, role, depth, start = name, html.unescape(next(g for g in a.groups() if g is not None)), 1, m.end()
    if depth:
        out.append((role, page[start:]))
    return out


def captured(page: str) -> dict:
    """What a capture of the page gives: its messages and the numbers of elements of other roles and without text."""
    found = elements(page)
    if len(found) > MOST_MESSAGES:
        raise CaptureError("too many messages")
    messages, ignored, empty = [], 0, 0
    for role, inner in found:
        role = role.strip().lower()
        if role not in ROLES:
            ignored += 1
            continue
        text = normalised(markup.visible(inner, READING))
        if len(text) > MOST_CHARS:
            raise CaptureError("message too long")
        if text:
            messages.append({"role": role, "text": text, "index": len(messages)})
        else:
            empty += 1
    if not messages:
        return {"ok": False, "error": "no messages"}
    return {"ok": True, "schema_version": SCHEMA_VERSION, "adapter": ADAPTER, "message_count": len(messages), "ignored_role_nodes": ignored, "empty_role_nodes": empty, "messages": messages}
