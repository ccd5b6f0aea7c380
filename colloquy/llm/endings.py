"""How texts end: whether a text breaks off before its end.

The end is described by the kind of its last line, its last character and word, what is left open, and how its last line
compares with the lines before; a fitted model weighs these. It learns from whole texts and copies of them that are cut at chance places.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from colloquy.llm import languages, weights
from colloquy.llm.alignment import words
from colloquy.llm.languages import FUNCTION_WORDS

ITEM = re.compile(r"\s*(?:[-*•–]|\d{1,3}[.)])(?:\s+|$)")
CLOSERS = "\"'»”’)]*_`"
OPENED = re.compile(r"[(\[{«„“]\Z|\s[\"'‘]\Z")
# Words that join what follows to what stands before, by language.
JOINED = {
    "en": "and or but if whether because that the a an of to for with as into from by our your their", "de": "und oder aber wenn ob weil dass der die das den dem ein eine einen zu mit für von im am",
    "fr": "et ou mais si que parce le la les un une des du de pour avec dans sur au aux qui", "es": "y o pero si que porque el la los las un una del de para con en al",
}
JOINING = {language: frozenset(words.split()) for language, words in JOINED.items()}
OWN = {language: frozenset(words.split()) for language, words in FUNCTION_WORDS.items()}


def features(text: str) -> dict[str, float]:
    text = text.rstrip()
    out = {"bias": 1.0}
    fences = text.count("```")
    if fences % 2:
        out["open fence"] = 1.0
        return out
    if text.endswith("```"):
        out["closed fence"] = 1.0
        return out
    head, _, line = text.rpartition("\n")
    line = line.strip()
    item = ITEM.match(line)
    body = line[item.end() :] if item else line
    bare = body.rstrip(CLOSERS)
    last = bare[-1:]
    own = words(body)
    kind = "item" if item else "line"
    if not own:
        out[f"{kind} without words"] = 1.0
    if OPENED.search(body):
        out["opened"] = 1.0
    elif bare.endswith(("…", "...")):
        out["ellipsis"] = 1.0
    elif last in ".!?。！？":
        out["full stop"] = 1.0
    elif last in ":：":
        out["colon"] = 1.0
    elif last in ",;、，；-–—/&+" and last:
        out["comma"] = 1.0
    elif body[-1:] in CLOSERS and body:
        out["closed"] = 1.0
    elif re.search(r"[.!?。！？]\s+\d+\Z", bare):
        out["number behind a full stop"] = 1.0
    elif last.isdigit():
        out[f"{kind} ends in a digit"] = 1.0
    elif last.isalpha():
        out[f"{kind} ends in a letter"] = 1.0
    elif last:
        out["other sign"] = 1.0
    if last.isalpha() and own:
        by = languages.scores(text)
        of = max(by, key=by.__getitem__)
        if own[-1] in JOINING.get(of, ()):
            out[f"{kind} ends in a joining word"] = 1.0
        elif own[-1] in OWN.get(of, ()):
            out[f"{kind} ends in a function word"] = 1.0
    if line.count("(") + line.count("[") > line.count(")") + line.count("]"):
        out["bracket open"] = 1.0
    if line.count('"') % 2 or line.count("“") > line.count("”"):
        out["quote open"] = 1.0
    if own and body.count("**") % 2:
        out["mark open"] = 1.0
    if line.startswith("|"):
        out["table row"] = 1.0
    if line.startswith("#"):
        out["heading"] = 1.0
    if re.search(r"://\S+$|(?<![\w.+-])[\w.+-]++@[\w-]+\S*$", line):
        out["address at the end"] = 1.0
    if "full stop" not in out and "closed" not in out:
        inside = bool(re.search(r"[.!?。！？]\s|[。！？]", line[:-1]))
        if inside and not item and "number behind a full stop" not in out:
            out["sentences before on the line"] = 1.0
        earlier = [x.strip() for x in head.split("\n") if x.strip()]
        alike = [x for x in earlier if ITEM.match(x)] if item else earlier
        if not earlier and len(own) <= 3 and not inside:
            out["few words alone"] = 1.0
        elif not item and alike:
            ended = sum(x.rstrip(CLOSERS)[-1:] in ".!?。！？" for x in alike)
            out["lines before end in stops" if ended > 0.5 * len(alike) else "lines before are open"] = 1.0
        if item and len(own) == 1:
            out["item of one word"] = 1.0
            if alike and sum(len(words(x)) - 1 <= 2 for x in alike) > 0.5 * len(alike):
                out["items of one word"] = 1.0
        if not item and len(own) > 8:
            out["long line"] = 1.0
    return out


def is_truncated(text: str, table: Mapping[str, float] = weights.ENDING) -> bool:
    return sum(table.get(k, 0.0) * v for k, v in features(text).items()) > 0
