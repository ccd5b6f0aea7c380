"""Broken prompt and response pairs.

A pair is a user message and the assistant message at the next index. Each pair gets at most one defect, the first of:

- ``empty``: nothing but blank, invisible or placeholder characters;
- ``copy``: the answer's word shingles are contained in the question, and the longest common subsequence of the two
  covers both, once or several times over;
- ``refusal``: a sentence aligns with a refusal template, and most of what else is said is courtesy (:mod:`colloquy.llm.refusals`);
- ``truncated``: the end looks like that of a text cut at a chance place (:mod:`colloquy.llm.endings`);
- ``language``: function words and script say another language than the question's, and the question names none (:mod:`colloquy.llm.languages`).

What counts as a refusal and as an end is fitted by :mod:`colloquy.llm.pairs_train`.

Both messages meet by one exchange and one sort on (conv_id, index of the answer), in which the question streams ahead of its answers; rows
delivered twice fold there. No length of a text decides anything.
Defined results: null texts count as empty; a null question can't be copied and has no language; messages without
neighbour are no pair; of several user messages at one index the one with the largest msg_id is the question; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.common import spread
from colloquy.llm import languages
from colloquy.llm.alignment import common_subsequence, containment, shingles, words
from colloquy.llm.endings import is_truncated
from colloquy.llm.refusals import is_refusal

SHINGLE = 3
COPIED = 0.8

PLACEHOLDER = re.compile(
    r"[\[(<{*_]*\s*(?:no (?:response|answer|reply|output|content|text|data)|empty|blank|null|none|nil|nan|n\s*/\s*a|n\.a\.|undefined|missing|tbd|todo"
    r"|keine antwort|leer|pas de réponse|vide|sin respuesta|vacío|无|空|无回复|没有回答)\s*[\])>}*_]*[.!。]?",
    re.I,
)
VISIBLE = re.compile(r"[^\s\u200b-\u200f\u2028-\u202e\u2060-\u206f\ufeff\u00ad\u180e\x00-\x1f\x7f-\x9f]")
WORDLIKE = re.compile(r"[^\W_]|[\U0001F300-\U0001FAFF\u2600-\u27bf]")

# Names of the languages, and words that ask for a translation.
ASKED = re.compile(
    r"\b(?:english|german|french|spanish|chinese|mandarin|italian|portuguese|japanese|dutch|polish|russian|englisch\w*|deutsch\w*|französisch\w*|spanisch\w*|chinesisch\w*"
    r"|anglais\w*|allemand\w*|français\w*|espagnol\w*|chinois\w*|ingl[eé]s\w*|alem[aá]n\w*|franc[eé]s\w*|español\w*|chino|castellano"
    r"|(?:translate|put|say) (?:this|that|it|the last|the above|your|my)|übersetz\w* (?:das|es|dies|mir)|tradui\w*[- ](?:le|la|ça|cela)\b|trad[uú][cz]\w*(?:lo|la)\b)\b|[英德法西中汉]\s?[文语]|西班牙|翻译",
    re.I,
)

def is_empty(text: str | None) -> bool:
    if text is None or not VISIBLE.search(text):
        return True
    return not WORDLIKE.search(text) or bool(PLACEHOLDER.fullmatch(text.strip(" \t\r\n\u200b\ufeff\xa0")))


def is_copy(question: list[str], answer: list[str]) -> bool:
    if len(answer) < 2 or len(question) < 2 or len(answer) < 0.6 * len(question):
        return False
    known = set(question)
    if sum(w in known for w in answer) < COPIED * len(answer):
        return False
    n = min(SHINGLE, len(question), len(answer))
    if containment(shingles(answer, n), shingles(question, n)) < 0.4:
        return False
    times = max(1, round(len(answer) / len(question)))
    both = common_subsequence(question * times, answer)
    return both >= COPIED * len(answer) and both >= 0.75 * times * len(question)


def defect(question: str | None, answer: str | None) -> str | None:
    """The one defect of a pair, or None."""
    if is_empty(answer):
        return "empty"
    own = words(answer)
    if question and is_copy(words(question), own):
        return "copy"
    if is_refusal(answer, own=own):
        return "refusal"
    if is_truncated(answer):
        return "truncated"
    if question and languages.other(question, answer) and not ASKED.search(question):
        return "language"
    return None


def pairs(messages: DataFrame) -> DataFrame:
    """msg_id, question and answer of each pair; repeated rows once."""
    rows = messages.where("role in ('user', 'assistant') and conv_id is not null and idx is not null").select(
        "conv_id", F.when(F.col("role") == "user", F.col("idx") + 1).otherwise(F.col("idx")).alias("at"), (F.col("role") == "assistant").alias("answer"), "msg_id", "text"
    )
    order = Window.partitionBy("conv_id", "at").orderBy("answer", F.desc_nulls_last("msg_id"))
    first = F.first_value(F.struct("answer", "text")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = spread(rows, "conv_id", "at").withColumn("first", first).withColumn("before", F.lag(F.struct("answer", "msg_id")).over(order))
    again = F.col("before").eqNullSafe(F.struct("answer", "msg_id"))
    return rows.where(F.col("answer") & ~F.col("first.answer") & ~again).select("msg_id", F.col("first.text").alias("question"), F.col("text").alias("answer"))


def found(messages: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(m, d) for m, q, a in zip(*(c.to_pylist() for c in batch.columns)) if (d := defect(q, a))]
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())], ["msg_id", "defect"])

    return pairs(messages).mapInArrow(run, "msg_id long, defect string")
