"""Refusals: sentences aligned with a few templates of roles.

The words of a sentence are read as roles: who speaks, a negation, an ability or wish, an act of answering, what was asked for, a refusing verb, a
rule. A template is a sequence of roles; a sentence is compared with each by the containment of the template's role pairs and
by the longest common subsequence, so word order, tense and fillers don't matter. A fitted model weighs the best alignment against
how much else the sentence says. An answer is a refusal if a sentence of it refuses and, courtesy aside, little else is said.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from functools import lru_cache

from colloquy.llm import weights
from colloquy.llm.alignment import common_subsequence, containment, places_of, shingles, words

# Roles of words, in English, German, French and Spanish; a role ends a line's head.
ROLES = """
I: i we me i'm i'd i'll i've we're ich mir mich wir uns je j' j'ai me m' nous yo nos
NOT: not no never cannot can't won't don't doesn't couldn't wouldn't unable nothing nicht kein keine keinen keinerlei nie ne n' pas jamais impossible nunca imposible incapable außerstande
WISH: can could will would may able ability allowed permitted comfortable prefer rather like going position kann könnte darf möchte werde will fähig lage peux puis pouvons mesure préfère souhaite posible gustaría permitido
ACT: help helping assist assisting answering providing discussing sharing doing assist answer provide give share discuss do comply continue support respond engage produce create advise advice advising part take go talk write say comment fulfill fulfil handle complete helfen weiterhelfen beantworten antwort antworten auskunft geben gebe liefern erstellen tun mache machen beraten unterstützen äußern mitmachen erfüllen dienen nachkommen aider répondre traiter fournir fournirai donner donnerai suite faire prononcer satisfaire ayudar ayudarte ayudarle ayudarlo responder contestar dar generar opinar hablar proporcionar hacer seguir
OBJ: this that it these request question content topic one here demand subject matter point das dies diese dieser dieses dazu dabei darauf hier damit darüber so anfrage frage bitte thema wunsch inhalt cela ça ce cette c' demande question contenu sujet point là-dessus eso esto esta este esa ese solicitud pregunta petición tema contenido ello lo
REFUSE: refuse decline reject pass refusing declining abstain ablehnen passen verweigern verweigere lehne refuser refuse décliner décline m'abstenir rechazar rechazo negarme niego declinar
RULE: guidelines policy policies rules richtlinien regeln vorgaben règles directives normas políticas reglas
AGAINST: against violates violate verstößt gegen contre l'encontre encontre contra breaks outside beyond falls viola enfreint
""".strip()
# Verbs that say ability and person at once.
FIRST_PERSON = {"puedo": ("I", "WISH"), "podemos": ("I", "WISH"), "voy": ("I", "WISH"), "prefiero": ("I", "WISH"), "debo": ("I", "WISH"), "quiero": ("I", "WISH"), "rechazo": ("I", "REFUSE"), "niego": ("I", "REFUSE")}
# Phrases that are one role, and Chinese, which has no blanks.
PHRASES = [
    (re.compile(p), f" {roles} ")
    for p, roles in (
        (r"\bno can do\b", "§I §NOT §ACT"), (r"\bturn (?:this|that|it) down\b|\bturn down\b", "§REFUSE"), (r"\bno comment\b", "§I §NOT §ACT"), (r"\blanguage model\b|\bsprachmodell\b|\bmodèle de langage\b|\bmodelo de lenguaje\b", ""),
        (r"\bl'impossibilité\b", "§NOT §WISH"), (r"作为语言模型", ""), (r"我们|我", "§I"), (r"拒绝", "§REFUSE"), (r"无法|不能|不便|不可以|不会", "§NOT §WISH"), (r"帮助|协助|回答|提供|讨论|处理|完成|满足|帮", "§ACT"),
        (r"这个|这方面|这一|该|此|您的|这", "§OBJ"), (r"问题|请求|内容|要求|话题", "§OBJ"),
    )
]
# What a refusal says, as sequences of roles.
TEMPLATES = [
    tuple(t.split())
    for t in (
        "I NOT ACT OBJ", "I NOT WISH ACT OBJ", "I WISH NOT ACT OBJ", "NOT I WISH ACT OBJ", "NOT I ACT OBJ", "OBJ I NOT ACT", "OBJ WISH I NOT ACT", "I OBJ NOT ACT", "OBJ ACT I NOT", "OBJ NOT I WISH ACT", "I NOT ACT",
        "I WISH REFUSE OBJ", "I REFUSE OBJ", "OBJ I REFUSE", "I OBJ REFUSE", "REFUSE I OBJ", "I REFUSE ACT", "OBJ AGAINST RULE", "OBJ AGAINST I WISH ACT",
    )
]
# Openings, closings and reasons that go with a refusal and answer nothing.
COURTESY = re.compile(
    r"hmm|well|i understand|thank you|thanks|is there (?:something|anything) else|(?:can|may) i help|you may want to ask|i hope|please (?:understand|consult)|sorry|i['’]m (?:very |so )?sorry|apologies|my apologies|let me know|to be frank|unfortunately|regrettably"
    r"|gibt es (?:etwas|noch etwas) anderes|bitte hab|danke|es tut mir|tut mir leid|wende dich|ich verstehe|ehrlich gesagt|hm|leider|y a-t-il autre|merci|(?:je suis )?désolée?|je comprends|malheureusement|¿hay algo|gracias|lo siento|lo lamento|perdón|entiendo|por desgracia|lamentablemente"
    r"|抱歉|对不起|谢谢|感谢|很遗憾|请谅解|请理解|还有别的|希望您|我理解|作为语言模型|有其他",
    re.I,
)
SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”’)]*\s+|(?<=[。！？])|\n+|;\s+")
TOKEN = re.compile(r"§[A-Z]+|[㐀-鿿]|[^\W_㐀-鿿]+(?:['-][^\W_]+)*")
ELISION = re.compile(r"\b(j|m|n|c|l|qu|d|s|t)'(?=\w)")


@lru_cache(maxsize=1)
def lexicon() -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for line in ROLES.split("\n"):
        role, _, listed = line.partition(": ")
        for w in listed.split():
            out.setdefault(w, (role,))
    return out | FIRST_PERSON


@lru_cache(maxsize=1)
def cues() -> frozenset[str]:
    """The words without one of which no sentence refuses."""
    return frozenset(w for w, of in lexicon().items() if {"NOT", "REFUSE", "AGAINST"} & set(of)) | set("turn 拒 不 无".split())


@lru_cache(maxsize=1)
def prepared() -> list[tuple[tuple[str, ...], set, dict[str, int]]]:
    return [(t, shingles(t, 2), places_of(t)) for t in TEMPLATES]


def roles(sentence: str) -> tuple[list[str], int]:
    """The roles of a sentence in order, and the number of its other words."""
    text = sentence.casefold().replace("’", "'")
    for pattern, instead in PHRASES:
        text = pattern.sub(instead, text)
    known, out, others = lexicon(), [], 0
    for w in TOKEN.findall(ELISION.sub(r"\1' ", text) if "'" in text else text):
        if w[0] == "§":
            out.append(w[1:])
        elif of := known.get(w) or known.get(w + "'"):
            out.extend(of)
        else:
            others += 1
    return out, others


#: A sentence with more roles is no short refusal; its alignment is taken over windows of so many roles.
WINDOW = 12


def features(sentence: str) -> dict[str, float] | None:
    """How well a sentence aligns with the templates; None if it has no role of refusing."""
    own, others = roles(sentence)
    have = set(own)
    if not have & {"NOT", "REFUSE", "AGAINST"}:
        return None
    covered, contained = 0.0, 0.0
    for at in range(0, max(1, len(own) - WINDOW // 2), WINDOW // 2):
        part = own[at : at + WINDOW]
        pairs = shingles(part, 2)
        for t, own_pairs, places in prepared():
            if have.issuperset(t):
                c = common_subsequence(t, part, places) / len(t)
                k = containment(own_pairs, pairs)
                if (c, k) > (covered, contained):
                    covered, contained = c, k
    return {
        "bias": 1.0, "aligned": covered, "whole": float(covered >= 1), "pairs": contained, "others": math.log1p(others), "roles": math.log1p(len(own)), "first person": float("I" in have),
        "refuses": float("REFUSE" in have and "I" in have), "rule": float("RULE" in have and "AGAINST" in have), "question": float(sentence.rstrip().endswith(("?", "？"))),
    }


#: What begins a reason, which neither adds to a refusal nor takes from it.
REASON = re.compile(r",?\s+\b(?:because|since|as it|weil|denn|car|parce que|puisque|porque|ya que)\b", re.I)


def score(sentence: str, table: Mapping[str, float] = weights.REFUSAL) -> float:
    """Above 0 for a sentence that refuses, with or without a reason behind it."""
    best = -9.0
    for clause in {sentence, REASON.split(sentence, maxsplit=1)[0]}:
        if (f := features(clause)) is not None:
            best = max(best, sum(table.get(k, 0.0) * v for k, v in f.items()))
    return best


#: An answer says something if it has more other words, besides courtesy, than so many times the words that refuse.
SAID = 1.0


def is_refusal(text: str, table: Mapping[str, float] = weights.REFUSAL, own: Sequence[str] | None = None) -> bool:
    """``own``: the words of the text, if at hand."""
    if "```" in text or cues().isdisjoint(words(text) if own is None else own):
        return False
    refused, said = 0, 0
    for sentence in SENTENCE.split(text):
        w = words(sentence)
        if not w:
            continue
        if not cues().isdisjoint(w) and score(sentence, table) > 0:
            refused += len(w)
        elif not COURTESY.match(sentence.strip(" \"'“„«—-,")):
            said += len(w)
    return refused > 0 and said <= SAID * refused
