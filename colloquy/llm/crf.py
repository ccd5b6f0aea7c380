"""A semi-Markov conditional random field over candidate segments.

A labelling of a text is a set of candidates that don't overlap; what they leave out is unlabelled and scores 0. A
candidate scores the sum of the weights of its whole-span features; two neighbours with no letter or digit and at most ``NEAR`` characters
between them add the weight of their transition. Only candidates are segments, so their length bounds the segments' length, and the
dynamic programme takes time in proportion to the candidates. :func:`fit` maximises the likelihood of
labelled samples less a penalty on the weights; the expectations come from the same lattice, forward and backward.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Mapping, Sequence
from typing import NamedTuple

#: Characters between neighbours that a transition may bridge.
NEAR = 8


class Candidate(NamedTuple):
    start: int
    end: int
    label: str
    features: tuple[str, ...]


Weights = Mapping[str, float]


def value(c: Candidate, weights: Weights) -> float:
    return sum(weights.get(f"{c.label} {f}", 0.0) for f in c.features)


def transition(text: str, a: Candidate, b: Candidate) -> str | None:
    """The transition's name where ``b`` follows ``a`` closely."""
    if b.start - a.end <= NEAR and not any(map(str.isalnum, text[a.end : b.start])):
        return f"{a.label} > {b.label}"
    return None


def decode(text: str, candidates: Sequence[Candidate], weights: Weights) -> list[Candidate]:
    """The labelling with the highest score, in order."""
    found = sorted(candidates, key=lambda c: (c.end, c.start))
    ends = [c.end for c in found]
    best: list[float] = []  # of the labellings that end with each candidate
    upto: list[float] = [0.0]  # of those that use only the first so many
    arg: list[int] = [-1]
    back: list[int] = []
    for i, c in enumerate(found):
        far = bisect_left(ends, c.start - NEAR, 0, i)
        score, last = upto[far], arg[far]
        for j in range(far, bisect_right(ends, c.start, 0, i)):
            name = transition(text, found[j], c)
            s = best[j] + (weights.get(name, 0.0) if name else 0.0)
            if s > score:
                score, last = s, j
        best.append(score + value(c, weights))
        back.append(last)
        upto.append(max(upto[-1], best[-1]))
        arg.append(i if best[-1] > upto[-2] else arg[-1])
    out, i = [], arg[-1]
    while i >= 0:
        out.append(found[i])
        i = back[i]
    return out[::-1]


def total(scores: Sequence[float]) -> float:
    top = max(scores)
    return top + math.log(sum(math.exp(s - top) for s in scores))


def expected(text: str, found: Sequence[Candidate], weights: Weights) -> dict[str, float]:
    """The expected count of each feature and transition over all labellings; ``found`` in order of its ends."""
    n = len(found)
    values = [value(c, weights) for c in found]
    pairs = {(i, j): transition(text, found[i], found[j]) for j in range(n) for i in range(n) if found[i].end <= found[j].start}
    step = {ij: weights.get(t, 0.0) if t else 0.0 for ij, t in pairs.items()}
    ahead = [0.0] * n  # labellings up to and with i
    for j in range(n):
        ahead[j] = values[j] + total([0.0] + [ahead[i] + step[i, j] for i in range(j) if (i, j) in step])
    behind = [0.0] * n  # labellings after i
    for i in reversed(range(n)):
        behind[i] = total([0.0] + [step[i, j] + values[j] + behind[j] for j in range(i + 1, n) if (i, j) in step])
    z = total([0.0] + ahead)
    out: dict[str, float] = {}
    for i, c in enumerate(found):
        p = math.exp(ahead[i] + behind[i] - z)
        for f in c.features:
            out[f"{c.label} {f}"] = out.get(f"{c.label} {f}", 0.0) + p
    for (i, j), t in pairs.items():
        if t:
            out[t] = out.get(t, 0.0) + math.exp(ahead[i] + step[i, j] + values[j] + behind[j] - z)
    return out


def fit(samples: Sequence[tuple[str, Sequence[Candidate], set[tuple[int, int, str]]]], epochs: int = 12, rate: float = 0.4, penalty: float = 1e-3) -> dict[str, float]:
    """Weights from samples of a text, its candidates and its true segments, by adaptive gradient steps."""
    weights: dict[str, float] = {}
    past: dict[str, float] = {}
    for _ in range(epochs):
        for text, candidates, true in samples:
            found = sorted(candidates, key=lambda c: (c.end, c.start))
            if not found:
                continue
            slope = {k: -v for k, v in expected(text, found, weights).items()}
            own: list[Candidate] = []
            for c in found:  # of equal spans the one with most features is the true one
                if c[:3] in true and not (own and own[-1][:3] == c[:3]):
                    own.append(c)
            for c in own:
                for f in c.features:
                    slope[f"{c.label} {f}"] = slope.get(f"{c.label} {f}", 0.0) + 1
            for a, b in zip(own, own[1:]):
                if t := transition(text, a, b):
                    slope[t] = slope.get(t, 0.0) + 1
            for k, g in slope.items():
                g -= penalty * weights.get(k, 0.0)
                past[k] = past.get(k, 1e-6) + g * g
                weights[k] = weights.get(k, 0.0) + rate * g / math.sqrt(past[k])
    return {k: round(v, 3) for k, v in sorted(weights.items()) if abs(v) >= 0.0005}
