"""Logistic regression over sparse named features."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence


def fit(rows: Sequence[tuple[dict[str, float], bool, float]], epochs: int = 30, rate: float = 0.3, penalty: float = 1e-3, seed: int = 1) -> dict[str, float]:
    """Weights from rows of features, label and importance, by adaptive gradient steps in a fixed random order."""
    table: dict[str, float] = {}
    past: dict[str, float] = {}
    order = list(range(len(rows)))
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            features, label, importance = rows[i]
            z = sum(table.get(k, 0.0) * v for k, v in features.items())
            miss = importance * ((1.0 if label else 0.0) - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            for k, v in features.items():
                g = miss * v - penalty * table.get(k, 0.0)
                past[k] = past.get(k, 1e-6) + g * g
                table[k] = table.get(k, 0.0) + rate * g / math.sqrt(past[k])
    return {k: round(v, 3) for k, v in sorted(table.items()) if abs(v) >= 0.0005}
