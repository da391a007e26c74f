"""Averaged perceptron over sparse string features, for several labels."""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Iterable, Sequence


class AveragedPerceptron:
    """Linear model label -> feature -> weight; ties go to the first label."""

    def __init__(self, labels: Sequence[str]):
        self.labels = list(labels)
        self.weights: dict[str, dict[str, float]] = {}

    def scores(self, features: Iterable[str]) -> dict[str, float]:
        out = dict.fromkeys(self.labels, 0.0)
        for f in features:
            for label, w in self.weights.get(f, {}).items():
                out[label] += w
        return out

    def predict(self, features: Iterable[str]) -> str:
        s = self.scores(features)
        return max(self.labels, key=lambda x: s[x])

    def train(self, rows: list[tuple[list[str], str]], passes: int = 5, seed: int = 7) -> AveragedPerceptron:
        """Fit on (features, label) rows; the weights are averaged over all steps."""
        live: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        total: dict[tuple[str, str], float] = defaultdict(float)
        since: dict[tuple[str, str], int] = defaultdict(int)
        rng, rows, step = random.Random(seed), list(rows), 0
        self.weights = live

        def add(f: str, label: str, by: float) -> None:
            total[f, label] += (step - since[f, label]) * live[f][label]
            since[f, label] = step
            live[f][label] += by

        for _ in range(passes):
            rng.shuffle(rows)
            for features, label in rows:
                step += 1
                got = self.predict(features)
                if got != label:
                    for f in features:
                        add(f, label, 1.0)
                        add(f, got, -1.0)
        averaged: dict[str, dict[str, float]] = {}
        for f, by_label in live.items():
            for label, w in by_label.items():
                mean = (total[f, label] + (step - since[f, label]) * w) / max(step, 1)
                if mean:
                    averaged.setdefault(f, {})[label] = mean
        self.weights = averaged
        return self
