"""Expectation-maximisation for two classes and voters that say good (1), bad (-1) or nothing (0).

Works on the table of distinct vote patterns with their counts. With m voters it has at most 3**m
rows whatever the size of the corpus, so it is safe to bring to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

VOTES = (-1, 0, 1)


@dataclass(frozen=True)
class VoteModel:
    """prior: log odds of good; weight[j][v + 1]: what vote v of voter j adds to the log odds."""

    prior: float
    weight: tuple[tuple[float, float, float], ...]
    accuracy: tuple[float, ...]

    def log_odds(self, pattern: Iterable[int]) -> float:
        return self.prior + sum(w[v + 1] for w, v in zip(self.weight, pattern, strict=True))

    def posterior(self, pattern: Iterable[int]) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.log_odds(pattern)))))


def fit(patterns: dict[tuple[int, ...], int], voters: int, rounds: int = 60, pseudo: float = 1.0) -> VoteModel:
    """Fit each voter's three outcomes per class (bad, silent, good) and the class prior.

    The first posterior is a smoothed majority vote, which also fixes which class is called good. Pseudo
    counts favour a voter's being right, so a voter that never speaks, or an empty table, yields a model
    that leans on plain majority. The weight of a spoken vote never changes sign: a voter that EM finds
    worse than chance is silenced, not inverted.
    """
    post = {p: (1 + 2 * sum(v > 0 for v in p)) / (2 + 2 * sum(v > 0 for v in p) + 4 * sum(v < 0 for v in p)) for p in patterns}
    total = sum(patterns.values())
    prior, table = 0.5, []
    for _ in range(max(1, rounds)):
        good = sum(n * post[p] for p, n in patterns.items())
        prior = min(0.95, max(0.05, (good + 2 * pseudo) / (total + 4 * pseudo)))
        table = []
        for j in range(voters):
            cell = {(y, v): pseudo * (2 if y == v else 1 if v == 0 else 0.5) for y in (-1, 1) for v in VOTES}
            for p, n in patterns.items():
                cell[1, p[j]] += n * post[p]
                cell[-1, p[j]] += n * (1 - post[p])
            table.append(cell)
        model = _model(prior, table)
        new = {p: model.posterior(p) for p in patterns}
        moved = max((abs(new[p] - post[p]) for p in patterns), default=0.0)
        post = new
        if moved < 1e-9:
            break
    return _model(prior, table)


def _model(prior: float, table: list[dict]) -> VoteModel:
    weights, accuracy = [], []
    for cell in table:
        of = {y: sum(cell[y, v] for v in VOTES) for y in (-1, 1)}
        bad, quiet, good = (math.log((cell[1, v] / of[1]) / (cell[-1, v] / of[-1])) for v in VOTES)
        weights.append((min(0.0, bad), quiet, max(0.0, good)))
        spoken = cell[1, 1] + cell[1, -1] + cell[-1, 1] + cell[-1, -1]
        accuracy.append((cell[1, 1] + cell[-1, -1]) / spoken)
    return VoteModel(math.log(prior / (1 - prior)), tuple(weights), tuple(accuracy))
