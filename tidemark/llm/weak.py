"""Weak supervision: how reliable overlapping labelers are, estimated without labels."""

from __future__ import annotations

import numpy as np

#: Weight, as a part of a labeler's votes, of the belief that it is right four times out of five (prior of estimate()).
PRIOR = 0.02


def estimate(counts: dict[tuple, int], labelers: int, rounds: int = 200, in_favour: float = 2.0, against: float = 2.0, balance: float | None = None, prior: float = PRIOR) -> tuple[float, np.ndarray, dict[tuple, float]]:
    """Expectation-maximisation over counts of vote patterns (each vote -1, 0 or 1; labelers independent
    given the class; 0 is an abstention, which says nothing of the class).

    Returns the share of the positive class, P(vote | class, no abstention) as an array [labeler, class, 0: against, 1: in favour], and the
    posterior of every pattern. It starts from the votes, weighed by in_favour and against (log odds of a
    vote), so that 1 means the positive class. With a balance, the share is given rather than estimated: where most items
    have few votes, an estimated one can swallow the smaller class.
    """
    if not counts:
        return 0.5, np.full((labelers, 2, 2), 1 / 2), {}
    patterns = sorted(counts)
    x, n = np.array(patterns), np.array([counts[p] for p in patterns], float)
    post = 1 / (1 + np.exp(-np.clip(in_favour * (x > 0).sum(1) - against * (x < 0).sum(1), -30, 30)))
    share, rates = 0.5, np.full((labelers, 2, 2), 1 / 2)
    for _ in range(rounds):
        share = balance or min(max(float((n * post).sum() / n.sum()), 1e-3), 1 - 1e-3)
        for k in range(labelers):
            cast = float(n[x[:, k] != 0].sum())
            for c, weight in enumerate((n * (1 - post), n * post)):
                better = prior * cast * np.array([0.8 - 0.6 * c, 0.2 + 0.6 * c])  # a labeler is better than chance
                got = np.array([weight[x[:, k] == v].sum() for v in (-1, 1)]) + better + 0.1
                rates[k, c] = got / got.sum()
        odds = np.log(share / (1 - share)) + sum(np.where(x[:, k] == 0, 0.0, np.log(rates[k, 1] / rates[k, 0])[(x[:, k] > 0).astype(int)]) for k in range(labelers))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        rested = np.abs(new - post).max() < 1e-6
        post = new
        if rested:
            break
    return share, rates, dict(zip(patterns, post.tolist()))
