"""Context-tree weighting over binary-decomposed bytes: counts, weights and probabilities of whole tables of contexts.

A gram is a byte with its ``depth`` bytes before it, packed as context * 256 + byte, where the byte just before stands
highest in the context.  A byte is eight binary decisions; the decision after the first i bits has a tree of its own,
whose nodes are the contexts of 0 to ``depth`` bytes.  A node's key at decision i is context * 2^i + the i bits.

A node's Krichevsky-Trofimov probability of all its training bits needs only their counts; the weighted probability of a
node mixes it, half and half, with the product of its children's weighted ones.  So the whole tree follows from gram
counts, level by level, in any order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

HALF = np.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 0.5, by Stirling's series seven steps up."""
    rise = np.log(x * (x + 1) * (x + 2)) + np.log((x + 3) * (x + 4) * (x + 5) * (x + 6))
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - rise


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability that the estimator gives to n0 zeros and n1 ones, in any order."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


@dataclass
class Level:
    """Nodes of one context length at one decision, in order of key."""

    key: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    estimate: np.ndarray  # log KT probability
    weighted: np.ndarray  # log weighted probability

    def own_weight(self) -> np.ndarray:
        """Share of the node's own estimate in its weighted probability."""
        return np.exp(np.minimum(0.0, HALF + self.estimate - self.weighted))

    def one(self) -> np.ndarray:
        """KT estimate of a one."""
        return (self.n1 + 0.5) / (self.n0 + self.n1 + 1.0)


def leaves(grams: np.ndarray, counts: np.ndarray, i: int) -> Level:
    """The deepest nodes at decision i; ``grams`` sorted."""
    key, bit = grams >> (8 - i), (grams >> (7 - i)) & 1
    first = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    n1 = np.add.reduceat(counts * bit, first).astype(np.float64)
    n0 = np.add.reduceat(counts * (1 - bit), first).astype(np.float64)
    estimate = kt(n0, n1)
    return Level(key[first], n0, n1, estimate, estimate)


def parent_key(key: np.ndarray, i: int) -> np.ndarray:
    """Key of the node with a context shorter by its oldest byte."""
    return (key >> (i + 8) << i) | (key & ((1 << i) - 1))


def parents(key: np.ndarray, n0: np.ndarray, n1: np.ndarray, weighted: np.ndarray) -> Level:
    """Nodes from their children's sums; ``key`` may repeat."""
    own, at = np.unique(key, return_inverse=True)
    zeros, ones, product = (np.bincount(at, weights=x, minlength=len(own)) for x in (n0, n1, weighted))
    estimate = kt(zeros, ones)
    return Level(own, zeros, ones, estimate, HALF + np.logaddexp(estimate, product))


@dataclass
class Path:
    """What the nodes from the root down to some level say of a one: the mixed part, the weight left, the last estimate."""

    key: np.ndarray
    mixed: np.ndarray
    left: np.ndarray
    last: np.ndarray


def descend(level: Level, above: Path | None, i: int, deepest: bool) -> Path:
    """Extend the paths by a level.  A node that training never came to has no say: its parent's estimate takes the weight left."""
    if above is None:
        mixed, left, last = np.zeros(len(level.key)), np.ones(len(level.key)), np.full(len(level.key), 0.5)
    else:
        at = np.searchsorted(above.key, parent_key(level.key, i))
        mixed, left, last = above.mixed[at], above.left[at], above.last[at]
    seen = (level.n0 + level.n1) > 0
    own = np.where(seen, level.one(), last)
    weight = np.where(seen & ~np.bool_(deepest), level.own_weight(), 1.0)
    return Path(level.key, mixed + left * weight * own, left * (1 - weight), own)


def subtree(grams: np.ndarray, counts: np.ndarray, depth: int, top: int, i: int) -> list[Level]:
    """Levels of context length ``depth`` down to ``top`` at decision i."""
    out = [leaves(grams, counts, i)]
    for _ in range(depth - top):
        below = out[-1]
        out.append(parents(parent_key(below.key, i), below.n0, below.n1, below.weighted))
    return out
