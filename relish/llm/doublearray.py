"""A trie in two arrays: from state ``s`` the digit ``c`` leads to ``base[s] + c`` if ``check`` says ``s`` there.

Symbols are 1, 2, ...; each is two digits of a base near the square root of their number, so that a node's children span few
slots and the arrays stay dense.  The root is state 0 and its base is 0.  Many walkers take a step together as array look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FREE = -1
#: nodes of more children than this are placed one by one, before the others
WIDE = 8
_LOOK = 4096


@dataclass(frozen=True)
class Trie:
    base: np.ndarray
    check: np.ndarray
    radix: int

    @property
    def size(self) -> int:
        return len(self.base)

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which walkers go on by their symbol (0 is none), and the states of those."""
        on = np.flatnonzero(symbols)
        states = states[on]
        for high in (True, False):
            digits = (symbols[on] // self.radix if high else symbols[on] % self.radix) + 1
            to = np.clip(self.base[states] + digits, 0, len(self.base) - 1)
            hit = np.flatnonzero(self.check[to] == states)
            on, states = on[hit], to[hit]
        return on, states


class _Arrays:
    """The two arrays while children are placed; the last slot is never given away."""

    def __init__(self, digits: int) -> None:
        self.base = np.zeros(digits + 1, dtype=np.int32)
        self.check = np.full(digits + 1, FREE, dtype=np.int32)
        self.low = self.near = digits + 1
        self.width, self.random = 0, np.random.default_rng(0)

    def reach(self, slot: int) -> None:
        if slot >= len(self.check):
            more = max(slot + 1, len(self.check) * 5 // 4) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, dtype=np.int32)])
            self.check = np.concatenate([self.check, np.full(more, FREE, dtype=np.int32)])

    def fit(self, symbols: np.ndarray) -> int:
        """A base that has a free slot for each of the ascending digits: the first behind the last node of about that width."""
        if 2 * len(symbols) < self.width:
            self.near, self.width = self.low, len(symbols)
        at = self.near
        while True:
            self.reach(at + _LOOK + int(symbols[-1] - symbols[0]))
            bases = at + np.flatnonzero(self.check[at : at + _LOOK] == FREE) - symbols[0]
            if at == self.low and len(bases) < _LOOK // 32:
                self.low += _LOOK
            for some in np.array_split(symbols, len(symbols) // 8 + 1):
                bases = bases[(self.check[bases[:, None] + some] == FREE).all(axis=1)]
            if len(bases):
                self.near = at
                return int(bases[0])
            at += _LOOK

    def scatter(self, symbols: np.ndarray) -> np.ndarray:
        """Bases of nodes with equally many children, a row of ascending symbols each: free slots are drawn until all fit."""
        bases, left, room = np.empty(len(symbols), dtype=np.int64), np.arange(len(symbols)), 4 * symbols.size + _LOOK
        while len(left):
            self.reach(self.low + room)
            free = self.low + np.flatnonzero(self.check[self.low : self.low + room] == FREE)
            if len(free) < 2 * len(left) * symbols.shape[1]:
                room *= 2
                continue
            drawn = free[self.random.integers(0, len(free), len(left))] - symbols[left, 0]
            slots = drawn[:, None] + symbols[left]
            self.reach(int(slots.max()) + 1)
            fits = np.flatnonzero((self.check[slots] == FREE).all(axis=1))
            _, first = np.unique(slots[fits], return_index=True)
            alone = np.zeros(slots[fits].size, dtype=bool)
            alone[first] = True
            fits = fits[alone.reshape(slots[fits].shape).all(axis=1)]
            if 50 * len(fits) < len(left):
                room *= 2
            bases[left[fits]] = drawn[fits]
            self.check[slots[fits]] = 0  # taken; the parent is written by the caller
            left = np.delete(left, fits)
        return bases

    def place(self, parents: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """States of distinct (parent, digit) edges, sorted by both."""
        first = np.flatnonzero(np.diff(parents, prepend=-2))
        width = np.diff(first, append=len(parents))
        bases = np.empty(len(first), dtype=np.int64)
        wide = np.flatnonzero(width > WIDE)
        self.near, self.width = self.low, int(width.max(initial=0))
        for g in wide[np.argsort(-width[wide], kind="stable")]:
            own = symbols[first[g] : first[g] + width[g]]
            bases[g] = self.fit(own)
            self.check[bases[g] + own] = 0
        for size in np.unique(width[width <= WIDE])[::-1]:
            same = np.flatnonzero(width == size)
            bases[same] = self.scatter(symbols[first[same][:, None] + np.arange(size)])
        states = np.repeat(bases, width) + symbols
        self.check[states] = parents
        self.base[parents[first]] = bases
        return states


def build(paths: np.ndarray, symbols: int) -> tuple[Trie, np.ndarray]:
    """The trie of the rows of ``paths`` (symbols 1 to ``symbols``, 0 behind the end of a path), and each row's last state."""
    radix = int(np.sqrt(symbols)) + 1
    arrays = _Arrays(radix + 1)
    ends, rows, states = np.zeros(len(paths), dtype=np.int64), np.arange(len(paths)), np.zeros(len(paths), dtype=np.int64)
    for depth in range(paths.shape[1]):
        longer = paths[rows, depth] > 0
        rows, states = rows[longer], states[longer]
        if not len(rows):
            break
        for high in (True, False):
            digits = (paths[rows, depth] // radix if high else paths[rows, depth] % radix) + 1
            edges, edge_of = np.unique(states * (radix + 2) + digits, return_inverse=True)
            parents, codes = edges // (radix + 2), edges % (radix + 2)
            if depth == 0 and high:
                arrays.check[codes] = 0
                states = codes[edge_of]
            else:
                states = arrays.place(parents, codes)[edge_of]
        ends[rows] = states
    arrays.reach(len(arrays.check))
    size = int(np.flatnonzero(arrays.check != FREE).max(initial=0)) + 2
    return Trie(arrays.base[:size].copy(), arrays.check[:size].copy(), radix), ends
