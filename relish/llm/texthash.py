"""Hashes of words, word shingles and byte strings of one text, worked out as whole arrays.

A text is its UTF-8 bytes.  Every byte stands for a random 64-bit value; the prefix sums of the values times the
powers of an odd base give the hash of any stretch in constant time, wherever it stands.  A last mixing step spreads
the bits.  Hashes have 64 bits and are taken for the strings themselves; 0xFFFF... is never one of them.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
LAST = U64(0xFFFFFFFFFFFFFFFF)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of ``h`` over the whole word."""
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(29))) * U64(0xA5CB9243F2CED4C5)
    h = h ^ (h >> U64(32))
    return np.minimum(h, LAST - U64(1))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base))
    out[0] = U64(1)
    return np.multiply.accumulate(out)


_SYMBOLS = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_grown: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n-1 at least of the base and of its inverse; those of short texts are kept."""
    if "up" not in _grown or len(_grown["up"]) < n:
        size = 1 << max(14, (n - 1).bit_length())
        up, down = _powers(_BASE, size), _powers(_INVERSE, size)
        if size > 1 << 21:
            return up, down
        _grown.update(up=up, down=down)
    return _grown["up"], _grown["down"]


def lower(data: bytes | memoryview) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[np.frombuffer(data, dtype=np.uint8)]


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """n + 1 sums of the symbols' values times the base's powers."""
    up, _ = powers(len(symbols) + 1)
    out = np.zeros(len(symbols) + 1, dtype=U64)
    np.cumsum(_SYMBOLS[symbols] * up[: len(symbols)], out=out[1:])
    return out


def stretches(sums: np.ndarray, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Hashes of the stretches of the given starts and lengths (not 0)."""
    _, down = powers(len(sums))
    return mix((sums[starts + lengths] - sums[starts]) * down[starts] + np.asarray(lengths).astype(U64))


def byte_class(pattern: str) -> np.ndarray:
    """For each byte whether it may stand in a word: ``spaced`` (no white space) or ``alnum`` (a-z, 0-9, beyond ASCII)."""
    member = np.ones(256, dtype=bool)
    if pattern == "spaced":
        member[[0x20, *range(0x09, 0x0E)]] = False
    else:
        member[:0x80] = False
        member[0x30:0x3A] = member[0x61:0x7B] = True
    return member


SPACED, ALNUM = byte_class("spaced"), byte_class("alnum")


def words(text: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of word bytes."""
    edge = np.flatnonzero(np.diff(member[text], prepend=False, append=False))
    return edge[::2], edge[1::2]


def word_hashes(data: bytes | memoryview, member: np.ndarray) -> np.ndarray:
    """One hash for each word of the text, A-Z in lower case."""
    text = lower(data)
    starts, ends = words(text, member)
    return stretches(prefix_sums(text), starts, ends - starts) if len(starts) else np.empty(0, dtype=U64)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive items."""
    if len(hashes) < n:
        return np.empty(0, dtype=U64)
    count = len(hashes) - n + 1
    out = np.zeros(count, dtype=U64)
    for j in range(n):
        out = (out + hashes[j : j + count]) * U64(_BASE)
    return mix(out + U64(n))


def shingle_set(data: bytes | memoryview, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; with fewer words the whole sequence is one."""
    hashes = word_hashes(data, SPACED)
    return np.unique(shingles(hashes, min(n, len(hashes)))) if len(hashes) else hashes
