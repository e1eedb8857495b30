"""Vectorised 64-bit fingerprints of words: no loop over words, a few array operations per byte."""

from __future__ import annotations

from functools import cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@cache
def _bytes_table() -> tuple[np.ndarray, np.ndarray]:
    """A random value of each byte, upper case A-Z like lower case; which bytes separate words."""
    values = np.random.default_rng(64).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    separates = np.zeros(256, bool)
    separates[[32, *range(9, 14)]] = True
    return values, separates


_powers = np.ones(1, np.uint64)


def _powers_of(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 256), _BASE, np.uint64))])
    return _powers


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words, A-Z lower-cased, in order; and where each text's words begin, with the end."""
    data = [t.encode() for t in texts]
    sizes = np.fromiter(map(len, data), np.int64, len(data)) + 1
    raw = np.frombuffer(b" ".join([*data, b""]), np.uint8)
    values, separates = _bytes_table()
    inside = np.concatenate([[False], ~separates[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = edges[::2], edges[1::2]
    limits = np.concatenate([[0], np.cumsum(sizes)])
    of_text = np.searchsorted(begins, limits)
    if not len(begins):
        return np.empty(0, np.uint64), of_text
    lengths = ends - begins
    at = np.flatnonzero(inside[1:-1])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(at)) - np.repeat(first, lengths)
    sums = np.add.reduceat(values[raw[at]] * _powers_of(int(lengths.max()))[place], first)
    return mixed(sums + lengths.astype(np.uint64)), of_text


def joined_hash(*parts: np.ndarray) -> np.ndarray:
    """A fingerprint of a sequence of fingerprints."""
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        out = mixed(out * _BASE + p)
    return out


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct fingerprints of runs of n words; of fewer words, the whole sequence; of none, none."""
    if not len(words):
        return words
    m = min(n, len(words))
    return np.unique(joined_hash(*(words[i : len(words) - m + 1 + i] for i in range(m))))
