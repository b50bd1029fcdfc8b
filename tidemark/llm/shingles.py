"""Word shingles of texts as 64-bit hashes, for whole Arrow batches at once."""

from __future__ import annotations

import numpy as np

#: Odd multiplier of the rolling hash, and its inverse modulo 2^64.
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = [np.uint64(int(x) | 1) for x in np.random.default_rng(20240502).integers(1, 1 << 63, 8)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for i, p in enumerate((_P, _INVERSE)):
            _powers[i] = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size - 1, p, np.uint64))))
    return _powers[0], _powers[1]


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of every word, in order; words are runs without ASCII white space, A-Z in lower case."""
    raw = _LOWER[np.frombuffer(text, np.uint8)]
    gap = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(raw) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)])))
    return mixed((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def shingles(text: bytes, words: int = 4) -> np.ndarray:
    """The distinct shingles of `words` words, ascending; a shorter text is one shingle, an empty one has none."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        out = out * _STEP[i] + h[i : len(h) - n + 1 + i]
    return np.unique(mixed(out))
