"""A bidirectional FM-index over word ids, for phrases of a few words.

A sequence holds ids from 1 on, cut by the separator 0, and ends with 0. It is read as a circle. Its
places are put in the order of their first `depth` ids; the id before every place, in that order, is
the transform. All places of a phrase are one interval of the order. A backward step finds the
interval of (word, phrase) from that of the phrase. The same over the reversed sequence gives the
words that follow; both intervals of a phrase are kept in step (they have the same size, and the
reversed one moves by the number of smaller ids that were seen before the phrase).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class Transform:
    """One direction: places in order, the id before each, and what a backward step needs."""

    def __init__(self, seq: np.ndarray, depth: int):
        n = len(seq)
        width = max(1, int(seq.max()).bit_length())
        ring = np.concatenate((seq, np.resize(seq, depth))).astype(np.int64)
        keys, at = [], 0
        while at < depth:
            many = min(62 // width, depth - at)
            key = np.zeros(n, np.int64)
            for i in range(at, at + many):
                key = key << width | ring[i : i + n]
            keys.append(key)
            at += many
        self.order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
        self.before = seq[self.order - 1].astype(np.int64)
        by_id = np.argsort(self.before, kind="stable")
        self.span = n + 1
        self.keys = self.before[by_id] * self.span + by_id
        self.changes = np.concatenate(([0], np.cumsum(self.before[1:] != self.before[:-1])))

    def step(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Start of the interval of (word, phrase), given the start of the phrase's."""
        return np.searchsorted(self.keys, word * self.span + place)

    def only(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The id before every place of the interval if it is one id, else 0."""
        return np.where(self.changes[hi - 1] == self.changes[lo], self.before[lo], 0)


@dataclass
class Phrases:
    """Phrases of one length: intervals [lo, hi) of the order and the start of the reversed interval."""

    lo: np.ndarray
    hi: np.ndarray
    back: np.ndarray

    def take(self, which: np.ndarray) -> Phrases:
        return Phrases(self.lo[which], self.hi[which], self.back[which])


class Index:
    """Both directions of a sequence."""

    def __init__(self, seq: np.ndarray, depth: int):
        self.seq, self.forward, self.reverse = seq, Transform(seq, depth), Transform(seq[::-1], depth)

    def words(self) -> Phrases:
        """All phrases of one word that occur."""
        ids = np.unique(self.seq)
        ids = ids[ids > 0].astype(np.int64)
        lo, hi = self.forward.step(ids, np.zeros_like(ids)), self.forward.step(ids + 1, np.zeros_like(ids))
        return Phrases(lo, hi, lo.copy())

    def places(self, p: Phrases) -> np.ndarray:
        """A place of the sequence at which each phrase stands."""
        return self.forward.order[p.lo]

    def longer(self, p: Phrases) -> Phrases:
        """All phrases made of a word and one of `p` whose words but the last are in `p` too, in order."""
        size = p.hi - p.lo
        owner = np.repeat(np.arange(len(size)), size)
        rows = np.arange(len(owner)) + np.repeat(p.lo - np.cumsum(size) + size, size)
        pairs = np.sort(owner << 32 | self.forward.before[rows])
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(pairs)), bool), pairs[1:] != pairs[:-1])))
        count = np.diff(np.append(first, len(pairs)))
        owner, word = pairs[first] >> 32, pairs[first] & 0xFFFFFFFF
        back = p.back[owner] + first - (np.cumsum(size) - size)[owner]  # ids smaller than the word come first
        real = word > 0
        owner, word, count, back = owner[real], word[real], count[real], back[real]
        lo = self.forward.step(word, p.lo[owner])
        order = np.argsort(lo)
        lo, hi, back = lo[order], lo[order] + count[order], back[order]
        head = np.searchsorted(p.lo, lo, side="right") - 1  # the interval of all words but the last lies around
        inside = (head >= 0) & (p.hi[head] >= hi) if len(p.lo) else np.zeros(0, bool)
        return Phrases(lo, hi, back).take(inside)

    def only_before(self, p: Phrases) -> np.ndarray:
        """The word that stands before each phrase at every place, or 0."""
        return self.forward.only(p.lo, p.hi)

    def only_after(self, p: Phrases) -> np.ndarray:
        """The word that follows each phrase at every place, or 0."""
        return self.reverse.only(p.back, p.back + p.hi - p.lo)
