"""Merging of Burrows-Wheeler transforms by iterative interleave refinement, for bounded sets of strings.

The strings are split over shards. Each shard's suffixes are sorted once (by their first `depth`
bytes) and give its transform: the byte before every suffix, in suffix order. The shards' orders are
then merged without sorting suffixes again: the interleave, which says for every place of the merged
order which shard its suffix comes from, starts as "shard after shard" and is refined one byte a
round. A round reads the shards' transforms along the interleave and sorts the interleave stably by
these bytes, which settles one byte more of context. Places that part in round r have r bytes in
common with the place before: the rounds give the common prefixes, and where these reach `depth`
lie the repeated intervals. No two strings are compared with each other.
"""

from __future__ import annotations

import numpy as np


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of `text`, read as a circle, in the order of their first `depth` (or more) bytes."""
    n = len(text)
    ring = np.concatenate((text, text[: min(n, 8)])) if n >= 8 else np.resize(text, n + 8)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | ring[i : i + n]
    known = 8
    while True:
        order = np.argsort(key, kind="stable")
        if known >= depth:
            return order
        step = np.zeros(n, np.int64)
        ranked = key[order]
        step[1:] = ranked[1:] != ranked[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        key = (rank << 32 | np.roll(rank, -(known % n))).astype(np.uint64)
        known *= 2


def merged_order(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard and place of every suffix of all shards, ordered by the first `depth` bytes; and how many
    bytes, up to `depth`, each has in common with the one before."""
    orders = [sorted_suffixes(t, depth) for t in shards]
    transforms = [t[o - 1] for t, o in zip(shards, orders, strict=True)]
    source = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(t) for t in shards])
    before = np.empty(len(source), np.uint8)
    common = np.full(len(source), depth, np.int16)
    common[:1] = 0
    interval = np.zeros(len(source), np.int32)  # of places whose suffixes agree in the bytes settled so far
    for settled in range(depth):
        for s, b in enumerate(transforms):
            before[source == s] = b
        refined = np.argsort(before, kind="stable")
        source, after = source[refined], interval[refined]
        head = before[refined]
        parts = (head[1:] != head[:-1]) | (after[1:] != after[:-1])
        common[1:][parts & (common[1:] == depth)] = settled
        interval[1:] = np.cumsum(parts, dtype=np.int32)
        if len(interval) and interval[-1] == len(interval) - 1:  # every place stands alone
            break
    place = np.empty(len(source), np.int64)
    for s, o in enumerate(orders):
        place[source == s] = o
    return source, place, common


def least_owner(strings: list[bytes], owner: np.ndarray, shard: np.ndarray, width: int) -> np.ndarray:
    """For each place where a run of `width` bytes starts, string after string: the smallest owner of
    any string that holds the same run. shard: the shard of each string, 0 to 255."""
    parts = [np.flatnonzero(shard == s) for s in np.unique(shard)]
    size = np.array([len(s) for s in strings], np.int64)
    texts = [np.frombuffer(b"".join([strings[i] + b"\0" for i in ids.tolist()]), np.uint8) for ids in parts]
    of = [np.repeat(ids, size[ids] + 1) for ids in parts]
    offset = [np.arange(len(t)) - np.repeat(np.cumsum(size[ids] + 1) - size[ids] - 1, size[ids] + 1) for t, ids in zip(texts, parts, strict=True)]
    source, place, common = merged_order(texts, width)
    at = np.cumsum([0] + [len(t) for t in texts])[:-1][source] + place
    string, start = np.concatenate(of)[at], np.concatenate(offset)[at]
    interval = np.cumsum(common < width)
    full = np.flatnonzero(start <= size[string] - width)  # suffixes with a whole run before their string ends
    string, start, interval = string[full], start[full], interval[full]
    cut = np.flatnonzero(np.concatenate((np.ones(1, bool), interval[1:] != interval[:-1])))
    least = np.repeat(np.minimum.reduceat(owner[string], cut), np.diff(np.append(cut, len(string))))
    runs = size - width + 1
    out = np.empty(int(runs.sum()), np.int64)
    out[(np.cumsum(runs) - runs)[string] + start] = least
    return out
