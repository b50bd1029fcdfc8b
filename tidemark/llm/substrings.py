"""Removal of byte strings that an earlier document holds, with merged Burrows-Wheeler transforms.

Every byte covered by a run of `width` bytes that also starts in a document with a smaller id goes.

1. Anchors: of every run of `width` bytes the k-byte piece with the smallest hash (leftmost on ties).
   Equal runs have the same anchor. An anchor seen in one document only cannot lie in a repeated
   run; the others are found by counting anchor hashes, in blocks by hash.
2. Segments: in each document, around every repeated anchor, the bytes of all runs that it anchors
   (width to 2 * width - k bytes). A task lists its segments in flushes of bounded size: the distinct
   ones, by block of their anchor, each with its smallest document; and, apart, where they stand.
3. Blocks: what tasks hold of one anchor meets in one block, a row a flush and block, so a passage of
   any number of documents is no hot key. Equal segments are one class. The flushes are the shards:
   their classes' Burrows-Wheeler transforms are merged by interleave refinement (see `bwt`), and
   the repeated intervals (common prefixes of `width` bytes) give every run the smallest document
   that holds it. Classes that can have no run in common with another (no other class of the anchor
   agrees in the half of a run to its left or right) need no transform: the run's owner is their own.
4. The answers go back to the flushes, where stretches are put together per document; joined to
   the texts, they are cut out.

An anchor with more than `crowded` holders is listed by its runs, each a segment of its own, so that
no block gets all that is around it; the result is the same.

Hashes only choose candidates; runs are compared by their bytes. Null and empty texts, and texts
under `width` bytes, lose nothing. Rows are told apart by id and text: rows with one id, repeated or
not, take nothing from each other, and each is cut by its own text. Rows with a null id are listed
and neither compared nor cut. Ids are integers. An empty table gives an empty result. Only the id and
text columns are read; other columns can have any name.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import least_owner
from .common import documents, materialize, packed, partitions, small_batches

WIDTH, K = 50, 20
#: Anchors and segments that a task holds before it passes them on; bytes of classes in one merge; holders of an anchor.
HELD, FLUSH, MERGED_BYTES, CROWDED = 1_000_000, 400_000, 2_000_000, 50_000
#: Shards whose transforms are merged at a time.
SHARDS = 4

_FLAG = 1 << 62
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_HALF, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


def _pack(*arrays) -> bytes:
    """Arrays of one job's tasks for another task of it."""
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def _unpack(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def _ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places start, start + 1 and so on, `count` of each."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _narrow(x: np.ndarray) -> np.ndarray:
    """Non-negative numbers in the smallest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x


def piece_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every piece of k bytes, eight bytes at a time."""
    n, m = len(raw), len(raw) - k + 1
    eight = np.ndarray(n, np.uint64, np.concatenate((raw, np.zeros(8, np.uint8))), 0, (1,)).copy()
    if k < 8:
        eight &= np.uint64((1 << 8 * k) - 1)
    h = eight[:m] * _MIX[0]
    for i, at in enumerate([*range(8, k - 7, 8), *([k - 8] if k % 8 and k > 8 else [])]):
        h ^= h >> _HALF
        h += eight[at : at + m]
        h *= _MIX[1 + i % 2]
    h ^= h >> _HALF
    h *= _MIX[2]
    return h ^ (h >> _HALF)


def anchored(raw: np.ndarray, width: int = WIDTH, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """For every run of `width` bytes the place of its anchor; and the hashes of all k-byte pieces."""
    if len(raw) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = piece_hashes(raw, k)
    low, size, pieces = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64), 1, width - k + 1
    while size * 2 <= pieces:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if pieces > size:
        low = np.minimum(low[: size - pieces], low[pieces - size :])
    return (low & _LOW).astype(np.int64), h


def repeated_anchors(texts: DataFrame, bits: int, width: int, k: int, crowded: int) -> DataFrame:
    """(id, hash): anchors of each document that another document holds too, marked by a flag where
    they have more than `crowded` holders. texts: id, text.

    A flush tells the bucket of an anchor how many of its documents hold it, and keeps which. Buckets
    answer each flush with flags, and the flush's own list is spread out where it lies: an anchor of any
    number of documents is one number a flush on the way there and one flag on the way back.
    """
    buckets = 1 << (bits - 32)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, held, count = [], [], 0, 0
        task = TaskContext.get().partitionId() << 32

        def out() -> Iterator[pa.RecordBatch]:
            h = np.concatenate(hashes)
            order = np.argsort(h, kind="stable")
            h, doc = h[order], np.repeat(np.array(ids, np.int64), [len(x) for x in hashes])[order]
            first = _starts(h)
            holders = np.diff(np.append(first, len(h)))
            bucket = (h[first] >> _HALF).astype(np.int64)
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = []
            for b in range(buckets):
                a, z = cut[b], cut[b + 1]
                if a < z:
                    own = slice(first[a], first[z] if z < len(first) else len(h))
                    docs, which = np.unique(doc[own], return_inverse=True)
                    many = _narrow(holders[a:z])
                    rows.append((b, _pack(h[first[a:z]].astype(np.uint32), many), _pack(many, docs[:1], _narrow(np.diff(docs)), _narrow(which))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([task | count] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2)]],
                ["flush", "bucket", "anchors", "holders"])

        for b in batches:
            for doc, text in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True):
                at, h = anchored(np.frombuffer(text.encode(), np.uint8), width, k)
                if len(at):
                    own = np.unique(h[at[_starts(at)]] >> np.uint64(64 - bits))
                    ids.append(doc)
                    hashes.append(own)
                    held += len(own)
            if held > HELD:
                yield from out()
                ids, hashes, held, count = [], [], 0, count + 1
        if held:
            yield from out()

    def match(p: pd.DataFrame) -> pd.DataFrame:
        told = [_unpack(x) for x in p["anchors"]]
        h, many = np.concatenate([x[0] for x in told]), np.concatenate([x[1].astype(np.int64) for x in told])
        order = np.argsort(h, kind="stable")
        first = _starts(h[order])
        total = np.add.reduceat(many[order], first)
        kind = np.empty(len(h), np.uint8)  # 0: in one document, 1: in several, 2: in a crowd
        kind[order] = np.repeat((total > 1).astype(np.uint8) + (total > crowded), np.diff(np.append(first, len(h))))
        cut = np.cumsum([0] + [len(x[0]) for x in told])
        answers = [_pack(kind[a:z], h[a:z][kind[a:z] > 0]) if kind[a:z].any() else None for a, z in zip(cut[:-1], cut[1:], strict=True)]
        return pd.DataFrame({"flush": p["flush"], "bucket": p["bucket"], "kinds": answers})

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for bucket, holders, kinds in b[["bucket", "holders", "kinds"]].itertuples(index=False, name=None):
                (many, least, steps, which), (kind, h) = _unpack(holders), _unpack(kinds)
                docs = np.concatenate((least, least + np.cumsum(steps, dtype=np.int64)))
                again, own = kind > 0, which[np.repeat(kind, many) > 0]
                key = (h.astype(np.int64) | bucket << 32) | np.where(kind[again] > 1, _FLAG, 0)
                yield pd.DataFrame({"id": docs[own], "hash": np.repeat(key, many[again])})

    # written once: flushes are numbered, and their answers must meet the same rows
    rows = materialize(texts.filter("id IS NOT NULL").mapInArrow(collect, "flush long, bucket int, anchors binary, holders binary"))
    asked = rows.select("flush", "bucket", "anchors").groupBy("bucket").applyInPandas(match, "flush long, bucket int, kinds binary")
    kinds = materialize(asked.filter("kinds IS NOT NULL"), free_shuffles=True)
    return rows.select("flush", "bucket", "holders").join(kinds, ["flush", "bucket"]).mapInPandas(spread, "id long, hash long")


def segments(docs: DataFrame, bits: int, width: int, k: int, blocks: int) -> DataFrame:
    """(target, flush, body): a row for every flush and block with the distinct segments whose anchors
    belong to the block (target: the block), and a row for every flush with the places of its segments
    (target: below 0). docs: id, mark, packed text, hashes (of repeated anchors), in a fixed order
    within partitions, so that a task that runs again numbers its segments alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, count = zstandard.ZstdDecompressor().decompress, 0
        known: dict[bytes, int] = {}
        keys, centres, table, entry, held, start = [], [], [], [], [], []

        def out() -> Iterator[pa.RecordBatch]:
            flush = TaskContext.get().partitionId() << 24 | count
            key, centre, pieces = np.array(keys, np.uint64), np.array(centres, np.int64), list(known)
            of, at, first = np.array(entry), np.concatenate(start), np.repeat(np.arange(len(table)), held)
            ids = np.array([t[0] for t in table], np.int64)
            least = np.full(len(pieces), np.iinfo(np.int64).max)
            np.minimum.at(least, of, ids[first])
            block = (key % np.uint64(blocks)).astype(np.int64)
            order = np.lexsort((key, block))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            cut = np.searchsorted(block[order], np.arange(blocks + 1))
            rows = [(-1 - flush, flush, _pack(ids, np.array([t[1] for t in table], np.int64), np.array(held), rank[of].astype(np.uint32), _narrow(at), np.diff(cut)))]
            for b in np.flatnonzero(np.diff(cut)).tolist():
                own = order[cut[b] : cut[b + 1]]
                mine = [pieces[i] for i in own.tolist()]
                rows.append((b, flush, _pack(key[own], _narrow(centre[own]), _narrow(np.array([*map(len, mine)])), least[own], b"".join(mine))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["target", "flush", "body"])

        for b in batches:
            for one, mark, text, wanted in zip(b["id"].to_pylist(), b["mark"].to_pylist(), b["packed"].to_pylist(), b["hashes"], strict=True):
                text = unpack(text)
                at, h = anchored(np.frombuffer(text, np.uint8), width, k)
                if not len(at):
                    continue
                first = _starts(at)
                want = wanted.values.to_numpy()
                bare = (want & ~_FLAG).view(np.uint64)
                order = np.argsort(bare)
                bare, crowd = bare[order], want[order] >= _FLAG
                full = h[at[first]]
                own = full >> np.uint64(64 - bits)
                spot = np.minimum(np.searchsorted(bare, own), len(bare) - 1)
                hit = np.flatnonzero(bare[spot] == own)
                begin, end, split = first[hit], np.append(first[1:], len(at))[hit] - 1 + width, crowd[spot[hit]]
                key, centre = full[hit], at[first][hit] - begin
                if split.any():  # the runs of crowded anchors, each by itself
                    runs = (end - begin)[split] - width + 1
                    alone = _ragged(begin[split], runs)
                    begin, end = np.concatenate((begin[~split], alone)), np.concatenate((end[~split], alone + width))
                    of_run = [int.from_bytes(hashlib.blake2b(text[a : a + width], digest_size=8).digest(), "little") for a in alone.tolist()]
                    key, centre = np.concatenate((key[~split], np.array(of_run, np.uint64))), np.concatenate((centre[~split], np.zeros(len(alone), np.int64)))
                if not len(begin):
                    continue
                before = len(known)
                found = [known.setdefault(text[a:z], len(known)) for a, z in zip(begin.tolist(), end.tolist(), strict=True)]
                if len(known) > before:
                    new, where = np.unique(np.array(found), return_index=True)
                    where = where[new >= before]
                    keys.extend(key[where].tolist())
                    centres.extend(centre[where].tolist())
                table.append((one, mark))
                held.append(len(found))
                entry.extend(found)
                start.append(begin)
                if len(entry) > FLUSH:
                    yield from out()
                    count += 1
                    known = {}
                    keys, centres, table, entry, held, start = [], [], [], [], [], []
        if table:
            yield from out()

    return docs.mapInArrow(run, "target long, flush long, body binary")


def _halves(pieces: list[bytes], key: np.ndarray, centre: np.ndarray, width: int, k: int) -> np.ndarray:
    """Whether another class of the same anchor agrees with a class in half of what a run holds beside
    the anchor, to the left or the right of it. Classes with a common run do."""
    need = (width - k + 1) // 2
    sides = ([], [])
    for piece, one, c in zip(pieces, key.tolist(), centre.tolist(), strict=True):
        sides[0].append((one, piece[c - need : c]) if c >= need else None)
        sides[1].append((one, piece[c + k : c + k + need]) if c + k + need <= len(piece) else None)
    out = np.zeros(len(pieces), bool)
    for side in sides:
        n = Counter(side)
        del n[None]
        out |= np.array([n[x] > 1 for x in side], bool)
    return out


def smallest_holders(pieces: list[bytes], key: np.ndarray, centre: np.ndarray, least: np.ndarray, shard: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the runs of each class, in order, the smallest document that holds each: number of stretches
    with one owner, and of all stretches the lengths and owners."""
    size = np.array([*map(len, pieces)], np.int64)
    order = np.argsort(key, kind="stable")
    same = np.diff(np.append(_starts(key[order]), len(key)))
    among = np.zeros(len(key), bool)
    among[order] = np.repeat(same > 1, same)
    some = np.flatnonzero(among)
    some = some[_halves([pieces[i] for i in some.tolist()], key[some], centre[some], width, k)] if len(some) else some
    some = some[np.argsort(key[some], kind="stable")]
    # merges of bounded size; all classes of an anchor are in one
    part = np.cumsum(size[some]) // MERGED_BYTES
    part = part[_starts(key[some])].repeat(np.diff(np.append(_starts(key[some]), len(some)))) if len(some) else part
    counts, lengths, owners = np.ones(len(key), np.int64), {}, {}
    for mine in np.split(some, _starts(part)[1:]) if len(some) else []:
        owner = least_owner([pieces[i] for i in mine.tolist()], least[mine], shard[mine], width)
        runs = size[mine] - width + 1
        begin = np.cumsum(runs) - runs
        edge = np.union1d(_starts(owner), begin)
        n = np.diff(np.append(edge, len(owner)))
        at = np.searchsorted(edge, begin)
        for i, a, z in zip(mine.tolist(), at.tolist(), np.append(at[1:], len(edge)).tolist(), strict=True):
            counts[i], lengths[i], owners[i] = z - a, n[a:z], owner[edge[a:z]]
    first = np.cumsum(counts) - counts
    all_lengths, all_owners = np.empty(int(counts.sum()), np.int64), np.empty(int(counts.sum()), np.int64)
    all_lengths[first], all_owners[first] = size - width + 1, least
    for i in lengths:
        all_lengths[first[i] : first[i] + counts[i]], all_owners[first[i] : first[i] + counts[i]] = lengths[i], owners[i]
    return counts, all_lengths, all_owners


def answered(found: DataFrame, width: int, k: int) -> DataFrame:
    """(flush, block, body): the owners of every flush's segments, block by block, and the flush's places (block -1)."""

    def decide(p: pd.DataFrame) -> pd.DataFrame:
        if p["target"].iloc[0] < 0:
            return pd.DataFrame({"flush": p["flush"], "block": -1, "body": p["body"]})
        known: dict[bytes, int] = {}
        of, key, centre, least, shard = [], [], [], [], []
        p = p.sort_values("flush", ignore_index=True)
        for n, body in enumerate(p["body"]):
            keys, centres, sizes, ids, text = _unpack(body)
            stop = np.cumsum(sizes, dtype=np.int64)
            before = len(known)
            own = np.array([known.setdefault(text[a:z], len(known)) for a, z in zip((stop - sizes).tolist(), stop.tolist(), strict=True)])
            new, where = np.unique(own, return_index=True)
            where = where[new >= before]
            of.append(own)
            key.append(keys[where])
            centre.append(centres[where].astype(np.int64))
            shard.append(np.full(len(where), n % SHARDS, np.uint8))
            least.append(ids)
        all_of = np.concatenate(of)
        smallest = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(smallest, all_of, np.concatenate(least))
        counts, lengths, owners = smallest_holders(list(known), np.concatenate(key), np.concatenate(centre), smallest, np.concatenate(shard), width, k)
        first = np.cumsum(counts) - counts
        bodies = [_pack(_narrow(counts[own]), _narrow(lengths[at := _ragged(first[own], counts[own])]), owners[at]) for own in of]
        return pd.DataFrame({"flush": p["flush"], "block": p["target"], "body": bodies})

    return found.groupBy("target").applyInPandas(decide, "flush long, block long, body binary")


def cuts(answers: DataFrame, width: int) -> DataFrame:
    """(id, mark, gone): for each document of a flush that loses something, start and stop of the
    stretches, in order and apart from each other, as 64-bit integers."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("block")
        ids, marks, per_doc, entry, start, per_block = _unpack(p["body"].iloc[0])
        if list(p["block"].iloc[1:]) != np.flatnonzero(per_block).tolist():
            raise ValueError("a flush and its answers do not belong together")
        answers = [_unpack(x) for x in p["body"].iloc[1:]]
        counts, lengths, owners = (np.concatenate([a[i].astype(np.int64) for a in answers]) for i in range(3))
        first = np.cumsum(counts) - counts
        entry = entry.astype(np.int64)
        at = _ragged(first[entry], counts[entry])
        stop_run = np.cumsum(lengths)
        begin_run = stop_run - lengths - np.repeat((stop_run - lengths)[first], counts)  # within its segment
        doc, base = (np.repeat(x, counts[entry]) for x in (np.repeat(np.arange(len(ids)), per_doc), start.astype(np.int64)))
        later = ids[doc] > owners[at]
        doc, begin, n = doc[later], (base + begin_run[at])[later], lengths[at][later]
        order = np.lexsort((begin, doc))
        doc, begin, stop = doc[order], begin[order], (begin + n + width - 1)[order]
        wide = int(stop.max(initial=0)) + 1
        reach = np.maximum.accumulate(doc * wide + stop)
        apart = np.flatnonzero(np.concatenate((np.ones(1, bool), (doc * wide + begin)[1:] > reach[:-1]))) if len(doc) else doc
        pairs = np.column_stack((begin[apart], reach[np.append(apart[1:], len(doc))[: len(apart)] - 1] - doc[apart] * wide))
        new = _starts(doc[apart])
        return pd.DataFrame({"id": ids[doc[apart][new]], "mark": marks[doc[apart][new]], "gone": [x.astype("<i8").tobytes() for x in np.split(pairs, new[1:])] if len(new) else []})

    return answers.groupBy("flush").applyInPandas(run, "id long, mark long, gone binary")


def removal(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, k: int = K, crowded: int = CROWDED, with_text: bool = False) -> DataFrame:
    """One row per row: id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked for.

    Blocks follow spark.sql.shuffle.partitions, which should be set by the size of the table."""
    spark = df.sparkSession
    small_batches(spark)
    shuffled = partitions(spark)
    bits, blocks = 32 + max(4, (4 * shuffled - 1).bit_length()), 4 * shuffled
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = docs.select("id", F.xxhash64("text").alias("mark"), packed(F.col("text")).alias("packed"))

    wanted = repeated_anchors(docs, bits, width, k, crowded).groupBy("id").agg(F.collect_list("hash").alias("hashes"))
    held = texts.filter("id IS NOT NULL").join(wanted.hint("shuffle_hash"), "id").sortWithinPartitions("id", "mark")
    answers = materialize(answered(segments(held, bits, width, k, blocks), width, k), free_shuffles=True)
    # a repeated row's stretches are found once for each of its rows
    gone = cuts(answers, width).dropDuplicates(["id", "mark"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, sha = zstandard.ZstdDecompressor().decompress, hashlib.sha256
        for b in batches:
            rows = []
            for text, spans in zip(map(unpack, b["packed"].to_pylist()), b["gone"].to_pylist(), strict=True):
                pairs = np.frombuffer(spans or b"", "<i8").reshape(-1, 2).tolist()
                last, kept = 0, []
                for start, stop in pairs:
                    kept.append(text[last:start])
                    last = stop
                kept = b"".join([*kept, text[last:]])
                rows.append((len(text), len(text) - len(kept), len(pairs), sha(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: 5 if with_text else 4]
            yield pa.RecordBatch.from_arrays([b["id"], *[pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]], ["id", "n", "removed", "spans", "sha", "kept"][: 1 + len(kinds)])

    joined = texts.join(gone.hint("shuffle_hash"), ["id", "mark"], "left")
    out = joined.mapInArrow(cut, "id long, n long, removed long, spans long, sha string" + (", kept binary" if with_text else ""))
    return out.toDF(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_bytes"] if with_text else []))


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes of `documents` that an earlier document holds, cut out."""
    return removal(documents(spark, sf_dir))
