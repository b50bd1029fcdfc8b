"""BPE encoding and decoding by batched numpy merge rounds.

White space separates the pieces of this tokenizer family, so a text's ids are those of its words,
one after another. A task keeps the words it has met; the unknown words of an Arrow
batch are encoded together: their symbols lie in one flat array, and in each round the merge rank of
every neighbouring pair is found by binary search over the sorted pair keys, the leftmost pair of
lowest rank of each word is merged, and words with nothing left to merge drop out. The rank order
and the choice of the leftmost pair are those of the tokenizers library.

Normalisation (NFC, then lower case by code point) and the split into letters, single digits and
other marks follow the tokenizer file; special tokens in a text are found before normalisation, as
that library does. The vocabulary file is a parameter, opened by every worker: it must be installed
on all machines.

Null and empty texts have no ids and decode to the empty text. A very long text costs memory in
proportion to its length, one Arrow batch at a time. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import documents, small_batches

#: Words a task keeps before it starts afresh.
CACHED_WORDS = 600_000
#: Controls at which str.split parts a text although they are not Unicode white space.
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def words_of(text: str) -> list[str]:
    """The maximal runs without Unicode white space."""
    return [w for w in _SPACE.split(text) if w] if _ODD_SPACE.search(text) else text.split()


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class Encoder:
    """One vocabulary file, and the words encoded so far."""

    loaded: dict[tuple[str, bool], Encoder] = {}

    @classmethod
    def of(cls, path: str, texts: bool = True) -> Encoder:
        """The worker's encoder of this file. texts: keep decoded words beside the ids."""
        if (path, texts) not in cls.loaded:
            cls.loaded[path, texts] = cls(path, texts)
        return cls.loaded[path, texts]

    @classmethod
    @contextmanager
    def for_task(cls, path: str, texts: bool = True) -> Iterator[Encoder]:
        """The worker's encoder for one task. The words met go when the task ends: the worker lives on, in
        tasks that encode nothing, and they would take memory from those."""
        own = cls.of(path, texts)
        try:
            yield own
        finally:
            own.known, own.older = {}, {}

    def __init__(self, path: str, texts: bool = True):
        self.texts = texts
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.suffix = suffix = spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        self.size = size
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        key = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        by_key = np.argsort(key)
        self.key, self.rank, self.made = key[by_key], by_key.astype(np.int64), made[by_key]
        self.piece = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|\n|[^\n\p{L}\p{N}]+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # the pairs of single bytes, which every word starts with, are looked up once for all
        firsts = np.concatenate((self.inner, self.last))
        self.byte_at, self.byte_rank = self.find((self.inner[:, None] * size + firsts[None, :]).ravel())
        #: Words met lately, and those met before them: when the first are too many they take the place of the second.
        self.known: dict = {}
        self.older: dict = {}


    def find(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the sorted merge table, and rank, of pair keys; rank len(key) where there is none."""
        at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        return at, np.where(self.key[at] == pair, self.rank[at], len(self.key))

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the pieces, and how many each has."""
        n = np.array([*map(len, pieces)], np.int64)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.inner[raw]
        end = np.cumsum(n)
        ids[end - 1] = self.last[raw[end - 1]]
        word = np.repeat(np.arange(len(pieces)), n)
        none = len(self.key)

        done_ids, done_word = [], []
        final = np.zeros(len(raw), bool)
        final[end - 1] = True
        pair = raw[:-1].astype(np.int64) * 512 + raw[1:] + 256 * final[1:]
        at, rank = np.append(self.byte_at[pair], 0), np.append(self.byte_rank[pair], none)
        rank[final] = none
        while len(ids):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            # the lowest rank of each word, at its leftmost place
            low = np.minimum.reduceat(rank * len(ids) + np.arange(len(ids)), first)
            live = low < none * len(ids)
            over = np.repeat(~live, np.diff(np.append(first, len(ids))))
            done_ids.append(ids[over])
            done_word.append(word[over])
            place = low[live] % len(ids)
            ids[place] = self.made[at[place]]
            stay = ~over
            stay[place + 1] = False
            ids, word, at, rank = ids[stay], word[stay], at[stay], rank[stay]
            place = (np.cumsum(stay) - 1)[place]
            changed = np.concatenate((place, place[place > 0] - 1))
            if len(changed):
                right = np.minimum(changed + 1, len(ids) - 1)
                at[changed], ranks = self.find(ids[changed] * self.size + ids[right])
                rank[changed] = np.where((word[changed] == word[right]) & (right > changed), ranks, none)
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(pieces))

    def learn(self, words: list[str]) -> None:
        """Encode words that are not kept yet."""
        if not words:
            return
        if self.cut:
            for w in words:
                if "<" in w and self.cut.search(w):
                    parts = [p for p in self.cut.split(w) if p]
                    self.learn([p for p in parts if p not in self.special])
                    each = [self.entry(self.special[p].to_bytes(4, "little"), [p]) if p in self.special else self.known[p] for p in parts]
                    self.known[w] = self.joined(each)
            words = [w for w in words if w not in self.known]
        # all words at once, a line each: normalised, and split as the tokenizer does before merging
        text = "\n".join(words)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        found = self.piece.findall(text + "\n")
        pieces = [p.encode() for p in found if p != "\n"]
        if not pieces:
            self.known.update((w, self.entry(b"", [])) for w in words)
            return
        ids, n = self.merged(pieces)
        ends = np.flatnonzero(np.array([p == "\n" for p in found]))
        stops = np.append(0, np.cumsum(n))[ends - np.arange(len(ends))].tolist()
        raw, a = ids.astype("<u4").tobytes(), 0
        if self.texts:
            tokens = [*map(self.token.__getitem__, ids.tolist())]
            for w, b in zip(words, stops, strict=True):
                self.known[w] = raw[4 * a : 4 * b], " ".join(tokens[a:b]).encode()
                a = b
        else:
            for w, b in zip(words, stops, strict=True):
                self.known[w] = raw[4 * a : 4 * b]
                a = b

    def entry(self, ids: bytes, tokens: list[str]):
        return (ids, " ".join(tokens).encode()) if self.texts else ids

    def joined(self, each: list):
        if not self.texts:
            return b"".join(each)
        return b"".join([x[0] for x in each]), b" ".join([x[1] for x in each if x[1]])

    def parts(self, texts: list[str]) -> list[list]:
        """For each text what is kept of its words, in order; new words are learnt together."""
        if len(self.known) > CACHED_WORDS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        split = [words_of(t) for t in texts]
        out = [[*map(known.get, ws)] for ws in split]
        gaps = [i for i, found in enumerate(out) if None in found]
        if gaps:
            missing = set().union(*[[w for w, x in zip(split[i], out[i], strict=True) if x is None] for i in gaps])
            known.update([(w, older[w]) for w in missing if w in older])
            self.learn([w for w in missing if w not in known])
            for i in gaps:
                out[i] = [known[w] if x is None else x for w, x in zip(split[i], out[i], strict=True)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        return [b"".join([x[0] for x in found] if self.texts else found) for found in self.parts(texts)]

    def both(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """For each text its ids, as `encode` gives them, and the UTF-8 of the decoded ids."""
        return map(self.joined, self.parts(texts))


def decode_ids(ids: np.ndarray, path: str) -> str:
    """The text of ids, special tokens kept, as a tokenizer without a decoder gives it."""
    token = Encoder.of(path).token
    return " ".join([token[i] for i in ids.tolist()])


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids (array<int>), decoded (the text of the ids)."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Encoder.for_task(path) as own:
            for b in batches:
                rows = [*own.both(b["text"].to_pylist())]
                ids = [np.frombuffer(x, "<i4") for x, _ in rows]
                cols = [pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([y.decode() for _, y in rows], pa.string())]
                yield pa.RecordBatch.from_arrays([b["id"], *cols], ["id", "n", "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    thin = df.selectExpr(f"`{id_col}` AS id", f"coalesce(`{text_col}`, '') AS text")
    return thin.mapInArrow(run, f"id {kind}, n long, ids array<int>, decoded string").toDF(id_col, "n_tokens", "ids", "decoded")


def digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `encode`, with SHA-256 digests in place of ids and text, made where the ids are."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        with Encoder.for_task(path) as own:
            for b in batches:
                rows = [(len(x) // 4, sha(x).hexdigest(), sha(y).hexdigest()) for x, y in own.both(b["text"].to_pylist())]
                cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([b["id"], *cols], ["id", "n", "a", "b"])

    kind = df.schema[id_col].dataType.simpleString()
    thin = df.selectExpr(f"`{id_col}` AS id", f"coalesce(`{text_col}`, '') AS text")
    return thin.mapInArrow(run, f"id {kind}, n long, a string, b string").toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids of every text of `documents` and their decoded text, as digests."""
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
