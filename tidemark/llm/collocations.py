"""Collocations: phrases that occur more often than their parts let expect, by FM-indexes of shards.

1. Shards: each task gathers the words of its documents by language, pieces cut by a separator, as
   numbers of the shard's own vocabulary. A shard ends with the document that makes it SHARD words long.
2. Counters (see `counters`): all phrases of one to `longest` words are counted by hash. A counter
   under the threshold says that no phrase in it reaches the threshold; others may or may not.
3. Each shard's FM-index, over words in a pair that may reach the threshold, lists its phrases length by
   length. A phrase is only lengthened where its counter and those of its parts allow it. For each
   phrase, the two transforms say whether a single word precedes or follows it everywhere in the shard.
4. Sums across shards give exact counts; words and phrases under the threshold go. A phrase that one
   and the same word precedes (or follows) at every place in every shard has the count of that longer
   phrase and is part of it: it is no collocation of its own. Looking one word further is enough, as
   counts can't grow with length: if a longer phrase around it is as frequent, so is every one between.
5. Every candidate is scored at each of its cuts by the counts of both parts, in exact decimals.

Memory in a task is that of one shard plus its last document, of the counters (a byte each) and of the
phrases it gathers, a fixed number. What is shuffled is what may reach the threshold, added up within each
task, as arrays by bucket of phrases. Counters grow with the words, up to a fixed number: where a corpus is so
large that all counters pass the threshold, phrases are still counted exactly, by more rows and more buckets.

Null text is empty, a null language is `und`; empty and white texts have no words. Repeated rows and
ids all count (ids aren't read). Ties end in phrase order. An empty table gives an empty result. Other
columns aren't read; they can have any name.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialize, partitions, small_batches
from .counters import FORM, PART, add, form, parts_of, reaching
from .fm_index import Index
from .shingles import mixed

#: Words after which a shard ends; counters for each length of phrase: at least, and at most.
SHARD = 1_000_000
COUNTERS, MOST_COUNTERS = 1 << 22, 1 << 25
#: A-Z in lower case; all that cuts pieces becomes a line feed. Fixed values.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Numbers(dict):
    """Number of a word, from 1 on, in order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


class _Shard:
    def __init__(self):
        self.numbers, self.seq = _Numbers(), []

    def add(self, text: str) -> None:
        number, seq = self.numbers.__getitem__, self.seq
        for piece in text.encode().translate(_TABLE).split(b"\n"):
            if words := piece.split():
                seq.extend(map(number, words))
                seq.append(0)


def shards(df: DataFrame, text_col: str, lang_col: str, size: int = SHARD) -> DataFrame:
    """lang, n (words), words (the vocabulary, packed) and seq (numbers of words, packed)."""
    small_batches(df.sparkSession)
    texts = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_shards: dict[str, _Shard] = {}
        pack = zstandard.ZstdCompressor(level=1).compress

        def closed(lang: str) -> pd.DataFrame:
            s = open_shards.pop(lang)
            seq = np.array(s.seq, np.int32)
            return pd.DataFrame([(lang, int((seq > 0).sum()), pack(b"\n".join(s.numbers)), pack(seq.tobytes()))], columns=["lang", "n", "words", "seq"])

        for b in batches:
            for text, lang in zip(b["text"].tolist(), b["lang"].tolist(), strict=True):
                s = open_shards.setdefault(lang, _Shard())
                s.add(text)
                if len(s.seq) >= size:
                    yield closed(lang)
        for lang in [x for x, s in open_shards.items() if s.seq]:
            yield closed(lang)

    return texts.mapInPandas(run, "lang string, n long, words binary, seq binary")


def _opened(lang: str, words: bytes, seq: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Vocabulary (from 1 on), hashes of its words in this language, and the sequence."""
    unpack = zstandard.ZstdDecompressor().decompress
    listed = [b"", *unpack(words).split(b"\n")]
    tail = b"\n" + lang.encode()
    raw = b"".join(hashlib.blake2b(w + tail, digest_size=8).digest() for w in listed)
    return listed, np.frombuffer(raw, np.uint64) | np.uint64(1), np.frombuffer(unpack(seq), np.int32)


def _hashes(seq: np.ndarray, of_word: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the phrases of k words at the given places."""
    h = of_word[seq[places]]
    for i in range(1, k):
        h = mixed(h * _STEP + of_word[seq[places + i]])
    return mixed(h)


def _whole(seq: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each length the places where a phrase of it stands within its piece."""
    ends = np.flatnonzero(seq == 0)
    left = ends[np.searchsorted(ends, np.arange(len(seq)))] - np.arange(len(seq))  # words up to the piece's end
    return [np.flatnonzero(left >= k) for k in range(1, longest + 1)]


def _counted(table: DataFrame, longest: int, least: int, counters: int) -> dict[int, np.ndarray]:
    """For each length, which counters reach the threshold, as packed bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = {k: np.zeros(counters, form(least)) for k in range(1, longest + 1)}
        for b in batches:
            for lang, words, seq in b[["lang", "words", "seq"]].itertuples(index=False, name=None):
                _, of_word, s = _opened(lang, words, seq)
                for k, places in enumerate(_whole(s, longest), 1):
                    add(tables[k], (_hashes(s, of_word, places, k) % np.uint64(counters)).astype(np.int64), least)
        yield parts_of(tables)

    return reaching(table.select("lang", "words", "seq").mapInPandas(run, FORM), range(1, longest + 1), counters, least)


def _kept(seq: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The sequence of the words in the given pairs (places of their first words); what lies between is one separator."""
    stays = np.zeros(len(seq) + 1, bool)
    stays[pairs] = stays[pairs + 1] = True
    joined = np.zeros(len(seq), bool)  # the word goes on with the next one
    joined[pairs] = True
    out = np.zeros(2 * len(seq), np.int32)  # a place for each word and one behind it
    out[::2] = np.where(stays[:-1], seq, 0)
    keep = np.zeros(2 * len(seq), bool)
    keep[::2] = stays[:-1]
    keep[1::2] = stays[:-1] & ~joined
    return out[keep]


#: Phrases on their way: by bucket, as arrays. key: language and phrase; b0 to a1: least and greatest of
#: the hashes of the only word before and after (0: several, or none).
_BLOCK = "bucket int, key array<string>, f array<long>, b0 array<long>, b1 array<long>, a0 array<long>, a1 array<long>"
_SUMS = [("f", "sum"), ("b0", "min"), ("b1", "max"), ("a0", "min"), ("a1", "max")]
#: Phrases that a task gathers before it adds them up, and those that a bucket is meant to hold at most.
GATHERED, BUCKET = 500_000, 1_000_000
#: Phrases that are written out as text at once.
PIECE = 100_000


def _added(tables: list[pa.Table]) -> pa.Table:
    """One row per key."""
    t = pa.concat_tables(tables).group_by("key", use_threads=False).aggregate(_SUMS)  # a table for each thread would be held
    return t.select(["key", *[f"{c}_{how}" for c, how in _SUMS]]).rename_columns(["key", *[c for c, _ in _SUMS]])


def _in_blocks(tables: list[pa.Table], buckets: int) -> pa.RecordBatch:
    """Phrases added up, a row per bucket."""
    t = _added(tables)
    at = np.fromiter((zlib.crc32(k.as_py().encode()) % buckets for k in t["key"]), np.int64, len(t))
    order = np.argsort(at, kind="stable")
    full, first = np.unique(at[order], return_index=True)
    t = t.take(pa.array(order)).combine_chunks()
    ends = pa.array(np.append(first, len(at)).astype(np.int32))
    one = lambda c: t[c].chunk(0) if t[c].num_chunks else pa.array([], t[c].type)
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *[pa.ListArray.from_arrays(ends, one(c)) for c in t.column_names]], names=["bucket", *t.column_names])


def _phrases(index: Index, lang: str, words: list[bytes], of_word: np.ndarray, longest: int, may) -> Iterator[pa.Table]:
    """The phrases of two words and more of an index, by length. may: which phrases (sequence, places, length) can matter."""
    signed = of_word.view(np.int64).copy()
    signed[0] = 0
    head = lang.encode() + b"\n"
    p = index.words()
    for k in range(2, longest + 1):
        p = index.longer(p)
        places = index.places(p)
        stays = may(index.seq, places, k)
        p, places = p.take(stays), places[stays]
        if not len(places):
            return
        zero = np.zeros(len(places), np.int64)
        before, after = (signed[index.only_before(p)], signed[index.only_after(p)]) if k < longest else (zero, zero)
        f = p.hi - p.lo
        for at in range(0, len(places), PIECE):
            some = slice(at, at + PIECE)
            keys = [head + b" ".join([words[i] for i in x]) for x in index.seq[places[some, None] + np.arange(k)].tolist()]
            yield _table(keys, f[some], before[some], after[some])


def _table(keys: list[bytes], f: np.ndarray, before: np.ndarray, after: np.ndarray) -> pa.Table:
    return pa.table({"key": pa.array(keys, pa.binary()).cast(pa.string()), "f": f.astype(np.int64), "b0": before, "b1": before, "a0": after, "a1": after})


def _enough(words: int, least: int) -> int:
    """Counters for so many words: few enough words share one that by chance it stays under the threshold, as far as MOST_COUNTERS go."""
    counters = COUNTERS
    while counters < MOST_COUNTERS and 3 * words > least * counters:
        counters *= 2
    return counters


def _buckets(words: int, passing: dict[int, np.ndarray], least: int) -> int:
    """So many that a bucket holds BUCKET different phrases by expectation: phrases of a length pass by chance as often as
    counters do, and those that reach the threshold are one in `least` words at most."""
    return math.ceil(words * sum(float(np.unpackbits(b).mean()) + 1 / least for b in passing.values()) / BUCKET)


def _listed(table: DataFrame, longest: int, passing: dict[int, np.ndarray], counters: int, buckets: int) -> DataFrame:
    """Per task the phrases of its shards, added up, in blocks by bucket."""
    bits = table.sparkSession.sparkContext.broadcast(passing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        count = 0
        for b in batches:
            for lang, packed, seq in zip(*(b[c].to_pylist() for c in ("lang", "words", "seq")), strict=True):
                words, of_word, s = _opened(lang, packed, seq)

                def may(s: np.ndarray, places: np.ndarray, k: int, of_word: np.ndarray = of_word) -> np.ndarray:
                    at = (_hashes(s, of_word, places, k) % np.uint64(counters)).astype(np.int64)
                    return (bits.value[k][at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)

                often = np.bincount(s, minlength=len(words))
                first = np.full(len(words), -1)
                first[s[::-1]] = np.arange(len(s))[::-1]
                used = np.flatnonzero(often[1:]) + 1
                used = used[may(s, first[used], 1)]
                zero = np.zeros(len(used), np.int64)
                found = [_table([lang.encode() + b"\n" + words[i] for i in used.tolist()], often[used], zero, zero)]
                pairs = _whole(s, 2)[1]
                s = _kept(s, pairs[may(s, pairs, 2)])
                if len(s):
                    found = chain(found, _phrases(Index(s, longest), lang, words, of_word, longest, may))
                for t in found:
                    held.append(t)
                    count += len(t)
                    if count >= GATHERED:
                        yield _in_blocks(held, buckets)
                        held, count = [], 0
        if held:
            yield _in_blocks(held, buckets)

    return table.select("lang", "words", "seq").mapInArrow(run, _BLOCK)


def counts(table: DataFrame, longest: int, least: int, counters: int | None = None) -> DataFrame:
    """lang, phrase, k, f, part: every phrase of `least` or more places; part: a longer one is as frequent.

    Blocks of a bucket meet in one task and are added up as they come; it holds the bucket's phrases."""
    words = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counters = counters or _enough(words, least)
    passing = _counted(table, longest, least, counters)
    buckets = max(partitions(table.sparkSession), _buckets(words, passing, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        count, limit = 0, GATHERED
        for b in batches:
            held.append(pa.table({c: b[c].flatten() for c in b.schema.names if c != "bucket"}))
            count += len(held[-1])
            if count >= limit:
                held = [_added(held)]
                count = len(held[0])
                limit = count + GATHERED
        if held:
            t = _added(held)
            yield from t.filter(pc.greater_equal(t["f"], least)).combine_chunks().to_batches()

    blocks = _listed(table, longest, passing, counters, buckets)
    rows = blocks.repartition(buckets, "bucket").mapInArrow(run, "key string, f long, b0 long, b1 long, a0 long, a1 long")
    phrase = F.substring_index("key", "\n", -1)
    lang = F.expr("substring(key, 1, length(key) - length(substring_index(key, '\n', -1)) - 1)")
    same = lambda low, top: (F.col(low) == F.col(top)) & (F.col(low) != 0)
    return rows.select(lang.alias("lang"), phrase.alias("phrase"), F.size(F.split(phrase, " ")).alias("k"), "f", (same("b0", "b1") | same("a0", "a1")).alias("part"))


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, least: int = 100, top: int = 2000, shard: int = SHARD, counters: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the `top` phrases by their lowest-scoring cut."""
    if counters and counters % PART:
        raise ValueError(f"counters must be a multiple of {PART}")
    table = materialize(shards(df, text_col, lang_col, shard))
    found = materialize(counts(table, longest, least, counters))
    whole = table.groupBy("lang").agg(F.sum("n").alias("n"))
    words = F.split("phrase", " ")
    cuts = found.filter("k > 1 AND NOT part").select("lang", "phrase", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    joined = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = cuts.select("lang", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("head"), joined(F.col("cut") + 1, F.size("w")).alias("tail"))
    part = found.select("lang", "phrase", "f")
    both = cuts.join(part.toDF("lang", "head", "l"), ["lang", "head"]).join(part.toDF("lang", "tail", "r"), ["lang", "tail"]).join(whole, "lang")
    big = lambda c: F.col(c).cast("decimal(18,0)")
    scored = both.withColumn("above", (big("a") * big("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")).withColumn("below", big("l") * big("r"))
    scored = scored.withColumn("score", F.expr("above div below"))
    lowest = F.min(F.struct("score", "cut", "l", "r")).alias("s")
    best = scored.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of `documents`."""
    return collocations(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
listed AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed),
grams AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM placed, range(1, 6) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
whole AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM grams WHERE k > 1 AND f >= 100),
inner_phrases AS (SELECT c.lang, array_to_string(c.w[s : s + m - 1], ' ') AS phrase, max(c.a) AS most
  FROM candidates c, range(2, 5) x(m), range(1, 5) y(s) WHERE m < c.k AND s + m - 1 <= c.k GROUP BY ALL),
stays AS (SELECT c.* FROM candidates c LEFT JOIN inner_phrases p ON p.lang = c.lang AND p.phrase = c.phrase WHERE p.most IS NULL OR 100 * p.most < 100 * c.a),
cuts AS (SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, n, (1000 * CAST(c.a AS HUGEINT) * n) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM stays c JOIN range(1, 5) t(cut) ON cut < c.k JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : cut], ' ')
  JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1 : c.k], ' ') JOIN whole ON whole.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM best QUALIFY rank <= 2000
"""
