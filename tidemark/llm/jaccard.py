"""Similarity join on sets of word shingles: rare-first prefixes, length, positional and suffix filters.

1. Sets: every document's distinct shingles as 64-bit hashes. Equal sets are one class. Shingles are counted by
   hash in a fixed number of counters (see `counters`), which give the order "rare first"; ties go by
   hash. Any order gives right results; the counts only decide how few candidates there are.
2. Prefixes: with a set of n and the threshold t, only its first n - ceil(t * n) + 1 shingles are
   joined: two linked sets share one of these. Tasks leave out copies they have met.
3. Candidates: of the classes that share a prefix shingle, each is paired with one, the hub, which is linear
   in the rows however many share it. The hub is the class whose prefix is shared most: of edited copies
   it is the original, whose edits are nobody's. A pair must pass the length filter and, by its places in
   both orders, the positional filter: what can still follow must suffice.
4. Suffix filter: every set is counted in ranges of hashes; the sum of the smaller counts bounds what
   two sets can share. What remains is verified on the full sets, once per pair.
5. Where sharers of a shingle still lie in several components, those outside the most common one meet
   all others across components, in blocks, under the same filters; new pairs are verified. Pairs within
   a component need no check, as they change nothing.
6. Components: smallest id by alternating rounds over the links.

Links between different sets are never lost: a pair that is neither verified nor ruled out by a bound lies in
one component. Work in step 5 can grow with the square of the unlinked sharers of one rare shingle that
no filter tells apart; what is put out stays under the filters. Sets are told apart by 128 bits; in joins they
go by the first 64 as a short name, and two sets of one name (about one pair in 2^64) both take part.

Null and empty texts, and texts without words, have an empty set and are linked with nothing. An empty
table gives an empty result. Ids are integers and should be unique; of rows with one id and several
texts, one text stands for the id in links. Every row is listed, repeated ones too; those with a null
id are their own component (null). Other columns aren't read; they can have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, packed, small_batches
from .components import smallest_reachable
from .counters import PART, parts_of, summed
from .shingles import shingles

COUNTERS = 1 << 22
#: Ranges of hashes for the suffix filter (of the first eight bits), counted in 16 bits each.
RANGES = 256
#: Copies that a task remembers, to leave them out.
MET = 100_000
#: Sharers of one shingle in a block, and pairs of one document that a task verifies.
BLOCK, SALTED = 1024, 2048
#: Rows that meet in one call where sharers that lie apart are compared.
TOGETHER = 16_384

_SETS = "id long, n long, digest binary, x long, ranges binary, kind int, part int, counts binary"
_PREFIXES = "token long, x long, n int, at int"


def _place(hashes: np.ndarray, counters: int) -> np.ndarray:
    return (hashes % np.uint64(counters)).astype(np.int64)


def _digest(hashes: np.ndarray) -> tuple[bytes, int]:
    """Digest of a set, and its first 64 bits as the class's short name."""
    d = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    return d, int.from_bytes(d[:8], "little", signed=True)


def _ranges(hashes: np.ndarray) -> bytes | None:
    """Counts of a set in ranges of hashes; none where one doesn't fit (no bound is known then)."""
    n = np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=RANGES)
    return n.astype("<u2").tobytes() if n.max() < 1 << 16 else None


def overlaps(p: list, q: list, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Suffix filter: which pairs of sets can share enough by their counts in ranges of hashes."""
    known = np.array([x is not None and y is not None for x, y in zip(p, q, strict=True)], bool)
    most = np.minimum(n, m).astype(np.int64)
    for at in range(0, len(p), 4096):
        k = np.flatnonzero(known[at : at + 4096]) + at
        if len(k):
            both = [np.frombuffer(b"".join([side[i] for i in k]), "<u2").reshape(len(k), RANGES) for side in (p, q)]
            most[k] = np.minimum(*both).sum(axis=1, dtype=np.int64)
    return most * (100 + percent) >= (n.astype(np.int64) + m) * percent


def sets(docs: DataFrame, words: int, counters: int) -> DataFrame:
    """A row per document (id, n, digest, x, ranges; the last three null for empty sets) and the counters' parts."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(counters, np.uint32)
        for b in batches:
            all_sets = [shingles(t.encode(), words) for t in b["text"].tolist()]
            rows = []
            for s in all_sets:
                if len(s):
                    d, x = _digest(s)
                    rows.append((len(s), d, x, _ranges(s)))
                else:
                    rows.append((0, None, None, None))
            table += np.bincount(_place(np.concatenate(all_sets), counters), minlength=counters).astype(np.uint32)
            n, digest, x, ranges = zip(*rows, strict=True) if rows else ((),) * 4
            out = pd.DataFrame({"n": n, "digest": digest, "x": pd.array(x, "Int64"), "ranges": ranges})  # never as floats
            yield out.assign(id=b["id"].astype("Int64").to_numpy(), kind=None, part=None, counts=None)[_COLUMNS]
        yield parts_of({0: table}).assign(id=None, n=None, digest=None, x=None, ranges=None)[_COLUMNS]

    return docs.mapInPandas(run, _SETS)


_COLUMNS = [c.split()[0] for c in _SETS.split(", ")]


def prefixes(docs: DataFrame, words: int, percent: int, table: np.ndarray) -> DataFrame:
    """token, x, n (size of the set), at (place in the rare-first order): the prefix of every set."""
    counted = docs.sparkSession.sparkContext.broadcast(table)  # of a fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, met = counted.value, set()
        for b in batches:
            tokens, names, sizes = [], [], []
            for t in b["text"].tolist():
                s = shingles(t.encode(), words)
                if not len(s):
                    continue
                x = _digest(s)[1]
                if x in met:
                    continue
                if len(met) < MET:
                    met.add(x)
                many = len(s) - -(-percent * len(s) // 100) + 1
                tokens.append(s[np.argsort(counts[_place(s, len(counts))], kind="stable")[:many]])
                names.append(x)
                sizes.append(len(s))
            if tokens:
                many = [len(t) for t in tokens]
                at = np.concatenate([np.arange(m, dtype=np.int32) for m in many])
                yield pd.DataFrame({"token": np.concatenate(tokens).view(np.int64), "x": np.repeat(np.array(names, np.int64), many), "n": np.repeat(np.array(sizes, np.int32), many), "at": at})

    return docs.select("text").mapInPandas(run, _PREFIXES)


def fits(n: Column, m: Column, percent: int) -> Column:
    """Length filter."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def follows(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """Positional filter: shared so far at most, this one, and what can follow in both."""
    most = F.least(i, j) + 1 + F.least(n - i, m - j) - 1
    return most * (100 + percent) >= (n + m).cast("long") * percent


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. texts: id, text (packed)."""
    per_b = pairs.groupBy("b").agg(F.ceil(F.count("*") / SALTED).cast("int").alias("salts"))
    salted = pairs.join(per_b, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"))
    right = per_b.join(texts.toDF("b", "b_text"), "b").select("b", "b_text", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    both = salted.join(texts.toDF("a", "a_text"), "a").join(right, ["b", "salt"]).select("a", "b", "a_text", "b_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held, unpack = None, None, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for a, b, a_text, b_text in batch[["a", "b", "a_text", "b_text"]].itertuples(index=False, name=None):
                if b != last:
                    last, held = b, shingles(unpack(b_text), words)
                s = shingles(unpack(a_text), words)
                shared = int((held[np.minimum(np.searchsorted(held, s), len(held) - 1)] == s).sum())
                if 100 * shared >= percent * (len(s) + len(held) - shared):
                    rows.append((a, b))
            yield pd.DataFrame(rows, columns=["a", "b"], dtype="int64")

    return both.mapInPandas(run, "a long, b long")


def _named(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of classes' ids for pairs (x, y) of short names, under the length and suffix filters."""
    side = lambda x, c: classes.select(F.col("x").alias(x), F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("ranges").alias(f"r_{c}"))
    both = pairs.join(side("x", "a"), "x").join(side("y", "b"), "y").filter((F.col("a") != F.col("b")) & fits(F.col("n_a"), F.col("n_b"), percent))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.loc[overlaps(p["r_a"].tolist(), p["r_b"].tolist(), p["n_a"].to_numpy(), p["n_b"].to_numpy(), percent), ["a", "b"]]

    passed = both.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInPandas(run, "a long, b long")
    return passed.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _filters(percent: int) -> Column:
    """Length and positional filter of a row of (n, at) beside (n_y, at_y)."""
    return fits(F.col("n"), F.col("n_y"), percent) & follows(F.col("n"), F.col("at"), F.col("n_y"), F.col("at_y"), percent)


def _hubs(sharers: DataFrame, weight: DataFrame) -> DataFrame:
    """token, hub, n_y, at_y: of each token's sharers the one whose prefix is shared most (ties: least name)."""
    place = F.shiftleft(F.col("n").cast("long"), 32) + F.col("at")
    best = F.max_by(F.struct("x", place.alias("p")), F.struct(F.col("weight"), -F.col("x"))).alias("h")
    n, at = F.shiftright("h.p", 32).cast("int").alias("n_y"), F.col("h.p").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("at_y")
    return sharers.join(weight, "x").groupBy("token").agg(best).select("token", F.col("h.x").alias("hub"), n, at)


def _placed(sharers: DataFrame, classes: DataFrame, component: DataFrame) -> DataFrame:
    """Sharers with their component so far (c), of the tokens whose sharers lie in several; out: it is not
    the component of most of the token's sharers."""
    of_class = classes.select("x", "id").join(component, "id", "left").select("x", F.coalesce("component", "id").alias("c")).groupBy("x").agg(F.min("c").alias("c"))
    members = sharers.join(of_class, "x")
    most = members.groupBy("token", "c").agg(F.count("*").alias("n_c")).groupBy("token").agg(F.count("*").alias("several"), F.max_by("c", F.struct("n_c", "c")).alias("usual"))
    return members.join(most.filter("several > 1").drop("several"), "token").withColumn("out", F.col("c") != F.col("usual")).drop("usual")


def _to_hub(sharers: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (x, y) of sharers with their token's hub that pass length and positional filter."""
    met = sharers.join(hubs, "token").filter((F.col("x") != F.col("hub")) & _filters(percent))
    return met.select("x", F.col("hub").alias("y")).distinct()


def _apart(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of sharers in different components, under all filters. members: see `_placed`.

    Of two components one is not the token's most common one, so it is enough to lay the sharers outside that
    one beside all. Where a token has more than BLOCK sharers, both sides are cut into blocks. Blocks of
    many tokens meet in calls of about TOGETHER rows, so neither a token nor a call grows with the input.
    """
    sizes = members.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("mb"), F.ceil(F.count_if("out") / BLOCK).cast("int").alias("lb"))
    block = lambda many, salt: F.pmod(F.xxhash64("x", F.lit(salt)), F.col(many)).cast("int")
    each = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    told = members.join(sizes, "token")
    cols = ["token", "x", "n", "at", "c", "out"]
    one = told.filter("mb = 1").select(*cols, F.lit(True).alias("left"), F.lit(True).alias("right"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    left = told.filter("mb > 1 AND out").select(*cols, F.lit(True).alias("left"), F.lit(False).alias("right"), block("lb", 1).alias("i"), each("mb").alias("j"))
    right = told.filter("mb > 1").select(*cols, F.lit(False).alias("left"), F.lit(True).alias("right"), each("lb").alias("i"), block("mb", 0).alias("j"))
    ranges = classes.groupBy("x").agg(F.first("ranges").alias("ranges"))  # of two sets of one short name either: see the docstring
    laid = materialize(one.unionByName(left).unionByName(right.select(one.columns)).join(ranges, "x"))
    calls = laid.count() // TOGETHER + 1

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["token", "i", "j"], ignore_index=True)
        token, i, j = p["token"].to_numpy(), p["i"].to_numpy(), p["j"].to_numpy()
        x, n, at, c, out, ranges = p["x"].to_numpy(), p["n"].to_numpy().astype(np.int64), p["at"].to_numpy().astype(np.int64), p["c"].to_numpy(), p["out"].to_numpy(), p["ranges"].to_numpy()
        is_left, is_right = p["left"].to_numpy() & out, p["right"].to_numpy()
        cut = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
        found = [np.zeros((2, 0), np.int64)]
        for start, stop in zip(cut, [*cut[1:], len(p)], strict=True):
            a, b = start + np.flatnonzero(is_left[start:stop]), start + np.flatnonzero(is_right[start:stop])
            if not len(a) or len(b) < 2 and not len(a):
                continue
            u, v = a[:, None], b[None, :]
            near = (c[u] != c[v]) & (~out[v] | (x[u] < x[v])) & (np.minimum(n[u], n[v]) * 100 >= np.maximum(n[u], n[v]) * percent)
            most = np.minimum(at[u], at[v]) + np.minimum(n[u] - at[u], n[v] - at[v])
            near &= most * (100 + percent) >= (n[u] + n[v]) * percent
            k, m = np.nonzero(near)
            found.append(np.stack((a[k], b[m])))
        pairs = np.concatenate(found, axis=1)
        if pairs.shape[1]:
            _, first = np.unique(np.stack((x[pairs].max(axis=0), x[pairs].min(axis=0))), axis=1, return_index=True)
            pairs = pairs[:, first]
            a, b = pairs
            pairs = pairs[:, overlaps(ranges[a].tolist(), ranges[b].tolist(), n[a], n[b], percent)]
        return pd.DataFrame({"x": x[pairs].max(axis=0), "y": x[pairs].min(axis=0)})

    call = F.pmod(F.xxhash64("token", "i", "j"), F.lit(calls)).alias("call")
    return laid.withColumn("call", call).groupBy("call").applyInPandas(run, "x long, y long").distinct()


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, counters: int = COUNTERS) -> DataFrame:
    """One row per row: id, n_shingles, component_id (smallest id reachable)."""
    if counters % PART:
        raise ValueError(f"counters must be a multiple of {PART}")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = materialize(sets(docs, words, counters))
    table = summed(made.filter("kind IS NOT NULL").select("kind", "part", "counts"), range(1), counters, 2**32 - 1)[0]
    rows = made.filter("kind IS NULL").select("id", "n", "digest", "x", "ranges")
    known = rows.filter("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest", "x", "n", "ranges").agg(F.min("id").alias("id"))
    classes = materialize(known)
    places = materialize(prefixes(docs.filter("id IS NOT NULL"), words, percent, table))
    several = places.groupBy("token").agg(F.min("x").alias("low"), F.max("x").alias("top")).filter("low <> top").select("token")
    sharers = materialize(places.join(materialize(several, free_shuffles=True), "token").distinct())
    weight = materialize(sharers.groupBy("x").agg((F.count("*") * percent / F.first("n")).alias("weight")))
    texts = _texts(docs, sharers.select("x").distinct().join(classes.select("x", "id"), "x").select("id").distinct())
    pairs = materialize(_named(_to_hub(sharers, _hubs(sharers, weight), percent), classes, percent))
    first = materialize(verified(pairs, texts, words, percent))
    members = materialize(_placed(sharers, classes, smallest_reachable(first)))
    rest = materialize(_named(_apart(members, classes, percent), classes, percent).join(pairs, ["a", "b"], "left_anti"))
    links = first.unionByName(materialize(verified(rest, texts, words, percent)))
    component = smallest_reachable(links)
    of_class = classes.select("digest", "id").join(component, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    out = rows.select("id", "n", "digest").join(of_class, "digest", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text (packed) of the documents with these ids."""
    # the wanted ids grow with the documents: the same join at every size, never a broadcast
    return materialize(docs.select("id", packed(F.col("text")).alias("text")).join(ids.hint("shuffle_hash"), "id").dropDuplicates(["id"]))


def op13_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Documents linked by a similarity of 0.8 over shingles of five words."""
    return similar(documents(spark, sf_dir))


def oracle(words: int, more: str = "") -> str:
    """All pairs that share a shingle, counted, and what can be reached over links."""
    return rf"""
WITH RECURSIVE listed AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
made AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {words - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 1}, least(len(w), 1)) + 1)) AS i FROM listed)),
sizes AS (SELECT doc_id, count(*) AS n FROM made GROUP BY doc_id),
digests AS (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS d FROM made GROUP BY doc_id),
classes AS (SELECT d, min(doc_id) AS rep FROM digests GROUP BY d),
sets AS (SELECT m.* FROM made m JOIN classes c ON c.rep = m.doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 80 * (p.n + q.n - common)),
reach AS (SELECT rep AS id, rep AS other FROM classes UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a),
found AS (SELECT d, least(rep, (SELECT min(other) FROM reach WHERE reach.id = rep)) AS component FROM classes)
SELECT l.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(f.component, l.doc_id) AS component_id{more}
FROM listed l LEFT JOIN sizes s ON s.doc_id = l.doc_id LEFT JOIN digests g ON g.doc_id = l.doc_id LEFT JOIN found f ON f.d = g.d
"""


ORACLE_SQL = oracle(5)
