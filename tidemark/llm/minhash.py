"""Near-duplicate detection by b-bit MinHash.

1. Sketch: 128 minima of each document's shingle set. Bands of four minima give candidates; of every
   minimum only the low four bits are kept, packed as four bit planes of 128 bits. Two sets with
   equal digests are one class from here on (its documents are copies), with the smallest id.
2. Candidates: every class that shares a band with others is paired with the smallest of them, the
   hub. This is linear in the rows, however large a bucket is.
3. Estimate: the planes of member and hub give their similarity by bit counts, corrected for chance
   agreement. Pairs that the estimate rejects are not looked at again as pairs.
4. Check: of the others the intersection is counted on the full sets.
5. The rest of a bucket: where members did not join their hub's component and the hub has others, they
   may be linked with each other or with members that did. For these hubs every member's difference
   from the hub is made: which of the hub's shingles it lacks, and which it adds. Members are
   compared in blocks of bounded size, first by the estimate, then exactly: with h the hub,
   x = h - r + a, the intersection of two members is |h| - |r1 or r2| + |a1 and a2|. Only links that
   join two components of the block are put out, so the output stays linear.
6. Components: smallest id by alternating large-star and small-star rounds over the links.

A pair at similarity 0.8 shares a band with probability 1 - (1 - 0.8^4)^32 > 1 - 5e-8. The estimate
rejects at six standard errors below the threshold. No bucket, hub or component is cut short.

Null and empty texts, and texts without words, have an empty set and are linked with nothing. An empty
table gives an empty result. Ids are integers and should be unique; of rows with one id and several
texts, one text stands for the id in links. Every row is listed, repeated ones too; those with a null
id are their own component (null) and kept, and dropping near duplicates keeps them. Other columns
aren't read; they can have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, packed, small_batches
from .components import smallest_reachable
from .shingles import mixed, shingles

HASHES, ROWS, BITS = 128, 4, 4
BANDS = HASHES // ROWS
#: Members of one hub that a block holds on either side.
BLOCK = 1024
#: Pairs of one hub that one task checks.
SALTED = 2048

_A = np.random.default_rng(20240503).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(20240504).integers(0, 1 << 63, HASHES, dtype=np.uint64)


def sketch(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of non-empty sets: band keys (n, BANDS) int64 and bit planes (n, BITS, HASHES / 64) int64."""
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
    flat = np.concatenate(sets)
    low = np.empty((HASHES, len(sets)), np.uint64)
    for k in range(HASHES):
        low[k] = np.minimum.reduceat((flat * _A[k] + _B[k]) >> np.uint64(32), at)
    band = np.zeros((BANDS, len(sets)), np.uint64)
    for r in range(ROWS):
        band = mixed(band * np.uint64(31) + low[r::ROWS] + np.uint64(1))
    band = mixed(band + np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15))
    bits = ((low[:, None, :] >> np.arange(BITS, dtype=np.uint64)[None, :, None]) & np.uint64(1)).astype(np.uint8)
    planes = np.packbits(bits.transpose(2, 1, 0), axis=2, bitorder="little")  # (n, BITS, HASHES / 8)
    return band.T.copy().view(np.int64), np.ascontiguousarray(planes).view("<i8")


def likeness(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated similarity of planes (BITS, w) to planes (n, BITS, w), corrected for chance agreement."""
    differs = np.bitwise_or.reduce(one[None] ^ many, axis=1)
    equal = 1 - np.bitwise_count(differs.view(np.uint64)).sum(axis=1) / HASHES
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    """The estimate below which a pair is rejected: six standard errors under the threshold."""
    j = percent / 100
    p = j + (1 - j) * 2.0**-BITS
    return j - 6 * (p * (1 - p) / HASHES) ** 0.5 / (1 - 2.0**-BITS)


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """id, n (set size), digest (binary, null for empty sets), bands and planes (array<long>)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t.encode(), words) for t in b["text"].tolist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            digest, bands, planes = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if full:
                keys, bits = sketch([sets[i] for i in full])
                for k, i in enumerate(full):
                    digest[i], bands[i], planes[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), keys[k], bits[k].ravel()
            yield pd.DataFrame({"id": b["id"].astype("Int64"), "n": [len(s) for s in sets], "digest": digest, "bands": bands, "planes": planes})

    return docs.mapInPandas(run, "id long, n long, digest binary, bands array<long>, planes array<long>")


def candidate_pairs(classes: DataFrame) -> DataFrame:
    """Distinct (x, hub): each class with the smallest class of every bucket it is in."""
    placed = classes.select(F.col("id").alias("x"), F.explode("bands").alias("band"))
    hubs = placed.groupBy("band").agg(F.min("x").alias("hub"), F.count("*").alias("size")).filter("size > 1").drop("size")
    return placed.join(hubs, "band").filter("x <> hub").select("x", "hub").distinct()


def estimated(pairs: DataFrame, planes: DataFrame) -> DataFrame:
    """x, hub, estimate: of each pair the similarity that the bit planes give. planes: id, planes."""
    both = pairs.join(planes.select(F.col("id").alias("x"), F.col("planes").alias("p")), "x").join(planes.select(F.col("id").alias("hub"), F.col("planes").alias("q")), "hub")
    words = HASHES // 64
    differ = [[F.col("p")[i * words + w].bitwiseXOR(F.col("q")[i * words + w]) for i in range(BITS)] for w in range(words)]
    unequal = sum(F.bit_count(reduce(lambda a, b: a.bitwiseOR(b), bits)) for bits in differ)
    chance = 2.0**-BITS
    return both.select("x", "hub", (((1 - unequal / HASHES) - chance) / (1 - chance)).alias("estimate"))


def _checked(pairs: DataFrame, texts: DataFrame, planes: DataFrame, words: int) -> DataFrame:
    """For each (x, hub): n_hub, both (size of the intersection), planes of x, lacks (bits), adds (hashes), n_x."""
    per_hub = pairs.groupBy("hub").agg((F.ceil(F.count("*") / SALTED)).cast("int").alias("salts"))
    salted = pairs.join(per_hub, "hub").withColumn("salt", F.pmod(F.xxhash64("x"), F.col("salts")).cast("int"))
    hubs = per_hub.join(texts.withColumnRenamed("id", "hub"), "hub").select("hub", F.col("text").alias("hub_text"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    mine = salted.join(texts.withColumnRenamed("id", "x"), "x").join(planes.withColumnRenamed("id", "x"), "x")
    both = mine.join(hubs, ["hub", "salt"]).select("x", "hub", "text", "hub_text", "planes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, hub_set, unpack = None, None, zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows = []
            for x, hub, text, hub_text, bits in b[["x", "hub", "text", "hub_text", "planes"]].itertuples(index=False, name=None):
                if hub != last:
                    last, hub_set = hub, shingles(unpack(hub_text), words)
                s = shingles(unpack(text), words)
                at = np.minimum(np.searchsorted(hub_set, s), len(hub_set) - 1)
                inside = hub_set[at] == s
                held = np.zeros(len(hub_set), bool)
                held[at[inside]] = True
                rows.append((x, hub, len(hub_set), len(s), int(inside.sum()), bits, np.packbits(~held).tobytes(), s[~inside].tobytes()))
            yield pd.DataFrame(rows, columns=["x", "hub", "n_hub", "n_x", "both", "planes", "lacks", "adds"])

    return both.mapInPandas(run, "x long, hub long, n_hub long, n_x long, both long, planes array<long>, lacks binary, adds binary")


def _linked(both, n_a, n_b, percent: int):
    return 100 * both >= percent * (n_a + n_b - both)


def unsettled(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """x, hub, c (component of x so far), out (it isn't the hub's) of the hubs with members outside their
    component and others besides; mb and lb, blocks of all members and of those outside."""
    of_x = component.select(F.col("id").alias("x"), F.col("component").alias("c"))
    of_hub = component.select(F.col("id").alias("hub"), F.col("component").alias("c_hub"))
    known = pairs.select("x", "hub").join(of_x, "x", "left").join(of_hub, "hub", "left")
    members = known.withColumn("c", F.coalesce("c", "x")).withColumn("out", F.col("c") != F.coalesce("c_hub", "hub")).drop("c_hub")
    sizes = members.groupBy("hub").agg(F.count("*").alias("m"), F.count_if("out").alias("l")).filter("l > 0 AND m > 1")
    blocks = sizes.select("hub", F.ceil(F.col("m") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("l") / BLOCK).cast("int").alias("lb"))
    return members.join(blocks, "hub")


def _leftover_links(open_pairs: DataFrame, checked: DataFrame, percent: int) -> DataFrame:
    """Links between members of one hub that lie in different components so far. open_pairs: see
    `unsettled`; checked: the members' differences from their hub."""
    members = checked.join(open_pairs, ["x", "hub"])
    m_block = F.pmod(F.xxhash64("x"), F.col("mb")).cast("int")
    l_block = F.pmod(F.xxhash64("x", F.lit(1)), F.col("lb")).cast("int")
    cols = ["hub", "x", "n_hub", "n_x", "planes", "lacks", "adds", "c", "out"]
    all_sides = members.select(*cols, F.lit(False).alias("left"), m_block.alias("j"), F.explode(F.sequence(F.lit(0), F.col("lb") - 1)).alias("i"))
    out_side = members.filter("out").select(*cols, F.lit(True).alias("left"), l_block.alias("i"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("j"))
    least = least_estimate(percent)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["left", "x"], ignore_index=True)
        left = p["left"].to_numpy()
        many, some = p[~left], p[left]
        if not len(many) or not len(some):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        planes = np.stack(many["planes"].to_list()).astype(np.int64).reshape(len(many), BITS, -1)
        lacks = np.stack([np.frombuffer(x, np.uint8) for x in many["lacks"]])
        n_hub, n_x, xs, cs = int(p["n_hub"].iloc[0]), many["n_x"].to_numpy(), many["x"].to_numpy(), many["c"].to_numpy()
        holders: dict[int, list[int]] = {}
        for k, x in enumerate(many["adds"]):
            for h in np.frombuffer(x, np.uint64).tolist():
                holders.setdefault(h, []).append(k)
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while c in root:
                c = root[c]
            return c

        links = []
        for row in some.itertuples(index=False):
            near = likeness(np.asarray(row.planes, np.int64).reshape(BITS, -1), planes) >= least
            near &= (cs != row.c) & (xs != row.x)
            k = np.flatnonzero(near)
            if not len(k):
                continue
            gone = np.bitwise_count(np.frombuffer(row.lacks, np.uint8)[None] | lacks[k]).sum(axis=1, dtype=np.int64)
            shared = np.zeros(len(xs), np.int64)
            for h in np.frombuffer(row.adds, np.uint64).tolist():
                shared[holders.get(h, [])] += 1
            both = n_hub - gone + shared[k]
            for i in k[_linked(both, row.n_x, n_x[k], percent)].tolist():
                a, b = top(int(row.c)), top(int(cs[i]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    links.append((int(row.x), int(xs[i])))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return out_side.unionByName(all_sides).groupBy("hub", "i", "j").applyInPandas(run, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row: id, n_shingles, component_id (smallest id reachable), kept."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = materialize(sketched(docs, words))
    full = rows.filter("digest IS NOT NULL AND id IS NOT NULL")
    rep = full.groupBy("digest").agg(F.min("id").alias("rep"))
    first = F.min_by(F.struct("bands", "planes"), "id")
    classes = full.groupBy("digest").agg(F.min("id").alias("id"), first.alias("s")).select("id", "s.bands", "s.planes").dropDuplicates(["id"])
    classes = materialize(classes)
    planes = classes.select("id", "planes")
    pairs = materialize(estimated(candidate_pairs(classes), planes))
    wanted = pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("hub").alias("id"))).distinct()
    # the wanted ids grow with the documents: the same join at every size, never a broadcast
    texts = materialize(docs.select("id", packed(F.col("text")).alias("text")).join(wanted.hint("shuffle_hash"), "id").dropDuplicates(["id"]))
    likely = _checked(pairs.filter(F.col("estimate") >= least_estimate(percent)).select("x", "hub"), texts, planes, words)
    links = materialize(likely.filter(_linked(F.col("both"), F.col("n_x"), F.col("n_hub"), percent)).select(F.col("x").alias("a"), F.col("hub").alias("b")))
    open_pairs = materialize(unsettled(pairs, smallest_reachable(links)))
    rest = materialize(_leftover_links(open_pairs, _checked(open_pairs.select("x", "hub"), texts, planes, words), percent))
    component = smallest_reachable(links.unionByName(rest))
    # equal sets are one class; a class takes the component of its smallest id
    of_class = rep.join(component.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = rows.select("id", "n", "digest").join(of_class, "digest", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """df without the documents whose component holds a smaller id; rows without an id stay."""
    gone = near_duplicates(df, id_col, text_col, words, percent).filter("NOT kept").select(F.col(id_col).alias("__tm_id")).distinct()
    return df.join(gone, df[id_col] == gone["__tm_id"], "left_anti")


def op6_minhash(spark, sf_dir: str) -> DataFrame:
    """Near duplicates of `documents`: shingles of four words, similarity of 0.8."""
    return near_duplicates(documents(spark, sf_dir), words=4, percent=80)
