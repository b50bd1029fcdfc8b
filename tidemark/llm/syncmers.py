"""Document fingerprints from closed syncmers.

A k-mer of a text's bytes is a closed syncmer if the smallest hash among its s-mers lies at its first
or last place. This depends on the k-mer alone, so a change elsewhere in a text moves no anchor, and
equal passages have equal anchors at a constant distance. A fingerprint is the sketch of the `KEPT`
anchors with the smallest hashes, each with the first place where it stands. The likeness of two
fingerprints is the estimated share of common anchors, counting only those whose places agree with
the most frequent distance between the two (within `SLACK` bytes).

White space is made uniform before hashing: runs become one blank, and letters lower case. Every
fingerprint carries a sketch of short k-mers, and that of a text of SHORT bytes or more also one of
long k-mers. Two texts are compared by their long sketches where both have one, and by their short
ones otherwise. A text without a closed syncmer has one anchor, the whole text; null and empty texts
have the empty fingerprint, whose likeness to another empty one is 1 and to anything else 0. Equal
texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, partitions, small_batches
from .shingles import mixed

K, S = 24, 12
#: Texts of fewer bytes have too few long k-mers, and are compared by shorter ones.
SHORT, SHORT_K, SHORT_S = 128, 8, 4
KEPT = 64
SLACK = 16


class Sketch(NamedTuple):
    """Anchor hashes, ascending, and the first place of each."""

    hashes: np.ndarray
    places: np.ndarray


class Fingerprint(NamedTuple):
    """long: empty for texts of fewer than SHORT bytes."""

    long: Sketch
    short: Sketch


_NONE = Sketch(np.zeros(0, np.uint64), np.zeros(0, np.int64))
_TABLE = np.random.default_rng(20240510).integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _rolled(raw: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n bytes, joined from runs of powers of two."""
    count = len(raw) - n + 1
    have, size, out, done = _TABLE[raw], 1, np.zeros(count, np.uint64), 0
    while done < n:
        if n & size:
            out = mixed(out * _ODD + have[done : done + count])
            done += size
        if done < n:
            have = mixed(have[:-size] * _ODD + have[size:])
            size *= 2
    return out


def _bytes(text: str) -> np.ndarray:
    """The bytes of a text in lower case with uniform white space."""
    return np.frombuffer(" ".join(text.lower().split()).encode("utf-8", "surrogatepass"), np.uint8)


def _anchors(raw: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    if not len(raw):
        return _NONE
    at = np.zeros(0, np.int64)
    if len(raw) >= k:
        inner = _rolled(raw, s)
        n = len(raw) - k + 1
        width = k - s + 1  # s-mers of a k-mer; the smallest of them by doubling windows
        low, size = inner, 1
        while size * 2 <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[:n], low[width - size : width - size + n])
        at = np.flatnonzero((inner[:n] == low) | (inner[width - 1 : width - 1 + n] == low))
    if not len(at):
        digest = hashlib.blake2b(raw.tobytes(), digest_size=8).digest()
        return np.frombuffer(digest, "<u8").copy(), np.zeros(1, np.int64)
    # a k-mer is its two outer s-mers and the one in the middle
    return mixed((inner[at] * _ODD + inner[at + width - 1]) * _ODD + inner[at + width // 2]), at


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and byte places (in the text with uniform white space) of the closed syncmers."""
    return _anchors(_bytes(text), k, s)


def _sketch(raw: np.ndarray, k: int, s: int, kept: int) -> Sketch:
    """The smallest distinct anchor hashes, ascending, and the first place of each."""
    h, at = _anchors(raw, k, s)
    if len(h) > 4 * kept:  # enough to hold `kept` distinct ones? else sort all
        part = np.argpartition(h, 4 * kept)[: 4 * kept]
        part.sort()
        u, first = np.unique(h[part], return_index=True)
        if len(u) >= kept:
            return Sketch(u[:kept], at[part][first[:kept]])
    u, first = np.unique(h, return_index=True)
    return Sketch(u[:kept], at[first[:kept]])


def fingerprint(text: str, kept: int = KEPT) -> Fingerprint:
    """The sketches of a text by long and by short k-mers."""
    raw = _bytes(text)
    return Fingerprint(_sketch(raw, K, S, kept) if len(raw) >= SHORT else _NONE, _sketch(raw, SHORT_K, SHORT_S, kept))


def as_text(found: Fingerprint) -> str:
    """hash@place in hexadecimal, comma-joined; a long sketch stands before the short one and a semicolon."""
    one = lambda x: ",".join([f"{h:016x}@{p:x}" for h, p in zip(x.hashes.tolist(), x.places.tolist(), strict=True)])
    return f"{one(found.long)};{one(found.short)}" if len(found.long.hashes) else one(found.short)


def likeness(a: Fingerprint, b: Fingerprint, kept: int = KEPT) -> float:
    """Estimated share of common anchors at a consistent distance, 0 to 1."""
    both_long = len(a.long.hashes) and len(b.long.hashes)
    a, b = (a.long, b.long) if both_long else (a.short, b.short)
    if not len(a.hashes) or not len(b.hashes):
        return float(len(a.hashes) == len(b.hashes))
    union = np.union1d(a.hashes, b.hashes)[:kept]
    both, i, j = np.intersect1d(a.hashes, b.hashes, assume_unique=True, return_indices=True)
    fits = both <= union[-1]
    if not fits.any():
        return 0.0
    distance = np.sort(a.places[i[fits]] - b.places[j[fits]])
    agree = np.searchsorted(distance, distance + SLACK, "right") - np.arange(len(distance))
    return float(agree.max() / len(union))


def anchor_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """One row per anchor: id, place, hash: for matching passages by position with a join on hash."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [anchors(t, k, s) for t in b["text"].tolist()]
            n = [len(h) for h, _ in found]
            yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), n), "place": np.concatenate([p for _, p in found] or [[]]).astype("int64"), "hash": np.concatenate([h for h, _ in found] or [np.zeros(0, np.uint64)]).view(np.int64)})

    kind = df.schema[id_col].dataType.simpleString()
    thin = df.selectExpr(f"`{id_col}` AS id", f"coalesce(`{text_col}`, '') AS text")
    return thin.mapInPandas(run, f"id {kind}, place long, hash long").toDF(id_col, "place", "hash")


def _in_order(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, ghost, id, text): every bucket holds a run of ids, and as its ghost the document that
    follows its last one in falling order of ids.

    Bounds between buckets come from a percentile sketch of the ids, so a bucket holds about as many
    documents as any other. Only the largest id of each bucket is gathered (one row a bucket). Each
    text crosses the network once, and the ghosts (one a bucket) twice.
    """
    n = max(1, partitions(df.sparkSession) - 1)
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("id IS NOT NULL")
    cuts = docs.select(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 10000).alias("c")).first()["c"] or []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    bucket = F.size(F.filter(bounds, lambda c: c < F.col("id")))
    tops = {r["b"]: r["top"] for r in docs.groupBy(bucket.alias("b")).agg(F.max("id").alias("top")).collect()}  # a row a bucket
    order = sorted(tops, reverse=True)
    # the largest of a bucket follows the smallest of the bucket above it; after the last comes the first
    follows = [(int(tops[b]), int(order[i - 1])) for i, b in enumerate(order)]
    ghosts = F.filter(F.array(*[F.struct(F.lit(t).cast("bigint").alias("id"), F.lit(b).alias("b")) for t, b in follows]) if follows else F.array().cast("array<struct<id:bigint,b:int>>"), lambda g: g["id"] == F.col("id"))
    placed = F.concat(F.array(F.struct(bucket.alias("b"), F.lit(0).alias("g"))), F.transform(ghosts, lambda g: F.struct(g["b"].alias("b"), F.lit(1).alias("g"))))
    rows = docs.withColumn("p", F.explode(placed)).select(F.col("p.b").alias("bucket"), F.col("p.g").alias("ghost"), "id", "text")
    return rows.repartition(n, "bucket").sortWithinPartitions(F.col("bucket"), F.col("ghost"), F.col("id").desc())


def edited_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its fingerprint, that of its text with the last third replaced by the start of
    the next document (falling id, the first after the last), and both likenesses.

    Rows with a null id have no place in the order: nothing follows them (their edited text ends where the
    last third began, and their next document is the empty one). Of equal ids each row is one document, in
    any order. An empty table gives an empty result. Other columns aren't read; they can have any name.
    """
    small_batches(df.sparkSession)

    def done(doc: int | None, text: str, sketch, follower: str, next_sketch) -> tuple:
        n = len(text)
        edited = text[: n - n // 3] + follower[: n // 3]
        own = sketch if edited == text else fingerprint(edited)
        return doc, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(sketch), as_text(own), likeness(sketch, own), likeness(sketch, next_sketch)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            rows = []
            for bucket, ghost, doc, text in b.itertuples(index=False, name=None):
                sketch = fingerprint(text)
                if held is not None and held[0] == bucket:
                    rows.append(done(held[1], held[2], held[3], text, sketch))
                held = None if ghost else (bucket, doc, text, sketch)
            yield pd.DataFrame(rows, columns=["id", "n", "sha", "f", "e", "ne", "nn"])

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing = fingerprint("")
        for b in batches:
            rows = [done(None, t, fingerprint(t), "", nothing) for t in b["text"].tolist()]
            yield pd.DataFrame(rows, columns=["id", "n", "sha", "f", "e", "ne", "nn"]).astype({"id": "Int64"})

    form = "id long, n long, sha string, f string, e string, ne double, nn double"
    rest = df.filter(F.col(id_col).isNull()).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = _in_order(df, id_col, text_col).mapInPandas(run, form).unionByName(rest.mapInPandas(alone, form))
    return found.toDF(id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op3_syncmers(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of `documents` and of their edited texts."""
    return edited_likeness(documents(spark, sf_dir))
