"""Counts by hash in tables of fixed size, summed over all tasks.

Each task adds what it sees to its own table and puts it out in parts when it ends; parts of one place
are added as they stream by, so neither tasks nor the driver hold more than a table, whatever the input.
A counter is the sum over all things that share it: never too small, exact where nothing else shares
it. Callers use counters only to leave work out or to put it in order, never as a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from .common import partitions

#: Counters that one row carries.
PART = 1 << 16
FORM = "kind int, part int, counts binary"


def parts_of(tables: dict[int, np.ndarray]) -> pd.DataFrame:
    """The parts of a task's tables (uint32, a multiple of PART long) that hold anything."""
    pack = zstandard.ZstdCompressor(level=1).compress
    rows = [(kind, at // PART, pack(t[at : at + PART].tobytes())) for kind, t in tables.items() for at in range(0, len(t), PART) if t[at : at + PART].any()]
    return pd.DataFrame(rows, columns=["kind", "part", "counts"])


def summed(parts: DataFrame, kinds: range, size: int, most: int) -> dict[int, np.ndarray]:
    """The tables (uint32, `size` long) of all tasks' parts; sums above `most` are shown as `most`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack, held = zstandard.ZstdDecompressor().decompress, {}
        for b in batches:
            for kind, part, counts in b[["kind", "part", "counts"]].itertuples(index=False, name=None):
                more = np.frombuffer(unpack(counts), np.uint32)
                have = held.setdefault((kind, part), np.zeros(PART, np.uint32))
                np.minimum(have.astype(np.uint64) + more, most, out=have, casting="unsafe")
        pack = zstandard.ZstdCompressor(level=1).compress
        yield pd.DataFrame([(k, p, pack(t.tobytes())) for (k, p), t in held.items()], columns=["kind", "part", "counts"])

    out = {k: np.zeros(size, np.uint32) for k in kinds}
    unpack = zstandard.ZstdDecompressor().decompress
    for r in parts.repartition(partitions(parts.sparkSession), "kind", "part").mapInPandas(run, FORM).collect():  # tables of fixed size
        out[r["kind"]][r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(unpack(r["counts"]), np.uint32)
    return out


def form(most: int) -> type:
    """The smallest kind of number that holds counts up to `most`."""
    return np.uint8 if most < 1 << 8 else np.uint32


def add(table: np.ndarray, at: np.ndarray, most: int) -> None:
    """Count the places of a table, up to `most`; no second table is made."""
    found, n = np.unique(at, return_counts=True)
    table[found] = np.minimum(table[found] + n, most)


def reaching(parts: DataFrame, kinds: range, size: int, most: int) -> dict[int, np.ndarray]:
    """Which counters of the sum of all tasks' parts (of `form(most)`) reach `most`, as packed bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack, held, kept = zstandard.ZstdDecompressor().decompress, {}, form(most)
        for b in batches:
            for kind, part, counts in b[["kind", "part", "counts"]].itertuples(index=False, name=None):
                have = held.setdefault((kind, part), np.zeros(PART, kept))
                np.minimum(have.astype(np.uint64) + np.frombuffer(unpack(counts), kept), most, out=have, casting="unsafe")
        yield pd.DataFrame([(k, p, np.packbits(t >= most).tobytes()) for (k, p), t in held.items()], columns=["kind", "part", "counts"])

    out = {k: np.zeros(size // 8, np.uint8) for k in kinds}
    for r in parts.repartition(partitions(parts.sparkSession), "kind", "part").mapInPandas(run, FORM).toLocalIterator():  # bits of fixed size
        out[r["kind"]][r["part"] * PART // 8 : (r["part"] + 1) * PART // 8] = np.frombuffer(r["counts"], np.uint8)
    return out
