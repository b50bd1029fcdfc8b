"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's ids (with an end id) are cut into pieces of at most `capacity`; only the last piece of
a document is shorter. The ids themselves are needed for the pieces' lengths and checksums alone, so
what is packed are thin rows of a few numbers. These are dealt by a hash into groups of about
`group_pieces` pieces, whose number grows with the input; no group depends on another.

In a group, windows are filled by multiway differencing: every piece starts as a partial partition
into k windows, one of them filled. The two partial partitions with the largest spread (fullest less
emptiest window) are merged, the fullest window of one with the emptiest of the other, until one is
left, whose windows are nearly equal. k starts at the fewest windows that could hold the group; when
the fullest window exceeds the capacity, k rises and the group is packed again.

Null texts count as empty: one piece that holds the end id. Repeated rows are packed each on their
own. Null ids are carried. An empty table gives no pieces. Only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import documents, materialize, small_batches

CAPACITY = 4096
END_ID = 2
GROUP_PIECES = 1024


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: id, start, length, ids_crc32, doc_tokens."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, crc = end_id.to_bytes(4, "little"), zlib.crc32
        with Encoder.for_task(path, texts=False) as own:
            for b in batches:
                row, rows = [], []
                for i, ids in enumerate(own.encode(b["text"].to_pylist())):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        row.append(i)
                        rows.append((start, min(capacity, n - start), crc(ids[4 * start : 4 * (start + capacity)]), n))
                cols = [b["id"].take(pa.array(row, pa.int32())), *[pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)]]
                yield pa.RecordBatch.from_arrays(cols, ["id", "start", "length", "crc", "n"])

    kind = df.schema[id_col].dataType.simpleString()
    thin = df.selectExpr(f"`{id_col}` AS id", f"coalesce(`{text_col}`, '') AS text")
    made = thin.mapInArrow(run, f"id {kind}, start long, length long, crc long, n long")
    return made.toDF(id_col, "start", "length", "ids_crc32", "doc_tokens")


def difference(lengths: list[int], k: int) -> tuple[list[int], int]:
    """The window of each length, 0 to k - 1, by multiway differencing; and the fullest window's load."""
    loads = [np.zeros(k, np.int64) for _ in lengths]
    base = [0] * len(lengths)  # what every window of a partial partition holds at least
    for i, n in enumerate(lengths):
        loads[i][0] = n  # loads are kept in falling order, less the base
    if k == 1:
        return [0] * len(lengths), sum(lengths)
    heap = [(-n, i) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = loads[a] + loads[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        low = both[-1]
        merges.append((a, b, order))
        loads.append(both - low)
        base.append(base[a] + base[b] + int(low))
        loads[a] = loads[b] = None
        heapq.heappush(heap, (-int(both[0] - low), len(loads) - 1))
    window: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)}
    for made in range(len(lengths) + len(merges) - 1, len(lengths) - 1, -1):
        a, b, order = merges[made - len(lengths)]
        place = np.empty(k, np.int64)
        place[order] = window.pop(made)
        window[a], window[b] = place, place[::-1]
    root = len(base) - 1
    return [int(window[i][0]) for i in range(len(lengths))], base[root] + int(loads[root][0])


def fill(lengths: list[int], capacity: int) -> list[int]:
    """The window of each length so that none exceeds the capacity; k rises until this holds."""
    total = sum(lengths)
    k = -(-total // capacity)
    while True:
        window, most = difference(lengths, k)
        if most <= capacity:
            return window
        room = max(1, capacity - (most - total // k))  # the mean load at which this spread would fit
        k = min(len(lengths), max(k + 1, -(-total // room) if total // room < 1.1 * k else k + 1))


def pack(parts: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, id_col: str = "doc_id") -> DataFrame:
    """The pieces with sequence_id and offset. `parts` is what `pieces` returns."""
    parts = materialize(parts)
    groups = max(1, -(-parts.count() // group_pieces))
    kind = parts.schema[id_col].dataType.simpleString()

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["length", id_col, "start"], ascending=[False, True, True], kind="stable")
        whole = p["length"].to_numpy() >= capacity
        window = np.empty(len(p), np.int64)
        rest = p["length"].to_numpy()[~whole].tolist()
        window[~whole] = fill(rest, capacity) if rest else []
        first = window[~whole].max() + 1 if rest else 0
        window[whole] = first + np.arange(whole.sum())
        p = p.assign(window=window)
        p["offset"] = p.groupby("window")["length"].cumsum() - p["length"]
        p["sequence_id"] = p["tm_group"] * (1 << 24) + p["window"]
        return p[[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    dealt = parts.withColumn("tm_group", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.lit(groups)))
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("tm_group").applyInPandas(run, schema)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """All `documents` packed into sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack(pieces(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))
