"""Centroid clustering in whole numbers, with a LAESA table of distances to fixed pivots.

1. Vectors of the right length without null or non-finite components become integers, floor(scale * x).
   The first centroids are the vectors whose salted ids have the smallest SHA-256.
2. Pivots are picked among the first centroids, each as far as possible from those before. Every
   vector's distances to the pivots are computed once and stored beside it (the pivot table).
3. A round measures centroid to pivot only. By the triangle inequality |d(v, p) - d(c, p)| bounds
   d(v, c) from below, for each pivot p. The centroid with the smallest bound is measured first; only
   centroids whose bound does not pass the best distance so far get an exact distance in integers.
4. Each task sums its vectors per centroid; these sums (one row per task and centroid) are all that is
   shuffled, and a row per centroid is all that reaches the driver. So a centroid that holds most
   vectors is no hot key, and the rounds write nothing.

Results are exact: bounds are floating point and widened by more than their rounding error, distances,
ties (to the smaller number) and means (floor) are integers.

Null or wrong-length vectors and those with a null or non-finite component are left out. Vectors with
a null id count as those with an empty id; repeated rows each count. Components beyond 2^62 after
scaling are clamped to it; distances and their sums beyond 2^63 - 1 are shown as that number. With fewer vectors than
centroids every vector is a first centroid; no vector at all gives an empty result. Other columns aren't
read; they can have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize

PIVOTS = 12
#: Up to this size of components, sums of 64 squared differences fit 64 bits; beyond, Python's integers are used.
SMALL = 1 << 27
_MOST = (1 << 63) - 1


def _exact(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows v (n, d) to c (d) or, row by row, (n, d)."""
    if v.dtype != object and c.dtype != object:
        diff = v - c
        return np.einsum("ij,ij->i", diff, diff)
    diff = v.astype(object) - c.astype(object)
    return (diff * diff).sum(axis=1)


def _fitting(rows: list[list[int]]) -> np.ndarray:
    """Rows of integers as int64 where squared distances fit, else as Python integers."""
    big = any(abs(x) > SMALL for r in rows for x in r)
    return np.array(rows, dtype=object if big else np.int64).reshape(len(rows), -1)


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    return flat.astype(object) if len(flat) and max(int(flat.max()), -int(flat.min())) > SMALL else flat


def _roots(v: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of rows v to every point, as float64 (n, points)."""
    return np.sqrt(np.stack([_exact(v, p).astype(np.float64) for p in points], axis=1))


def pick_pivots(points: np.ndarray, count: int) -> np.ndarray:
    """Rows of `points`, each the farthest from those picked before; the first is row 0."""
    picked = [0]
    far = _exact(points, points[0])
    while len(picked) < min(count, len(points)):
        picked.append(int(np.argmax(far)))
        far = np.minimum(far, _exact(points, points[picked[-1]]))
    return points[picked]


def nearest(v: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid and squared distance of every row, and how many distances were measured."""
    n, k = len(v), len(centroids)
    of_centroids = _roots(centroids, pivots)
    low = np.zeros((n, k))
    for p in range(len(pivots)):
        a, b = to_pivots[:, p, None], of_centroids[None, :, p]
        np.maximum(low, np.abs(a - b) - (a + b) * 2.0**-48, out=low)  # a bound in spite of rounding
    best = np.argmin(low, axis=1)
    least = _exact(v, centroids[best])
    measured = n
    for c in range(k):
        root = np.sqrt(least.astype(np.float64)) * (1 + 2.0**-48)
        rows = np.flatnonzero((low[:, c] <= root) & (best != c))
        if len(rows):
            d = _exact(v[rows], centroids[c])
            closer = (d < least[rows]) | ((d == least[rows]) & (c < best[rows]))
            best[rows[closer]], least[rows[closer]] = c, d[closer]
            measured += len(rows)
    return best, least, measured


def integers(vector: Column, size: int, scale: int) -> Column:
    """floor(scale * x) of every component, clamped to 62 bits."""
    top = float(1 << 62)
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(top)), F.lit(-top)))
    return F.transform(vector, whole)


def usable(vector: Column, size: int) -> Column:
    """The vector has `size` components, all of them finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce((F.size(vector) == size) & F.forall(vector, finite), F.lit(False))


def pivot_table(df: DataFrame, pivots: np.ndarray, size: int) -> DataFrame:
    """id, v and p: each vector's distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _roots(_vectors(b["v"], size), pivots)
            p = pa.ListArray.from_arrays(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([b["id"], b["v"], p], names=["id", "v", "p"])

    return df.mapInArrow(run, "id long, v array<long>, p array<double>")


def _sums(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray, size: int) -> DataFrame:
    """Per task and centroid: c, n (vectors) and s (sum of every component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(centroids), np.int64)
        total = np.zeros((len(centroids), size), object)
        for b in batches:
            v = _vectors(b["v"], size)
            best, _, _ = nearest(v, b["p"].flatten().to_numpy().reshape(len(v), -1), centroids, pivots)
            order = np.argsort(best, kind="stable")
            cut = np.flatnonzero(np.diff(best[order], prepend=-1))
            if len(cut):
                total[best[order][cut]] += np.add.reduceat(v[order], cut, axis=0)
                count += np.bincount(best, minlength=len(centroids))
        full = np.flatnonzero(count)
        s = pa.array([[Decimal(int(x)) for x in total[c]] for c in full], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(count[full]), s], names=["c", "n", "s"])

    return table.mapInArrow(run, "c int, n long, s array<decimal(38,0)>")


def _moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray, size: int) -> np.ndarray:
    """The centroids after a round: componentwise floor of the mean; those without vectors stay."""
    sums = _sums(table, centroids, pivots, size).groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(size)])
    rows = [[int(x) for x in c] for c in centroids]
    for r in sums.collect():  # one row per centroid
        rows[r["c"]] = [int(r[f"s{i}"]) // r["n"] for i in range(size)]
    return _fitting(rows)


def _assigned(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _vectors(b["v"], size)
            best, least, _ = nearest(v, b["p"].flatten().to_numpy().reshape(len(v), -1), centroids, pivots)
            shown = np.minimum(least, _MOST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(best.astype(np.int32)), pa.array(shown)], names=["id", "cluster", "distance"])

    return table.mapInArrow(run, "id long, cluster int, distance long")


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, salt: str = "2:", pivots: int = PIVOTS) -> DataFrame:
    """One row per usable vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    spark = df.sparkSession
    vector = F.col(vector_col)
    kept = df.filter(usable(vector, size)).select(F.col(id_col).cast("long").alias("id"), integers(vector, size, scale).alias("v"))
    name = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = [list(r["v"]) for r in kept.orderBy(name, "v").limit(k).select("v").collect()]  # k rows
    if not first:
        schema = f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], schema)
    centroids = _fitting(first)
    fixed = pick_pivots(centroids, pivots)
    table = materialize(pivot_table(kept, fixed, size))
    for _ in range(rounds):
        centroids = _moved(table, centroids, fixed, size)
    out = materialize(_assigned(table, centroids, fixed, size))
    inertia = {r["cluster"]: int(r["i"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("i")).collect()}  # k rows
    sha = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    whole = min(sum(inertia.values()), _MOST)
    facts = spark.createDataFrame([(c, min(i, _MOST), whole, sha[c]) for c, i in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark, sf_dir: str) -> DataFrame:
    """40 clusters of `embeddings`, five rounds."""
    return cluster(documents(spark, sf_dir, "embeddings"))


def _oracle(rounds: int = 5) -> str:
    """The same clustering by distances to all centroids, in DuckDB."""
    steps = ["""WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT 40))"""]
    near = "SELECT vec_id, v, c, d FROM (SELECT k.vec_id, k.v, m.c, list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept k, c{r} m) QUALIFY row_number() OVER (PARTITION BY vec_id, v ORDER BY d, c) = 1"
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(r=r)})")
        steps.append(f"""s{r} AS MATERIALIZED (SELECT c, i, floor_mean AS x FROM (SELECT c, i, (sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_mean
  FROM a{r}, range(1, 65) t(i) GROUP BY c, i))""")
        steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT m.c, coalesce(n.v, m.v) AS v FROM c{r} m
  LEFT JOIN (SELECT c, list(CAST(x AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY c) n ON n.c = m.c)""")
    steps.append(f"z AS ({near.format(r=rounds)})")
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(z.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY z.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM z JOIN c{rounds} m ON m.c = z.c"""


ORACLE_SQL = _oracle()
