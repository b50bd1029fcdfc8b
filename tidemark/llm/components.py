"""Connected components over a table of links, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round. large: every larger neighbour is linked with the smallest of the neighbourhood;
    otherwise every smaller neighbour, and the node itself, are."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        near = edges.join(low, "a")
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(id, component) for every id in `links` (a, b): the smallest id it is connected with.

    Rounds of large star and small star until nothing changes; each round's links are written to the
    shared folder, so the lineage stays short. Their number grows with the logarithm of the longest
    chain. A round's joins are keyed by node; the table of minima is unique per node, so a hub with
    many links is a skewed side that Spark can split.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges)
    nodes = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        edges = materialize(_star(_star(edges, True), False))
    found = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return nodes.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
