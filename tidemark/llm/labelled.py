"""Training rows for the classifiers: a bounded sample of labelled documents, the same at every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int, folds: int = 5, held_out: int = 0) -> DataFrame:
    """At most `bound` rows (y double, text string) whose crc32(doc_id as text) mod folds isn't held_out.

    The rows with the smallest hashes of their ids are taken, so the sample is the same at every run
    and doesn't depend on the order of rows. Only ids and labels take part in the choice; since
    `bound` caps their number (16 bytes a row), they may be broadcast to the scan of the texts.
    Rows without a label are left out.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", folds) != held_out))
    one = known.groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    chosen = one.orderBy(F.xxhash64("doc_id", F.lit("tidemark")), "doc_id").limit(bound)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("y", "text")
