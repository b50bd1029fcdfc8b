"""Helpers that the text operators share: inputs, shared scratch tables and Arrow batch size."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts may be very long, so a batch is kept small: memory in a Python
#: worker is this many texts, not a whole partition.
ROWS_PER_BATCH = 256
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A table of the input folder, read by Spark only (the path may be in any store Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in this session, since single texts can be megabytes long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the shared folder of spark.checkpoint.dir.

    The folder is read from the session. Only where it is unset and Spark runs in one process (a test)
    a local temporary folder takes its place, removed when the driver's Python ends; on a cluster,
    where executors would not see each other's files, that is an error.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = getattr(scratch_dir, "local", None)
        if base is None:
            base = scratch_dir.local = tempfile.mkdtemp(prefix="spark-tidemark-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{context.applicationId}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, free_shuffles: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage at a durable copy: a lost executor costs a re-read, not a recomputation,
    and a result that several later jobs use is computed once. free_shuffles: let the write's shuffle
    files go as soon as it has ended; only for plans of which no stage can still run by then (a join
    that turns out empty leaves its other side running, which then waits for files that are gone).
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, str(free_shuffles).lower())
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all that `materialize` has written in this application, once its results are no longer read."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark)).getParent()
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(id_col: str, k: int):
    """crc32 of the id's text, modulo k (null ids count as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % k


def packed(text: Column) -> Column:
    """The text's UTF-8, compressed: for texts that have to cross the network, at half their size."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        packer = zstandard.ZstdCompressor(level=1)
        for t in texts:
            yield pd.Series([packer.compress(x.encode()) for x in t.tolist()])

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "binary")(text)
