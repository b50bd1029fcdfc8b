"""Publishing and guarded reading of tables, with content hashes in place of file hashes."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Statuses that reject a script or a load.
REJECTED = ("REPROVADO", "FAILED", "ERROR", "ERRO", "REJECTED")


def _shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; without it a local one, where Spark runs in one process, else an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = getattr(_shared, "local", None)
        if base is None:  # a single machine: tests
            base = _shared.local = tempfile.mkdtemp(prefix="spark-tidemark-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{_shared(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, free_shuffles: bool = False) -> DataFrame:
    """df written to the shared folder (spark.checkpoint.dir) and read back: one durable copy for several uses.

    free_shuffles: let the write's shuffle files go as soon as it has ended; only for plans of which no stage can
    still read them by then (the other side of a join that turns out empty may).
    """
    spark = df.sparkSession
    path = scratch(spark)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, str(free_shuffles).lower())
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all that `stored` has written in this application, once its results are no longer read."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(f"{_shared(spark)}/{context.applicationId}")
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def read_text(spark: SparkSession, path: str, columns: Sequence[str], first: int = 2, name: str = "_source_row_number") -> DataFrame:
    """A Parquet table with every column as text, in contract order, and the number of each row in its source,
    counted from the line after a header. A column that the file lacks is an error."""
    df = spark.read.parquet(path)
    return numbered(df.select(*[F.col(c).cast("string").alias(c) for c in columns], "_metadata"), first, name)


def numbered(df: DataFrame, first: int = 1, name: str = "row_number") -> DataFrame:
    """Rows of Parquet files with the number each has in its source, from `first` on; files count by path.

    df: as read, with its `_metadata` column. A row's number is its place in the file plus the rows of the files
    before, so numbers need no sort and are the same for any split of files into tasks. One row a file
    is put in order.
    """
    files = df.groupBy(F.col("_metadata.file_path").alias("__file")).agg((F.max("_metadata.row_index") + 1).alias("__rows"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("__file", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    rows = df.withColumn("__file", F.col("_metadata.file_path")).withColumn("__at", F.col("_metadata.row_index")).drop("_metadata")
    return rows.join(offsets, "__file").withColumn(name, F.col("__at") + F.col("__before") + first).drop("__file", "__at", "__before")


def write_by_month(df: DataFrame, path: str, month: str, cluster: Sequence[str], months: Sequence[int] | None = None) -> None:
    """Write a fact as a folder per month; with `months`, overwrite these months only and leave the others.

    Rows are dealt by ranges of (month, cluster), so a large month is several files, each of a range of
    the cluster columns, and a month with most rows is no single task. Overwriting is dynamic: a
    month that the data does not hold stays as it is.
    """
    if months is not None:
        df = df.filter(F.col(month).isin(list(months)))
    dealt = df.repartitionByRange(F.col(month), *[F.col(c) for c in cluster]).sortWithinPartitions(month, *cluster)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(month).parquet(path)


def by_contract(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The table at `path`, which must hold exactly these columns ("name TYPE"), in this order.

    The names and types come from the files (and folders), not from the contract: a missing, added,
    moved or retyped column is an error, before any row is read.
    """
    df = spark.read.parquet(path)
    want = [(f.name, f.dataType.simpleString()) for f in spark.createDataFrame([], ", ".join(columns)).schema]
    have = [(f.name, f.dataType.simpleString()) for f in df.schema]
    if want != have:
        raise ValueError(f"{path} departs from its contract: wanted {want}, found {have}")
    return df


def row_digest(df: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)


def content(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns, content_hash: the same for any order and any layout of files."""
    part = F.conv(F.substring(row_digest(df), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.sha2(F.coalesce(F.sum(part), F.lit(0)).cast("string"), 256).alias("content_hash"))


@dataclass(frozen=True)
class Manifest:
    """What a published table must still be when it is read."""

    n_rows: int
    n_columns: int
    content_hash: str
    status: str = "success"

    @classmethod
    def of(cls, df: DataFrame) -> Manifest:
        r = content(df).first()
        return cls(r["n_rows"], r["n_columns"], r["content_hash"])


def publish(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> Manifest:
    """Write with Spark's commit protocol, read back, compare, and return the manifest."""
    df.write.mode("overwrite").option("compression", "snappy").partitionBy(*partition_by).parquet(path)
    want, got = Manifest.of(df), Manifest.of(df.sparkSession.read.parquet(path).select(*df.columns))
    if want != got:
        raise ValueError(f"{path} does not read back as it was written: {want} / {got}")
    return got


def publish_if_changed(df: DataFrame, path: str, last: Manifest | None) -> tuple[Manifest, bool]:
    """Skip the write if the content is that of the last manifest."""
    now = Manifest.of(df)
    return (now, False) if now == last else (publish(df, path), True)


def guarded(df: DataFrame, manifest: Manifest) -> DataFrame:
    """df, after its rows, columns and content have been held against the manifest."""
    if manifest.status != "success":
        raise ValueError(f"the upstream stage ended as {manifest.status}")
    if (now := Manifest.of(df)) != manifest:
        raise ValueError(f"the table is not what its manifest says: {now} / {manifest}")
    return df


def gate(df: DataFrame) -> DataFrame:
    """Raise if any status column holds a rejecting value; otherwise df."""
    status = [c for c in df.columns if c.lower().startswith("status")]
    bad = [F.upper(F.trim(F.col(c))).isin(*REJECTED) for c in status]
    if bad and df.filter(F.coalesce(*[F.nullif(b, F.lit(False)) for b in bad], F.lit(False))).limit(1).count():
        raise ValueError("a check was rejected")
    return df


def present(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """object, present, rows of the tables and views that are asked for by name."""
    parts = []
    for n in names:
        if spark.catalog.tableExists(n):
            parts.append(spark.table(n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("object"), F.lit(True).alias("present"), "rows"))
        else:
            parts.append(spark.createDataFrame([(n, False, None)], "object string, present boolean, rows bigint"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: name and rows."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reconcile(source: dict[str, DataFrame], target: dict[str, DataFrame]) -> DataFrame:
    """Rows of source and target per table, with a status."""
    both = counts(source).withColumnRenamed("rows", "source_rows").join(counts(target).withColumnRenamed("rows", "target_rows"), "table_name", "full_outer")
    return both.withColumn("status", F.when(F.col("source_rows").eqNullSafe(F.col("target_rows")), "APROVADO").otherwise("REPROVADO"))


def exported(results: dict[str, DataFrame], path: str) -> DataFrame:
    """Write each named result; one row each: rows, rows with nulls, duplicate rows, content hash."""
    out = None
    for name, df in results.items():
        m = publish(df, f"{path}/{name}")
        null = F.coalesce(F.greatest(*[F.col(c).isNull().cast("int") for c in df.columns], F.lit(0)), F.lit(0))
        one = df.agg(F.count("*").alias("rows"), F.sum(null).alias("rows_with_null"), (F.count("*") - F.count_distinct(F.struct(*df.columns))).alias("duplicates"))
        one = one.select(F.lit(name).alias("result"), "*", F.lit(m.content_hash).alias("content_hash"))
        out = one if out is None else out.unionByName(one)
    return out
