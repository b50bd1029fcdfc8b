"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

Each row gets a number and belongs to one of R = 2^k runs by a hash of its id. A run lists the distinct
texts of its rows in the order of their digests (SHA-256, byte length and a second 64-bit hash, so that
a clash of one digest alone cannot join two texts), each with the best row and the number of rows. In
round j the runs whose numbers differ in the j-th group of bits exchange entries: an entry moves to
the run whose bits in that group are those of its digest. There the up to `fan_in` runs that meet are
merged in digest order (a sort by run and digest and a sorted aggregate, in one task a run), keeping
the best row and adding the counts. After all rounds a digest's entries have met in one run, and no
step brought together more than `fan_in` entries of one digest, however many copies it has: there is
no hot key. The decision then travels down the same tree, one join a level, on keys that are unique
per level. Every level is written once and read by the way up and the way down.

Nulls count as the empty text. The best row is that with the smallest or largest id; a null id never
wins over a non-null one, and of rows with equal ids and equal texts one stays (that with the lowest
row number, which follows the order of the input's partitions). An empty table gives an empty result.
Only the id and text columns are read; other columns can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, partitions

_KEY = ["__tm_sha", "__tm_bytes", "__tm_hash"]


def _numbered(df: DataFrame, text_col: str, *columns: Column | str) -> DataFrame:
    """The columns, a number for every row and the digests of its text, written once: the numbers hold."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = [F.unhex(F.sha2(text, 256)).alias("__tm_sha"), F.octet_length(text).alias("__tm_bytes"), F.xxhash64(text).alias("__tm_hash")]
    return materialize(df.select(*columns, F.monotonically_increasing_id().alias("__tm_row"), *digest))


def _rounds(runs: int, fan_in: int) -> list[int]:
    """The bit masks of the run number that each round settles."""
    step, bits = max(1, fan_in.bit_length() - 1), runs.bit_length() - 1
    return [((1 << min(step, bits - low)) - 1) << low for low in range(0, bits, step)]


def _decided(rows: DataFrame, keep: str, runs: int | None, fan_in: int) -> DataFrame:
    """rows (__tm_id, __tm_row and digests) with __tm_best, a struct (id, row), and __tm_size."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    shuffled = partitions(rows.sparkSession)
    runs = runs or 1 << (4 * shuffled - 1).bit_length()
    if runs & (runs - 1):
        raise ValueError("runs must be a power of two")
    first, ident, row = (F.min if keep == "smallest" else F.max), F.col("__tm_id"), F.col("__tm_row")
    best = F.struct(ident.isNull() if keep == "smallest" else ident.isNotNull(), ident.alias("id"), (row if keep == "smallest" else -row).alias("row"))
    rows = rows.withColumn("__tm_run0", F.pmod(F.xxhash64("__tm_id", "__tm_row"), F.lit(runs)))
    prefix = F.conv(F.hex(F.substring("__tm_sha", 1, 4)), 16, 10).cast("long")
    masks = _rounds(runs, fan_in)

    def moved(level: DataFrame, j: int) -> DataFrame:
        """The run that each entry of level j goes to in the next round."""
        if j == len(masks):
            return level
        stays, goes = F.col(f"__tm_run{j}").bitwiseAND(F.lit(~masks[j])), prefix.bitwiseAND(F.lit(masks[j]))
        return level.withColumn(f"__tm_run{j + 1}", stays.bitwiseOR(goes))

    entries = rows.groupBy("__tm_run0", *_KEY).agg(first(best).alias("__tm_best"), F.count("*").alias("__tm_size"))
    levels = [materialize(moved(entries, 0))]
    for j in range(1, len(masks) + 1):
        met = levels[-1].drop(f"__tm_run{j - 1}").repartition(shuffled, f"__tm_run{j}")
        merged = met.groupBy(f"__tm_run{j}", *_KEY).agg(first("__tm_best").alias("__tm_best"), F.sum("__tm_size").alias("__tm_size"))
        levels.append(materialize(moved(merged, j)))

    decided = levels[-1]
    for j in range(len(masks) - 1, -1, -1):
        below = levels[j].select(f"__tm_run{j}", f"__tm_run{j + 1}", *_KEY)
        decided = below.join(decided, [f"__tm_run{j + 1}", *_KEY]).drop(f"__tm_run{j + 1}")
    return rows.join(decided, ["__tm_run0", *_KEY]).drop("__tm_run0")


def _kept() -> Column:
    return F.col("__tm_row") == F.abs("__tm_best.row")


def duplicate_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", runs: int | None = None, fan_in: int = 8) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    keep: which id of equal texts stays, "smallest" or "largest". runs: number of runs, a power of
    two (by default at least four times the session's shuffle partitions).
    """
    rows = _numbered(df, text_col, F.col(id_col).alias("__tm_id"))
    return _decided(rows, keep, runs, fan_in).select(
        F.col("__tm_id").alias(id_col),
        F.col("__tm_best.id").alias("keep_id"),
        F.col("__tm_size").alias("group_size"),
        _kept().alias("kept"),
        F.lower(F.hex("__tm_sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """df with one row of every text, that `duplicate_table` keeps.

    The numbered rows are written once; the dropped ones' numbers, eight bytes each, are joined to
    them, and Spark picks the join by their measured size.
    """
    rows = _numbered(df, text_col, *[F.col(f"`{c}`") for c in df.columns])
    thin = rows.select(F.col(id_col).alias("__tm_id"), "__tm_row", *_KEY)
    dropped = _decided(thin, keep, None, 8).filter(~_kept()).select("__tm_row")
    return rows.join(dropped, "__tm_row", "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Equal texts of `documents`; the row with the largest doc_id stays."""
    return duplicate_table(documents(spark, sf_dir), keep="largest")


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
