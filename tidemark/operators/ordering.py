"""Global order without a single task: dense keys, running sums and n-tiles in two phases.

An unpartitioned window brings every row to one task. Here rows are dealt by ranges of the order key,
numbered within their range, and shifted by what the ranges before them hold; only one row a range is
put in order globally. Range bounds are sampled, so the dealt rows are written before they are used
twice: both phases see the same ranges. Ties need a unique tie-break among the keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import stored


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], rank: str = "rank", total_rows: str | None = None) -> DataFrame:
    """df with `rank` (1, 2, ...) in the given order, and for each name in `sums` the running sum of
    its column up to the row, plus `<name>_total`."""
    dealt = stored(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    within = Window.partitionBy("__range").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.select("*", F.row_number().over(within).cast("long").alias("__n"), *[F.sum(c).over(upto).alias(f"__s_{n}") for n, c in sums.items()])
    ranges = dealt.groupBy("__range").agg(F.count("*").alias("__rows"), *[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    whole = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = ranges.select(
        "__range", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__o"), F.sum("__rows").over(whole).alias("__all"),
        *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums], *[F.sum(f"__t_{n}").over(whole).alias(f"{n}_total") for n in sums],
    )
    out = local.join(F.broadcast(offsets), "__range").withColumn(rank, F.col("__n") + F.col("__o"))
    for n in sums:
        out = out.withColumn(n, F.col(f"__s_{n}") + F.col(f"__o_{n}"))
    if total_rows:
        out = out.withColumn(total_rows, F.col("__all"))
    return out.drop("__range", "__n", "__o", "__all", *[f"__s_{n}" for n in sums], *[f"__o_{n}" for n in sums])


def dense_keys(df: DataFrame, natural: Sequence[str], key: str) -> DataFrame:
    """The distinct, non-null natural keys with surrogate keys 1..n in their order."""
    distinct = df.select(*natural).dropna(subset=list(natural)).distinct()
    return running(distinct, [F.col(c) for c in natural], {}, rank=key)


def ntile(df: DataFrame, order: Sequence[Column], n: int, name: str) -> DataFrame:
    """df with the n-tile of each row: the first (rows mod n) tiles hold one row more."""
    out = running(df, order, {}, rank="__r", total_rows="__whole")
    size, more = F.floor(F.col("__whole") / n), F.col("__whole") % n
    cut = more * (size + 1)
    tile = F.when(F.col("__r") <= cut, F.floor((F.col("__r") - 1) / (size + 1)) + 1).otherwise(F.floor((F.col("__r") - 1 - cut) / F.greatest(size, F.lit(1))) + more + 1)
    return out.withColumn(name, tile.cast("long")).drop("__r", "__whole")


def quantiles(counted: DataFrame, key: Sequence[str], value: str, count: str, at: dict[str, float]) -> DataFrame:
    """Per key the interpolated quantiles of a value, from a table of distinct values with their counts
    (non-null). Values are put in order by ranges, so a key with any number of values is no single task."""
    upto = running(counted.select(*key, value, count), [F.col(c) for c in (*key, value)], {"__upto": F.col(count)}).select(*key, value, count, "__upto")
    sizes = upto.groupBy(*key).agg(F.sum(count).alias("__size"), F.min(F.col("__upto") - F.col(count)).alias("__before"))
    ranked = upto.join(sizes, list(key)) if key else upto.crossJoin(F.broadcast(sizes))  # one row
    ranked = ranked.withColumn("__upto", F.col("__upto") - F.col("__before"))
    place = lambda p: (F.col("__size") - 1) * F.lit(float(p))  # noqa: E731  from 0
    first = lambda p, more: F.min(F.when(F.col("__upto") > more(place(p)), F.col(value)))
    both = ranked.groupBy(*key, "__size").agg(*[first(p, up).alias(f"__{n}_{i}") for n, p in at.items() for i, up in enumerate((F.floor, F.ceil))])
    between = lambda n, p: F.col(f"__{n}_0") + (F.col(f"__{n}_1") - F.col(f"__{n}_0")) * (place(p) - F.floor(place(p)))
    return both.select(*key, *[between(n, p).alias(n) for n, p in at.items()])


def sketched_quantiles(df: DataFrame, key: str, part: str, value: str, at: Sequence[float], most: float) -> DataFrame:
    """key, p, n, within: approximate quantiles of a value per key from mergeable sketches, one for each
    (key, part), so that a part that changes is sketched alone; within: the approximate value's true rank
    lies no further than `most` of the rows from p. The rank is counted exactly, in one further pass."""
    sketches = df.groupBy(key, part).agg(F.kll_sketch_agg_double(value).alias("sketch"))
    whole = sketches.groupBy(key).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    told = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("q")) for p in at])
    found = stored(whole.select(key, F.explode(told).alias("x")).select(key, "x.*"))  # one row a key and p; sketches are random, so made once
    below, upto = F.count_if(F.col(value) < F.col("q")), F.count_if(F.col(value) <= F.col("q"))
    n = F.count("*")
    out = df.join(found, key).groupBy(key, "p").agg(n.alias("n"), below.alias("__below"), upto.alias("__upto"))
    near = (F.col("__below") <= (F.col("p") + most) * F.col("n")) & (F.col("__upto") >= (F.col("p") - most) * F.col("n"))
    return out.select(key, "p", "n", near.alias("within"))
