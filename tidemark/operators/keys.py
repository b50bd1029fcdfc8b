"""Identifiers, candidate keys, granularity and canonical attributes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T


def identifiers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per identifier: rows, missing, distinct, repeated rows, highest frequency and its smallest value."""
    parts = []
    for c in names:
        n = df.groupBy(F.col(c).cast("string").alias("v")).agg(F.count("*").alias("n"))
        gone, many = T.missing(F.col("v")), ~T.missing(F.col("v")) & (F.col("n") > 1)
        total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
        top = F.min_by("v", F.when(~gone, F.struct(-F.col("n"), F.col("v"))))
        parts.append(n.agg(F.sum("n").alias("rows"), total(gone).alias("missing"), F.count_if(~gone).alias("distinct_values"), total(many).alias("repeated_rows"), F.max(F.when(~gone, F.col("n"))).alias("most"), top.alias("most_frequent")).select(F.lit(c).alias("identifier"), "*"))
    return reduce(DataFrame.unionByName, parts)


def candidate_key(df: DataFrame, key: Sequence[str], universe: str = "bruto") -> DataFrame:
    """One row: rows, rows with a missing part, distinct keys, % unique, rows in repeated groups, surplus, is_unique."""
    g = df.groupBy(*key).agg(F.count("*").alias("n"))
    gone = reduce(lambda a, b: a | b, [T.missing(F.col(c).cast("string")) for c in key])
    out = g.agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(gone, F.col("n"))), F.lit(0)).alias("missing_parts"), F.count("*").alias("distinct_keys"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_groups"))
    out = out.withColumn("surplus", F.col("rows") - F.col("distinct_keys")).withColumn("unique_percent", T.percent(F.col("distinct_keys"), F.col("rows")))
    return out.select(F.lit(universe).alias("universe"), F.lit(" + ".join(key)).alias("candidate"), "*", ((F.col("surplus") == 0) & (F.col("missing_parts") == 0)).alias("is_unique"))


def test_keys(df: DataFrame, keys: Sequence[Sequence[str]], columns: Sequence[str]) -> DataFrame:
    """Each key on the raw rows and on the rows without exact repeats: confirmed, potential or not unique."""
    slim = df.select(*columns).distinct()
    raw = reduce(DataFrame.unionByName, [candidate_key(df, k).select("candidate", F.col("is_unique").alias("raw_unique"), F.col("surplus").alias("raw_surplus")) for k in keys])
    net = reduce(DataFrame.unionByName, [candidate_key(slim, k).select("candidate", F.col("is_unique").alias("net_unique"), F.col("surplus").alias("net_surplus")) for k in keys])
    verdict = F.when(F.col("raw_unique"), "CONFIRMADA").when(F.col("net_unique"), "POTENCIAL").otherwise("NAO_UNICA")
    return raw.join(net, "candidate").withColumn("verdict", verdict)


def group_distribution(df: DataFrame, group: str, row_id: str, distinct: Sequence[str]) -> DataFrame:
    """Per group: rows, first and last row, distinct values of other columns."""
    return df.groupBy(group).agg(F.count("*").alias("rows"), F.min(row_id).alias("first_row"), F.max(row_id).alias("last_row"), *[F.countDistinct(c).alias(f"n_{c}") for c in distinct])


def granularity(df: DataFrame, group: str, owner: str) -> DataFrame:
    """One row: groups, single and multi-row groups, mean, median, p95, max, groups with several owners."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(owner).alias("o"))
    return g.agg(F.count("*").alias("groups"), F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") > 1).alias("multi"), T.ratio(F.sum("n"), F.count("*")).alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.round(F.percentile("n", F.lit(0.95)), 6).alias("p95"), F.max("n").alias("most"), F.count_if(F.col("o") > 1).alias("several_owners"))


def histogram(df: DataFrame, group: str) -> DataFrame:
    """Groups per number of rows."""
    return df.groupBy(group).agg(F.count("*").alias("rows")).groupBy("rows").agg(F.count("*").alias("groups"))


def varying_columns(df: DataFrame, group: str, names: Sequence[str]) -> DataFrame:
    """Per column: groups of several rows in which it takes more than one value."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), *[F.countDistinct(c).alias(c) for c in names]).filter("n > 1")
    one = g.agg(F.count("*").alias("groups"), *[F.count_if(F.col(c) > 1).alias(c) for c in names])
    return one.unpivot("groups", list(names), "column", "varying").withColumn("percent", T.percent(F.col("varying"), F.col("groups")))


def canonical_map(df: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Per key and attribute: modal value (ties: smallest), its support %, distinct raw and normalised values, problem."""
    n = df.select(key, *[F.col(c).cast("string").alias(c) for c in names]).unpivot(key, list(names), "attribute", "value").groupBy(key, "attribute", "value").agg(F.count("*").alias("n"))
    known = ~T.missing(F.col("value"))
    g = n.groupBy(key, "attribute").agg(
        F.min_by("value", F.when(known, F.struct(-F.col("n"), F.col("value")))).alias("canonical"), F.max(F.when(known, F.col("n"))).alias("support"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("known"),
        F.sum("n").alias("rows"), F.count_if(known).alias("raw_values"), F.countDistinct(F.when(known, T.normal_text(F.col("value")))).alias("normal_values"),
    )
    problems = F.array_join(F.array_compact(F.array(F.when(F.col("known") < F.col("rows"), "AUSENTE"), F.when(F.col("normal_values") > 1, "CONFLITO"), F.when(F.col("raw_values") > F.col("normal_values"), "VARIANTE"))), " | ")
    return g.select(key, "attribute", "canonical", T.percent(F.coalesce("support", F.lit(0)), F.col("known")).alias("support_percent"), "raw_values", "normal_values", problems.alias("problems"))


def attribute_conflicts(df: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """(key, attribute, n_values) where a key has two known values or more."""
    g = df.groupBy(key).agg(*[F.countDistinct(F.when(~T.missing(F.col(c).cast("string")), F.col(c).cast("string"))).alias(c) for c in names])
    return g.unpivot(key, list(names), "attribute", "n_values").filter("n_values > 1")


def frequency_text(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group 'value: n | value: n' of all its values, by falling n then value; a null is `<NULO>`."""
    shown = F.coalesce(F.col(value).cast("string"), F.lit("<NULO>"))
    n = df.groupBy(group, shown.alias("v")).agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "v")))
    return n.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: F.concat(x["v"], F.lit(": "), (-x["m"]).cast("string"))), " | ").alias("frequencies"))


def differing_columns(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(keys, column, n_values) for the columns that differ within repeated keys."""
    many = df.groupBy(*keys).count().filter("count > 1").select(*keys)
    g = df.join(many, list(keys), "left_semi").groupBy(*keys).agg(*[F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit("<NULO>"))).alias(c) for c in names])
    return g.unpivot(list(keys), list(names), "column", "n_values").filter("n_values > 1")
