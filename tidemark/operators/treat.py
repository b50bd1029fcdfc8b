"""Recovery of missing values from peers, correction plans, their application with audit, and lineage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import ordering

CORRECTION = ("row_id", "field", "original", "proposed", "rule_id", "priority")


def recover(df: DataFrame, row_id: str, target: str, group: str, valid: Column | None = None) -> DataFrame:
    """Per row whose target is missing: the most frequent known value of its group (ties: smallest),
    support, and none / deterministic / conflict. Group statistics are made once and joined."""
    known = ~T.missing(F.col(target).cast("string")) & (F.lit(True) if valid is None else T.holds(valid))
    n = df.filter(known).groupBy(group, F.col(target).cast("string").alias("v")).agg(F.count("*").alias("n"))
    stats = n.groupBy(group).agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("candidate"), F.max("n").alias("support"), F.sum("n").alias("known"), F.countDistinct(T.normal_text(F.col("v"))).alias("values"))
    gone = df.filter(T.missing(F.col(target).cast("string"))).select(row_id, group)
    kind = F.when(F.col("values").isNull(), "SEM_EVIDENCIA").when(F.col("values") == 1, "DETERMINISTICO").otherwise("CONFLITO")
    return gone.join(stats, group, "left").select(row_id, group, "candidate", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("known", F.lit(0)).alias("known"), kind.alias("recovery"))


def recover_jointly(df: DataFrame, row_id: str, fields: Sequence[str], group: str) -> DataFrame:
    """Rows with missing fields: which are missing, which of them the group knows one value of, full / partial / none."""
    facts = df.groupBy(group).agg(*[F.countDistinct(F.col(c)).alias(f"__{c}") for c in fields])
    rows = df.join(facts, group)
    gone = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in fields]))
    can = F.array_compact(F.array(*[F.when(F.col(c).isNull() & (F.col(f"__{c}") == 1), F.lit(c)) for c in fields]))
    out = rows.select(row_id, group, F.array_join(gone, " | ").alias("missing"), F.array_join(can, " | ").alias("recoverable"), F.size(gone).alias("m"), F.size(can).alias("r")).filter("m > 0")
    return out.select(row_id, group, "missing", "recoverable", F.when(F.col("r") == 0, "NENHUMA").when(F.col("r") == F.col("m"), "TOTAL").otherwise("PARCIAL").alias("recovery"))


def dedup_plan(df: DataFrame, names: Sequence[str], row_id: str) -> DataFrame:
    """row id, group_first, group_size and action of the rows of repeated groups: keep the first, remove the rest.

    Told by the first row of the group alone, so a row repeated any number of times is no single task."""
    firsts = df.groupBy(*names).agg(F.min(row_id).alias("group_first"), F.count("*").alias("group_size")).filter("group_size > 1")
    same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(firsts[c]) for c in names])
    inside = df.join(firsts, same).select(df[row_id], "group_first", "group_size")
    return inside.withColumn("action", F.when(F.col(row_id) == F.col("group_first"), "MANTER").otherwise("REMOVER"))


def with_places(plan: DataFrame, row_id: str) -> DataFrame:
    """A plan with each row's place in its group, in two phases over all groups."""
    placed = ordering.running(plan, [F.col("group_first"), F.col(row_id)], {}, rank="__at")
    first = placed.groupBy("group_first").agg(F.min("__at").alias("__first"))
    return placed.join(first, "group_first").withColumn("place", (F.col("__at") - F.col("__first") + 1).cast("int")).drop("__at", "__first")


def first_corrections(corrections: DataFrame) -> DataFrame:
    """Of several corrections of a cell the one of the lowest priority number (then rule id)."""
    chosen = F.min_by(F.struct("original", "proposed", "rule_id", "priority"), F.struct("priority", "rule_id"))
    return corrections.groupBy("row_id", "field").agg(chosen.alias("c")).select("row_id", "field", "c.*")


def apply_corrections(df: DataFrame, row_id: str, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df (text columns) with its cells corrected, and the audit of what changed. A null proposal
    counts: presence is told by the key, not by the value."""
    chosen = first_corrections(corrections)
    per_row = chosen.groupBy(F.col("row_id").alias("__row")).agg(F.map_from_entries(F.collect_list(F.struct("field", "proposed"))).alias("__m"))
    fields = [c for c in df.columns if c != row_id]
    joined = df.join(per_row, F.col(row_id) == F.col("__row"), "left")
    fixed = lambda c: F.when(F.coalesce(F.map_contains_key("__m", F.lit(c)), F.lit(False)), F.col("__m")[c]).otherwise(F.col(c)).alias(c)
    before = df.unpivot(row_id, fields, "field", "before").withColumnRenamed(row_id, "row_id")
    audit = chosen.join(before, ["row_id", "field"]).filter(~F.col("before").eqNullSafe(F.col("proposed")))
    return joined.select(row_id, *[fixed(c) for c in fields]), audit.select("row_id", "field", "before", F.col("proposed").alias("after"), "rule_id", F.lit("CORRIGIR").alias("action"))


def standard_variants(df: DataFrame, column: str) -> DataFrame:
    """df with each text replaced by the most frequent variant of its normal form (ties: smallest)."""
    n = df.filter(~T.missing(F.col(column))).groupBy(T.normal_text(F.col(column)).alias("__k"), F.trim(column).alias("__v")).agg(F.count("*").alias("n"))
    best = n.groupBy("__k").agg(F.min_by("__v", F.struct(-F.col("n"), F.col("__v"))).alias("__best"))
    return df.withColumn("__k", T.normal_text(F.col(column))).join(best, "__k", "left").withColumn(column, F.coalesce("__best", column)).drop("__k", "__best")


def quarantine(df: DataFrame, group: str, without: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): groups none of whose rows holds any of the columns are set aside whole."""
    evidence = df.groupBy(group).agg(F.max(F.coalesce(*[F.when(F.col(c).isNotNull(), 1) for c in without], F.lit(0))).alias("e")).filter("e = 0").select(group)
    return df.join(evidence, group, "left_anti"), df.join(evidence, group, "left_semi")


def lineage(df: DataFrame, row_id: str, audit: DataFrame, pending: DataFrame) -> DataFrame:
    """df with the rules applied to each row, its open points and its quality status."""
    listed = lambda d, name: d.groupBy("row_id").agg(F.array_join(F.array_sort(F.collect_set("rule_id")), " | ").alias(name)).withColumnRenamed("row_id", row_id)
    out = df.join(listed(audit, "rules_applied"), row_id, "left").join(listed(pending, "open_points"), row_id, "left")
    return out.withColumn("quality_status", F.when(F.col("open_points").isNotNull(), "pendente").when(F.col("rules_applied").isNotNull(), "tratado").otherwise("sem_alteracao"))


def change_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("action", "rule_id", "field").agg(F.count("*").alias("changes"))
