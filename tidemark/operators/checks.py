"""Controls: one record form for every check, a rule engine, and integrity checks of a star schema."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import holds

FORM = "control string, expected string, observed string, status string, critical boolean"


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def verdict(expected: Column, observed: Column) -> Column:
    return F.when(expected.eqNullSafe(observed), "APROVADO").otherwise("REPROVADO").alias("status")


def records(spark: SparkSession, rows: Sequence[tuple[str, object, object, bool]]) -> DataFrame:
    """Control records of known values: (control, expected, observed, critical)."""
    made = [(n, str(e), str(o), "APROVADO" if e == o else "REPROVADO", c) for n, e, o, c in rows]
    return spark.createDataFrame(made, FORM)


def schema_checks(df: DataFrame, columns: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """Count, names and order, duplicates, empty headers and required columns. No job runs."""
    have = df.columns
    blank = [c for c in have if not c.strip() or c.startswith("Unnamed:")]
    return records(df.sparkSession, [
        ("column_count", len(columns), len(have), True), ("column_names", list(columns), have, True), ("duplicate_headers", 0, len(have) - len(set(have)), True),
        ("empty_headers", 0, len(blank), True), ("required_columns", [], sorted(set(required) - set(have)), True),
    ])


def roles(columns: Sequence[str], contract: Sequence[str], dq: str = "DQ_", technical: str = "_") -> dict[str, str]:
    """Role of each column: analytical, dq, technical or unexpected."""
    return {c: "dq" if c.startswith(dq) else "technical" if c.startswith(technical) else "analytical" if c in contract else "unexpected" for c in columns}


def overall(checks: DataFrame) -> DataFrame:
    """One row: REPROVADO if any critical control was."""
    bad = F.count_if(F.col("critical") & (F.col("status") == "REPROVADO"))
    return checks.agg(F.count("*").alias("controls"), bad.alias("rejected"), F.when(bad > 0, "REPROVADO").otherwise("APROVADO").alias("status"))


@dataclass(frozen=True)
class Rule:
    """A row rule: the condition says where it is broken."""

    rule_id: str
    broken: Column
    level: str = "row"
    severity: str = "alta"


def rule_summary(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: rows, violations, percentage, status. One pass over df for all rules."""
    one = df.agg(F.count("*").alias("rows"), *[F.count_if(holds(r.broken)).alias(r.rule_id) for r in rules])
    long = one.unpivot("rows", [r.rule_id for r in rules], "rule_id", "violations")
    level = F.create_map(*[F.lit(x) for r in rules for x in (r.rule_id, r.level)])
    severity = F.create_map(*[F.lit(x) for r in rules for x in (r.rule_id, r.severity)])
    share = F.coalesce(F.round(F.try_divide(F.col("violations") * F.lit(100.0), F.col("rows")), 4), F.lit(0.0))
    return long.select("rule_id", level[F.col("rule_id")].alias("level"), severity[F.col("rule_id")].alias("severity"), "rows", "violations", share.alias("percent"), F.when(F.col("violations") == 0, "CONFORME").otherwise("DIVERGENTE").alias("status"))


def rule_violations(df: DataFrame, rules: Sequence[Rule], context: Sequence[str]) -> DataFrame:
    """One row per violating row and rule, with context columns."""
    broken = F.array_compact(F.array(*[F.when(holds(r.broken), F.lit(r.rule_id)) for r in rules]))
    return df.select(*context, F.explode(broken).alias("rule_id"))


def grain_checks(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Per table and its grain: rows, distinct keys, duplicate groups, rows with a null key, status."""
    parts = []
    for name, (df, grain) in tables.items():
        null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in grain])
        g = df.groupBy(*grain).agg(F.count("*").alias("n"))
        parts.append(g.agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).alias("null_keys")).select(F.lit(name).alias("table_name"), "*"))
    return union(parts).withColumn("status", F.when((F.col("duplicate_groups") == 0) & (F.col("null_keys") == 0), "APROVADO").otherwise("REPROVADO"))


def orphans(pairs: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Per foreign key (name, child, column, parent, column): child rows with and without a parent, and null keys."""
    parts = []
    for name, child, fk, parent, pk in pairs:
        keys = child.groupBy(F.col(fk).alias("k")).agg(F.count("*").alias("n"))
        known = parent.select(F.col(pk).alias("k"), F.lit(1).alias("known")).distinct()
        out = keys.join(known, "k", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("known").isNull() & F.col("k").isNotNull(), F.col("n"))), F.lit(0)).alias("orphans"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).alias("nulls"))
        parts.append(out.select(F.lit(name).alias("relation"), "*"))
    return union(parts).withColumn("status", F.when(F.col("orphans") == 0, "APROVADO").otherwise("REPROVADO"))


def required_columns(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> dict[str, list[str]]:
    """The required columns that each table lacks. No job runs."""
    return {name: sorted(set(columns) - set(df.columns)) for name, (df, columns) in tables.items()}


def validated(tables: dict[str, tuple[DataFrame, Sequence[str]]], counted: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Control records of what a model is built from, before it is built: columns that are missing (none may be) and, by
    name, pairs of one-row counts that must be equal. One row a control: control, observed, expected, status, details."""
    spark = next(iter(tables.values()))[0].sparkSession
    missing = required_columns(tables)
    rows = [(f"colunas_ausentes_{name}", float(len(gone)), 0.0, " | ".join(gone)) for name, gone in missing.items()]
    out = spark.createDataFrame(rows, "control string, observed double, expected double, details string")
    for name, (observed, expected) in counted.items():
        both = observed.toDF("observed").crossJoin(expected.toDF("expected"))  # one row each
        out = out.unionByName(both.select(F.lit(name).alias("control"), F.col("observed").cast("double"), F.col("expected").cast("double"), F.lit("").alias("details")))
    return out.withColumn("status", F.when(F.col("observed").eqNullSafe(F.col("expected")), "aprovado").otherwise("reprovado"))


def accepted(controls: DataFrame) -> DataFrame:
    """The control records, where none is rejected; otherwise an error that names those that are."""
    bad = controls.filter("status = 'reprovado'").collect()  # a row per control at most
    if bad:
        raise ValueError("rejected: " + "; ".join(f"{r['control']}: {r['observed']} != {r['expected']} {r['details']}".strip() for r in bad))
    return controls
