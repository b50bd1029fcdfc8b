"""Item attributes: how consistent they are per item, their mapping, the canonical map, and what departs from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T


def consistency(df: DataFrame, item: str, attributes: Sequence[str]) -> DataFrame:
    """Per item and attribute: rows, rows without it, distinct comparison forms, and whether one form holds."""
    long = df.unpivot(item, list(attributes), "attribute", "value")
    n = long.groupBy(item, "attribute", T.normal_text(F.col("value")).alias("form")).agg(F.count("*").alias("n"), F.count_if(T.missing(F.col("value"))).alias("gone"))
    known = F.col("gone") < F.col("n")
    out = n.groupBy(item, "attribute").agg(F.sum("n").alias("rows"), F.sum("gone").alias("missing"), F.count_if(known).alias("forms"), F.max(F.when(known, F.col("n"))).alias("most"))
    kind = F.when(F.col("forms") == 0, "SEM_VALOR").when(F.col("forms") > 1, "CONFLITANTE").when(F.col("missing") > 0, "INCOMPLETO").otherwise("CONSISTENTE")
    return out.select(item, "attribute", "rows", "missing", "forms", T.percent(F.col("most"), F.col("rows") - F.col("missing")).alias("support_percent"), kind.alias("kind"))


def mapping(df: DataFrame, item: str, attributes: Sequence[str], row_id: str) -> DataFrame:
    """Each combination of attributes of an item: rows, first and last row id, share of the item's rows."""
    n = df.groupBy(item, *attributes).agg(F.count("*").alias("rows"), F.min(row_id).alias("first_row"), F.max(row_id).alias("last_row"))
    total = n.groupBy(item).agg(F.sum("rows").alias("item_rows"), F.count("*").alias("combinations"))
    return n.join(total, item).withColumn("percent", T.percent(F.col("rows"), F.col("item_rows"))).drop("item_rows")


def canonical(df: DataFrame, item: str, attributes: Sequence[str]) -> DataFrame:
    """Per item the most frequent value of each attribute (ties: the smallest), named canonical_<attribute>."""
    long = df.unpivot(item, list(attributes), "attribute", "value").filter(~T.missing(F.col("value")))
    n = long.groupBy(item, "attribute", F.trim("value").alias("value")).agg(F.count("*").alias("n"))
    best = n.groupBy(item, "attribute").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("best"))
    return best.groupBy(item).agg(*[F.max(F.when(F.col("attribute") == a, F.col("best"))).alias(f"canonical_{a}") for a in attributes])


def corrections(df: DataFrame, row_id: str, item: str, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """Proposals where an attribute departs from the canonical map, or is missing while the map knows it.
    rules: attribute -> (rule id of departures, rule id of missing values)."""
    both = df.join(canonical(df, item, list(rules)), item)
    told = []
    for a, (departs, gone) in rules.items():
        have, best = F.col(a), F.col(f"canonical_{a}")
        rule = F.when(best.isNull(), None).when(T.missing(have), gone).when(T.normal_text(have) != T.normal_text(best), departs)
        told.append(F.when(rule.isNotNull(), F.struct(F.lit(a).alias("field"), have.alias("original"), best.alias("proposed"), rule.alias("rule_id"))))
    return both.select(row_id, F.explode(F.array_compact(F.array(*told))).alias("c")).select(row_id, "c.*")


def departures(df: DataFrame, row_id: str, item: str, legacy: str, tracked: str) -> DataFrame:
    """Rows whose product, category or unit departs from the canonical map, whose product is a legacy one or
    whose category is missing, with one class each. tracked: a boolean column, the gap is on record."""
    both = df.join(canonical(df, item, ("product", "category", "unit")), item, "left")
    differs = lambda a: T.holds(~T.missing(F.col(a)) & ~T.normal_text(F.col(a)).eqNullSafe(T.normal_text(F.col(f"canonical_{a}"))))
    old, gone = T.holds(F.contains(T.normal_text(F.col("product")), F.lit(legacy))), T.missing(F.col("category"))
    marks = {"product_differs": differs("product"), "category_differs": differs("category"), "unit_differs": differs("unit"), "legacy": old, "category_missing": gone}
    out = both.withColumns(marks).filter(" OR ".join(marks))
    kind = (
        F.when(F.col("legacy"), "produto_legado_a_corrigir").when(F.col("category_missing") & F.col(tracked), "categoria_nula_conhecida_e_rastreada")
        .when(F.col("category_differs"), "categoria_semantica_divergente").when(F.col("product_differs"), "produto_divergente_do_item")
        .when(F.col("unit_differs"), "medida_divergente_do_item").otherwise("revisar")
    )
    return out.select(row_id, item, "product", "canonical_product", "category", "canonical_category", "unit", "canonical_unit", *marks, F.col(tracked), kind.alias("classification"))
