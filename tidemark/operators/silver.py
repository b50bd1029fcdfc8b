"""Treatment of raw rows: typing with a failure report, text standards, plans with decisions, and controls."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

# The federative units by the comparison form of their names.
UNITS = {
    "acre": "AC", "alagoas": "AL", "amapa": "AP", "amazonas": "AM", "bahia": "BA", "ceara": "CE", "distrito federal": "DF", "espirito santo": "ES", "goias": "GO",
    "maranhao": "MA", "mato grosso": "MT", "mato grosso do sul": "MS", "minas gerais": "MG", "para": "PA", "paraiba": "PB", "parana": "PR", "pernambuco": "PE",
    "piaui": "PI", "rio de janeiro": "RJ", "rio grande do norte": "RN", "rio grande do sul": "RS", "rondonia": "RO", "roraima": "RR", "santa catarina": "SC",
    "sao paulo": "SP", "sergipe": "SE", "tocantins": "TO",
}
# Macro-regions and their units.
REGIONS = {
    "Norte": ("AC", "AP", "AM", "PA", "RO", "RR", "TO"), "Nordeste": ("AL", "BA", "CE", "MA", "PB", "PE", "PI", "RN", "SE"), "Centro-Oeste": ("DF", "GO", "MT", "MS"),
    "Sudeste": ("ES", "MG", "RJ", "SP"), "Sul": ("PR", "RS", "SC"),
}
# Words of a yes or no.
WORDS = {"sim": "Sim", "nao": "Não"}
# What a plan may do with a cell or row.
ACTIONS = (
    "corrigir_deterministicamente", "preservar_valor_origem", "padronizar_sem_alterar_significado", "manter_pendente_regra_negocio",
    "recalcular_validacao_apos_correcao", "excluir_pedido_sem_evidencia_logistica",
)


def mapped(c: Column, words: dict[str, str], otherwise: Column) -> Column:
    """The word that the comparison form of c stands for; what isn't in the list, as `otherwise`."""
    known = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.coalesce(known[T.normal_text(c)], otherwise)


def yes_or_no(c: Column) -> Column:
    return mapped(c, WORDS, T.clean(c))


def unit(c: Column) -> Column:
    """A federative unit from its name or letters; others in upper case."""
    return mapped(c, UNITS, F.upper(T.clean(c)))


def region(c: Column) -> Column:
    """The macro-region of a unit; NULL where it is none."""
    return F.create_map(*[F.lit(x) for name, units in REGIONS.items() for u in units for x in (u, name)])[c]


def whole(c: Column) -> Column:
    """A number as a whole one; NULL where it is none or has a fraction."""
    n = T.number(c)
    return F.when(F.abs(n - F.round(n)) <= 1e-9, F.round(n).cast("long"))


#: How each kind of column is read.
KINDS = {"number": T.number, "integer": whole, "date": T.date, "month": T.month, "time": T.time_of_day}


def typing_report(df: DataFrame, plan: dict[str, str]) -> DataFrame:
    """Per column: informed, converted, failing and (for whole numbers) fractional values, and whether its
    typing is blocked. plan: column -> kind. One pass."""
    parts = []
    for c, kind in plan.items():
        have = ~T.missing(F.col(c))
        n = T.number(F.col(c)) if kind == "integer" else KINDS[kind](F.col(c))
        fraction = have & n.isNotNull() & (KINDS[kind](F.col(c)).isNull() if kind == "integer" else F.lit(False))
        parts.append(F.struct(F.count_if(have).alias("informed"), F.count_if(have & n.isNotNull()).alias("converted"), F.count_if(have & n.isNull()).alias("failures"), F.count_if(fraction).alias("fractional")).alias(c))
    told = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col(c).alias("n")) for c, k in plan.items()]
    out = df.agg(*parts).select(F.explode(F.array(*told)).alias("t")).select("t.column", "t.kind", "t.n.*")
    return out.withColumn("action", F.when((F.col("failures") > 0) | (F.col("fractional") > 0), "BLOQUEAR").otherwise("CONVERTER"))


def typed_rows(df: DataFrame, plan: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """keep and the typed columns of the rows that convert as a whole; `typed_or_fail` refuses others."""
    fine = reduce(lambda a, b: a & b, [T.missing(F.col(c)) | KINDS[k](F.col(c)).isNotNull() for c, k in plan.items()])
    return df.filter(fine).select(*keep, *[KINDS[k](F.col(c)).alias(c) for c, k in plan.items()])


def typed_or_fail(df: DataFrame, plan: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """The typed rows; an error that names the columns where a value does not convert."""
    bad = typing_report(df, plan).filter("action = 'BLOQUEAR'").collect()  # a row per column at most
    if bad:
        raise ValueError("typing fails: " + ", ".join(f"{r['column']} ({r['failures']} failures, {r['fractional']} fractional)" for r in bad))
    return typed_rows(df, plan, keep)


def changes(df: DataFrame, row_id: str, new: dict[str, Column], rule: str, action: str) -> DataFrame:
    """Audit rows for the columns whose new value differs, both as text."""
    told = [F.when(~F.col(c).eqNullSafe(v), F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("before"), v.cast("string").alias("after"))) for c, v in new.items()]
    return df.select(row_id, F.explode(F.array_compact(F.array(*told))).alias("c")).select(row_id, "c.*", F.lit(rule).alias("rule_id"), F.lit(action).alias("action"))


def without_planned(df: DataFrame, row_id: str, plan: DataFrame, rule: str) -> tuple[DataFrame, DataFrame]:
    """df without the rows that a plan removes, and the audit of the removals."""
    gone = plan.filter("action = 'REMOVER'").select(F.col(row_id))
    audit = df.join(gone, row_id, "left_semi").select(row_id, F.lit("linha_completa").alias("field"), F.lit("presente").alias("before"), F.lit("removida").alias("after"), F.lit(rule).alias("rule_id"), F.lit("remover_excedente_duplicado").alias("action"))
    return df.join(gone, row_id, "left_anti"), audit


def decided(corrections: DataFrame, pending: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corrections, open points and excluded rows after a table of decisions has been laid over them.

    decisions: row_id, field, kind ('substituir', 'encerrar' or 'excluir'), value. 'substituir' sets the value of
    a correction or adds one, and closes the open point; 'encerrar' closes the open point; 'excluir' takes the
    row out: its corrections and open points go.
    """
    out = decisions.filter("kind = 'excluir'").select("row_id").distinct()
    new = decisions.filter("kind = 'substituir'").select("row_id", "field", F.col("value").alias("__value"))
    kept = corrections.join(out, "row_id", "left_anti").join(new, ["row_id", "field"], "full_outer").join(out, "row_id", "left_anti")
    rule = F.when(F.col("__value").isNotNull(), "DECISAO").otherwise(F.col("rule_id")).alias("rule_id")
    laid = kept.select("row_id", "field", F.coalesce("__value", "proposed").alias("proposed"), rule)
    closed = decisions.filter("kind <> 'excluir'").select("row_id", "field")
    return laid, pending.join(out, "row_id", "left_anti").join(closed, ["row_id", "field"], "left_anti"), out


def controls(facts: DataFrame, expected: dict[str, Column], critical: Sequence[str] = ()) -> DataFrame:
    """Control records from one row of observed facts: control, observed, expected, status, critical."""
    told = [F.struct(F.lit(c).alias("control"), F.col(c).cast("double").alias("observed"), e.cast("double").alias("expected"), F.lit(c in critical or not critical).alias("critical")) for c, e in expected.items()]
    long = facts.select(F.explode(F.array(*told)).alias("c")).select("c.*")
    same = T.holds(F.abs(F.col("observed") - F.col("expected")) <= 1e-9) | (F.col("observed").isNull() & F.col("expected").isNull())
    return long.withColumn("status", F.when(same, "aprovado").otherwise("reprovado"))
