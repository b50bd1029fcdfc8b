"""The row rules of raw order lines, as data over columns, and what they report.

A rule names the rows it breaks on. Most look at one column; some relate two; the last test how the
purchase value comes about. Parameters: the day up to which purchases may lie, and the year they
should lie in.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

# Tolerances of money, of shares and of zero amounts, and the relative one beside them.
MONEY, SHARE, ZERO, RELATIVE = 0.01, 1e-9, 0.001, 1e-5


@dataclass(frozen=True)
class LineRule:
    """rule_id, where it is broken, level, severity; among: the rows it is tested on (all by default);
    hypothesis: it tests how a value comes about, and a breach needs no look at the row."""

    rule_id: str
    broken: Column
    level: str
    severity: str
    among: Column | None = None
    hypothesis: bool = False


def prepared(df: DataFrame) -> DataFrame:
    """The lines with what several rules need: the discount as a share (of 1 where no value of the table
    is above 1, else of 100), texts in comparison form, and the values that two formulas give."""
    scale = df.agg(F.when(F.max("discount") <= 1, F.lit(1.0)).otherwise(F.lit(100.0)).alias("discount_scale"))
    out = df.crossJoin(F.broadcast(scale))  # one row
    out = out.withColumn("discount_share", F.col("discount") / F.col("discount_scale"))
    gross = F.col("qty") * F.col("price")
    keys = {f"{c}_key": T.normal_text(F.col(c)) for c in ("free_shipping", "coupon", "late_flag")}
    return out.withColumns(keys | {"value_gross": gross, "value_discounted": gross * (1 - F.col("discount_share"))})


def line_rules(as_of: str, year: int) -> list[LineRule]:
    """All rules over `prepared` lines."""
    c, near = F.col, T.close
    # Rule names, levels and severities.
    simple = [
        ("idade_fora_16_100", (c("age") < 16) | (c("age") > 100), "cliente", "alta"),
        ("experiencia_negativa", c("experience") < 0, "cliente", "alta"),
        ("experiencia_incompativel_idade", c("experience") > c("age") - 14, "cliente", "alta"),
        ("renda_negativa", c("income") < 0, "cliente", "alta"),
        ("renda_zero_requer_contexto", F.abs("income") <= ZERO, "cliente", "baixa"),
        ("intervalo_negativo", c("purchase_interval") < 0, "cliente", "alta"),
        ("ticket_nao_positivo", c("ticket") <= 0, "cliente", "alta"),
        ("quantidade_nao_positiva", c("qty") <= 0, "item_pedido", "alta"),
        ("custo_nao_positivo", c("cost") <= 0, "item", "alta"),
        ("preco_nao_positivo", c("price") <= 0, "item", "alta"),
        ("custo_superior_preco", c("cost") > c("price"), "item_pedido", "media"),
        ("valor_compra_negativo", c("value") < 0, "item_pedido", "alta"),
        ("frete_negativo", c("freight") < 0, "pedido", "alta"),
        ("prazo_prometido_negativo", c("promised") < 0, "pedido", "alta"),
        ("prazo_real_negativo", c("actual") < 0, "pedido", "alta"),
        ("avaliacao_fora_1_5", ~c("rating").between(1, 5), "pedido", "alta"),
        ("pontos_negativos", c("points") < 0, "cliente", "alta"),
        ("desconto_fora_escala", ~c("discount_share").between(0, 1), "item_pedido", "alta"),
    ]
    free, coupon, share = c("free_shipping_key"), c("coupon_key"), c("discount_share")
    no_freight, no_discount = T.holds(near(c("freight"), F.lit(0.0), ZERO)), T.holds(near(share, F.lit(0.0), SHARE))
    expected = F.when(c("actual") - c("promised") > 1, "sim").when(c("actual") - c("promised") <= 1, "nao")
    relational = [
        ("frete_gratis_incoerente_com_frete", ((free == "sim") & ~no_freight) | ((free == "nao") & no_freight), "pedido", "media"),
        ("cupom_incoerente_com_desconto", ((coupon == "nao") & (share > 0)) | ((coupon == "sim") & no_discount), "item_pedido", "media"),
        ("mes_ref_difere_data_compra", c("month_ref") != F.year("bought_on") * 100 + F.month("bought_on"), "pedido", "alta"),
        ("data_compra_futura", c("bought_on") > F.lit(as_of).cast("date"), "pedido", "alta"),
        (f"data_compra_fora_periodo_{year}", F.year("bought_on") != year, "pedido", "media"),
        ("atraso_entrega_coerente_com_prazos", c("late_flag_key") != expected, "pedido", "alta"),
    ]
    informed = c("value").isNotNull() & c("value_gross").isNotNull()
    by_gross = T.holds(near(c("value"), c("value_gross"), MONEY, RELATIVE))
    by_discount = T.holds(near(c("value"), c("value_discounted"), MONEY, RELATIVE))
    formulas = [
        LineRule("valor_compra_igual_quantidade_preco", informed & ~by_gross, "item_pedido", "diagnostico_formula", informed, True),
        LineRule("valor_compra_com_desconto", informed & ~by_discount, "item_pedido", "diagnostico_formula", informed, True),
        LineRule("valor_compra_nao_reproduz_formulas_testadas", informed & ~by_gross & ~by_discount, "item_pedido", "media"),
    ]
    return [LineRule(*r) for r in simple + relational] + formulas


def report(lines: DataFrame, rules: Sequence[LineRule]) -> DataFrame:
    """One row per rule: rows tested, breaches, percentage and status; one pass over the lines."""
    every = F.lit(True)
    counts = [F.struct(F.count_if(every if r.among is None else r.among).alias("rows"), F.count_if(T.holds(r.broken)).alias("violations")).alias(r.rule_id) for r in rules]
    one = lines.agg(*counts)
    told = [F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.level).alias("level"), F.lit(r.severity).alias("severity"), F.lit(r.hypothesis).alias("hypothesis"), F.col(r.rule_id).alias("n")) for r in rules]
    long = one.select(F.explode(F.array(*told)).alias("r")).select("r.rule_id", "r.level", "r.severity", "r.hypothesis", "r.n.*")
    status = F.when(F.col("hypothesis"), "hipotese_formula").when(F.col("violations") == 0, "conforme").otherwise("investigar")
    return long.select("rule_id", "level", "severity", "rows", "violations", T.percent(F.col("violations"), F.col("rows")).alias("percent"), status.alias("status"))


def breaches(lines: DataFrame, rules: Sequence[LineRule], context: Sequence[str]) -> DataFrame:
    """One row per line and rule it breaks (formula hypotheses aside), with context columns."""
    hit = F.array_compact(F.array(*[F.when(T.holds(r.broken), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"))) for r in rules if not r.hypothesis]))
    return lines.select(*context, F.explode(hit).alias("r")).select(*context, "r.*")


def likely_cause(qty: Column, else_cause: str) -> Column:
    """Why a purchase value does not follow from quantity, price and discount."""
    return F.when(qty <= 0, "quantidade_invalida").when(qty >= 100, "quantidade_extrema").otherwise(else_cause)


def histories(df: DataFrame, group: str, value: str, valid: Column) -> DataFrame:
    """Per group: the most frequent valid value (ties: the smallest) as candidate, its support, the number of
    distinct valid values, and all values with their frequencies as text, most frequent first."""
    n = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"), F.first(valid).alias("ok"))
    best = F.min_by(F.struct(F.col(value).alias("v"), "n"), F.when(F.col("ok"), F.struct(-F.col("n"), F.col(value))))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))))
    text = F.array_join(F.transform(listed, lambda x: F.concat_ws(": ", x["v"].cast("string"), (-x["m"]).cast("string"))), " | ")
    out = n.groupBy(group).agg(best.alias("b"), F.count_if("ok").alias("valid_values"), text.alias("history"))
    return out.select(group, F.col("b.v").alias("candidate"), F.coalesce("b.n", F.lit(0)).alias("support"), "valid_values", "history")


def age_candidates(df: DataFrame) -> DataFrame:
    """Lines whose age lies outside 16 to 100, with the client's valid history as evidence."""
    past = histories(df, "client_id", "age", F.col("age").between(16, 100))
    found = df.filter(~F.col("age").between(16, 100)).select("row_id", "order_id", "client_id", F.col("age").alias("invalid_age")).join(past, "client_id")
    kind = F.when(F.col("valid_values") == 0, "sem_evidencia").when(F.col("valid_values") == 1, "recuperavel_deterministico").otherwise("candidato_com_conflito")
    out = found.withColumn("classification", kind)
    return out.withColumn("decision", F.when(F.col("valid_values") == 1, "preencher_com_historico").otherwise("revisao_manual"))


def quantity_candidates(lines: DataFrame, high: int = 6, extreme: int = 100) -> DataFrame:
    """Lines whose quantity is not positive or above `high`: what whole quantity the value speaks for."""
    factor = F.col("price") * (1 - F.col("discount") / 100)
    estimate = F.try_divide(F.col("value"), factor)
    whole = F.bround(estimate)
    fits = T.holds((whole > 0) & (F.abs(estimate - whole) <= MONEY))
    kind = F.when(F.col("qty") <= 0, "quantidade_invalida").when(F.col("qty") >= extreme, "quantidade_extrema_provavel_erro").otherwise("quantidade_alta_plausivel")
    out = lines.filter((F.col("qty") <= 0) | (F.col("qty") > high)).select(
        "row_id", "order_id", "client_id", "item_id", "qty", estimate.alias("estimate"), F.when(fits, whole).alias("candidate"), fits.alias("reproduces_value"), kind.alias("classification")
    )
    usable = F.col("reproduces_value") & (F.col("classification") != "quantidade_alta_plausivel")
    return out.withColumn("decision", F.when(usable, "usar_quantidade_estimada").otherwise("preservar_e_revisar"))


def value_differences(lines: DataFrame) -> DataFrame:
    """Lines whose value is not quantity x price x (1 - discount) to the cent, with the likely cause."""
    expected = F.col("qty") * F.col("price") * (1 - F.col("discount") / 100)
    out = lines.select("row_id", "order_id", "client_id", "item_id", "qty", "value", expected.alias("recalculated"), (F.col("value") - expected).alias("difference"))
    out = out.filter(F.abs("difference") > MONEY)
    return out.withColumn("cause", likely_cause(F.col("qty"), "formula_ou_origem_a_investigar")).drop("qty")


def coupon_candidates(lines: DataFrame) -> DataFrame:
    """Lines without a coupon word: what the other lines of the order say."""
    said = lines.filter(~T.missing(F.col("coupon"))).groupBy("order_id", "coupon").agg(F.count("*").alias("n"))
    word = T.normal_text(F.col("coupon"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("coupon").alias("v"))))
    text = F.array_join(F.transform(listed, lambda x: F.concat_ws(": ", x["v"], (-x["m"]).cast("string"))), " | ")
    known = said.groupBy("order_id").agg(F.min_by("coupon", F.struct(-F.col("n"), F.col("coupon"))).alias("candidate"), F.max("n").alias("support"), F.countDistinct(word).alias("words"), text.alias("coupons"))
    size = lines.groupBy("order_id").agg(F.count("*").alias("lines_in_order"))
    kind = F.when(F.col("words") == 1, "recuperavel_por_mesmo_pedido").when(F.col("words") > 1, "conflito_dentro_do_pedido").otherwise("sem_evidencia_no_mesmo_pedido")
    out = lines.filter(T.missing(F.col("coupon"))).select("row_id", "order_id", "client_id", "item_id", "discount", "value").join(size, "order_id").join(known, "order_id", "left")
    return out.withColumn("support", F.coalesce("support", F.lit(0))).withColumn("classification", kind).drop("words")
