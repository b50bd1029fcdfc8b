"""Row rules of raw lines, in groups, and contextual investigations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import rules as R
from tidemark.sources.lines import LINES_SQL, lines

from .registry import Registry

query = Registry(LINES_SQL)
QUERIES, ORACLE = query.queries, query.oracle

#: Parameters of the queries: purchases after AS_OF lie in the future; YEAR is the period.
AS_OF, YEAR = "1998-01-01", 1995
CONTEXT = ("row_id", "order_id", "client_id", "item_id", "qty", "price", "discount", "value")

# The oracle's own reading of the rules, group by group: (rule, level, severity, broken where).
Q1A = (
    ("idade_fora_16_100", "cliente", "alta", "age NOT BETWEEN 16 AND 100"),
    ("experiencia_negativa", "cliente", "alta", "experience < 0"),
    ("experiencia_incompativel_idade", "cliente", "alta", "experience + 14 > age"),
    ("renda_negativa", "cliente", "alta", "income < 0"),
    ("renda_zero_requer_contexto", "cliente", "baixa", "income = 0"),
    ("intervalo_negativo", "cliente", "alta", "purchase_interval < 0"),
    ("ticket_nao_positivo", "cliente", "alta", "ticket <= 0"),
    ("quantidade_nao_positiva", "item_pedido", "alta", "qty <= 0"),
    ("custo_nao_positivo", "item", "alta", "cost <= 0"),
    ("preco_nao_positivo", "item", "alta", "price <= 0"),
    ("custo_superior_preco", "item_pedido", "media", "price < cost"),
    ("valor_compra_negativo", "item_pedido", "alta", "value < 0"),
    ("frete_negativo", "pedido", "alta", "freight < 0"),
    ("prazo_prometido_negativo", "pedido", "alta", "promised < 0"),
    ("prazo_real_negativo", "pedido", "alta", "actual < 0"),
    ("avaliacao_fora_1_5", "pedido", "alta", "rating NOT IN (1, 2, 3, 4, 5)"),
    ("pontos_negativos", "cliente", "alta", "points < 0"),
)
_SHARE = "(discount / (SELECT CASE WHEN max(discount) <= 1 THEN 1 ELSE 100 END FROM line))"
Q1B = (("desconto_fora_escala", "item_pedido", "alta", f"{_SHARE} < 0 OR {_SHARE} > 1"),)
Q1C = (
    ("frete_gratis_incoerente_com_frete", "pedido", "media", "(lower(trim(free_shipping)) = 'sim' AND abs(freight) > 0.001) OR (lower(trim(free_shipping)) = 'não' AND abs(freight) <= 0.001)"),
    ("cupom_incoerente_com_desconto", "item_pedido", "media", "(lower(coupon) IN ('não', 'nao') AND discount > 0) OR (lower(coupon) = 'sim' AND discount = 0)"),
)
Q1D = (
    ("mes_ref_difere_data_compra", "pedido", "alta", "month_ref <> CAST(strftime(bought_on, '%Y%m') AS INT)"),
    ("data_compra_futura", "pedido", "alta", f"bought_on > DATE '{AS_OF}'"),
    (f"data_compra_fora_periodo_{YEAR}", "pedido", "media", f"bought_on < DATE '{YEAR}-01-01' OR bought_on > DATE '{YEAR}-12-31'"),
)
Q1E = (("atraso_entrega_coerente_com_prazos", "pedido", "alta", "(late_flag IN ('Sim', 'SIM') AND actual <= promised + 1) OR (late_flag = 'não' AND actual > promised + 1)"),)
_BY_GROSS = "abs(value - qty * price) <= 0.01 + 0.00001 * abs(qty * price)"
_BY_DISCOUNT = "abs(value - qty * price * (1 - discount / 100)) <= 0.01 + 0.00001 * abs(qty * price * (1 - discount / 100))"
Q1F = (
    ("valor_compra_igual_quantidade_preco", "item_pedido", "diagnostico_formula", f"NOT ({_BY_GROSS})"),
    ("valor_compra_com_desconto", "item_pedido", "diagnostico_formula", f"NOT ({_BY_DISCOUNT})"),
    ("valor_compra_nao_reproduz_formulas_testadas", "item_pedido", "media", f"NOT ({_BY_GROSS}) AND NOT ({_BY_DISCOUNT})"),
)


def _summary(rules) -> str:
    part = """SELECT '{0}' AS rule_id, '{1}' AS level, '{2}' AS severity, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER ({3}) AS BIGINT) AS violations,
      round(100.0e0 * count(*) FILTER ({3}) / count(*), 4) AS percent,
      CASE WHEN '{2}' = 'diagnostico_formula' THEN 'hipotese_formula' WHEN count(*) FILTER ({3}) = 0 THEN 'conforme' ELSE 'investigar' END AS status FROM line"""
    return " UNION ALL ".join(part.format(*r) for r in rules)


def _group(name: str, sql_rules) -> None:
    """A query for one group of rules; all go through one pass over the lines."""
    ids = {r[0] for r in sql_rules}

    @query(name, _summary(sql_rules))
    def summary(spark, sf_dir) -> DataFrame:
        return R.report(R.prepared(lines(spark, sf_dir)), [r for r in R.line_rules(AS_OF, YEAR) if r.rule_id in ids])


for _name, _rules in (("q1a_domain_rules", Q1A), ("q1b_discount_scale", Q1B), ("q1c_coupon_and_freight", Q1C), ("q1d_dates", Q1D), ("q1e_delay_flag", Q1E), ("q1f_value_formulas", Q1F)):
    _group(_name, _rules)
_group("q1_all_rules", Q1A + Q1B + Q1C + Q1D + Q1E + Q1F)

_DETAIL = [r for r in Q1A + Q1B + Q1C + Q1D + Q1E + Q1F if r[2] != "diagnostico_formula"]


@query("q1_all_breaches", " UNION ALL ".join(f"SELECT {', '.join(CONTEXT)}, '{i}' AS rule_id, '{s}' AS severity FROM line WHERE {c}" for i, _, s, c in _DETAIL))
def all_breaches(spark, sf_dir) -> DataFrame:
    """Every line and rule that it breaks, with context."""
    return R.breaches(R.prepared(lines(spark, sf_dir)), R.line_rules(AS_OF, YEAR), CONTEXT)


@query("v1_age", """WITH n AS (SELECT client_id, age, count(*) AS n FROM line GROUP BY ALL),
  h AS (SELECT client_id, arg_min(age, (-n, age)) FILTER (age BETWEEN 16 AND 100) AS candidate, max(n) FILTER (age BETWEEN 16 AND 100) AS support, count(*) FILTER (age BETWEEN 16 AND 100) AS valid,
    string_agg(concat(age, ': ', n), ' | ' ORDER BY n DESC, age) AS history FROM n GROUP BY client_id)
  SELECT row_id, order_id, line.client_id, age AS invalid_age, candidate, CAST(coalesce(support, 0) AS BIGINT) AS support, CAST(valid AS BIGINT) AS valid_values, history,
    CASE valid WHEN 0 THEN 'sem_evidencia' WHEN 1 THEN 'recuperavel_deterministico' ELSE 'candidato_com_conflito' END AS classification,
    CASE valid WHEN 1 THEN 'preencher_com_historico' ELSE 'revisao_manual' END AS decision
  FROM line JOIN h ON line.client_id = h.client_id WHERE age < 16 OR age > 100""")
def age(spark, sf_dir) -> DataFrame:
    return R.age_candidates(lines(spark, sf_dir))


@query("v3_quantity", """WITH e AS (SELECT *, value / nullif(price * (1 - discount / 100), 0) AS estimate FROM line WHERE qty <= 0 OR qty > 6),
  w AS (SELECT *, round_even(estimate, 0) AS whole FROM e), f AS (SELECT *, coalesce(whole > 0 AND abs(estimate - whole) <= 0.01, false) AS fits FROM w)
  SELECT row_id, order_id, client_id, item_id, qty, estimate, CASE WHEN fits THEN whole END AS candidate, fits AS reproduces_value,
    CASE WHEN qty <= 0 THEN 'quantidade_invalida' WHEN qty >= 100 THEN 'quantidade_extrema_provavel_erro' ELSE 'quantidade_alta_plausivel' END AS classification,
    CASE WHEN fits AND (qty <= 0 OR qty >= 100) THEN 'usar_quantidade_estimada' ELSE 'preservar_e_revisar' END AS decision FROM f""")
def quantity(spark, sf_dir) -> DataFrame:
    return R.quantity_candidates(lines(spark, sf_dir))


@query("v4_value", """SELECT row_id, order_id, client_id, item_id, value, qty * price * (1 - discount / 100) AS recalculated, value - qty * price * (1 - discount / 100) AS difference,
    CASE WHEN qty <= 0 THEN 'quantidade_invalida' WHEN qty >= 100 THEN 'quantidade_extrema' ELSE 'formula_ou_origem_a_investigar' END AS cause
  FROM line WHERE abs(value - qty * price * (1 - discount / 100)) > 0.01""")
def value(spark, sf_dir) -> DataFrame:
    return R.value_differences(lines(spark, sf_dir))


@query("r3_coupon_of_order", """WITH s AS (SELECT order_id, coupon, count(*) AS n FROM line WHERE coupon IS NOT NULL GROUP BY ALL),
  k AS (SELECT order_id, arg_min(coupon, (-n, coupon)) AS candidate, max(n) AS support, count(DISTINCT replace(lower(coupon), 'ã', 'a')) AS words, string_agg(concat(coupon, ': ', n), ' | ' ORDER BY n DESC, coupon) AS coupons FROM s GROUP BY order_id),
  z AS (SELECT order_id, count(*) AS lines_in_order FROM line GROUP BY order_id)
  SELECT row_id, line.order_id, client_id, item_id, discount, value, CAST(lines_in_order AS BIGINT) AS lines_in_order, candidate, CAST(coalesce(support, 0) AS BIGINT) AS support, coupons,
    CASE WHEN words = 1 THEN 'recuperavel_por_mesmo_pedido' WHEN words > 1 THEN 'conflito_dentro_do_pedido' ELSE 'sem_evidencia_no_mesmo_pedido' END AS classification
  FROM line JOIN z ON line.order_id = z.order_id LEFT JOIN k ON line.order_id = k.order_id WHERE coupon IS NULL""")
def coupon_of_order(spark, sf_dir) -> DataFrame:
    return R.coupon_candidates(lines(spark, sf_dir))


# What each variable must keep to, in words.
DOMAINS = {
    "age": ("idade fora do domínio permitido de 16 a 100 anos", lambda c: (c < 16) | (c > 100)), "experience": ("tempo de experiência negativo", lambda c: c < 0),
    "income": ("renda negativa; renda zero exige contexto profissional", lambda c: c < 0), "purchase_interval": ("intervalo negativo", lambda c: c < 0),
    "ticket": ("ticket não positivo", lambda c: c <= 0), "qty": ("quantidade não positiva", lambda c: c <= 0), "cost": ("valor unitário não positivo", lambda c: c <= 0),
    "price": ("valor unitário não positivo", lambda c: c <= 0), "value": ("valor de compra negativo", lambda c: c < 0), "freight": ("frete negativo", lambda c: c < 0),
    "promised": ("prazo negativo", lambda c: c < 0), "actual": ("prazo negativo", lambda c: c < 0), "points": ("pontos negativos", lambda c: c < 0),
}
_LEAST = {c: 1 if c in ("ticket", "qty", "cost", "price") else 0 for c in DOMAINS if c != "age"}


@query("p11b_domain_violations", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, '{w}' AS criterion, CAST(count({c}) AS BIGINT) AS informed, CAST(coalesce(sum(CASE WHEN {'age < 16 OR age > 100' if c == 'age' else f'{c} <= 0' if _LEAST[c] else f'{c} < 0'} THEN 1 END), 0) AS BIGINT) AS violations FROM line"
    for c, (w, _) in DOMAINS.items()))
def domain_violations(spark, sf_dir) -> DataFrame:
    """Per variable: values and those outside its domain, with the criterion; one pass."""
    one = lines(spark, sf_dir).agg(*[F.struct(F.count(c).alias("informed"), F.count_if(broken(F.col(c))).alias("violations")).alias(c) for c, (_, broken) in DOMAINS.items()])
    told = [F.struct(F.lit(c).alias("variable"), F.lit(words).alias("criterion"), F.col(c).alias("n")) for c, (words, _) in DOMAINS.items()]
    return one.select(F.explode(F.array(*told)).alias("d")).select("d.variable", "d.criterion", "d.n.*")
