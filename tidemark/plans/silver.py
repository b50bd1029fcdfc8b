"""From raw to treated rows: typing, text standards, plans, decisions and removals, and what is checked afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import items, silver, treat
from tidemark.operators import rules as R
from tidemark.sources.bronze import BRONZE_SQL, bronze
from tidemark.sources.lines import LINES_SQL, lines
from tidemark.sources.tables import stored

from .quality import COLUMNS, LISTED
from .registry import Registry

query = Registry(BRONZE_SQL)
QUERIES, ORACLE = query.queries, query.oracle

PLAN = {"amount": "number", "age": "integer", "bought_on": "date", "bought_at": "time", "order_id": "integer"}
_READ = {
    "amount": "TRY_CAST(replace(replace(amount, 'R$ ', ''), ',', '.') AS DOUBLE)", "age": "TRY_CAST(age AS BIGINT)", "order_id": "TRY_CAST(order_id AS BIGINT)",
    "bought_on": "coalesce(TRY_CAST(bought_on AS DATE), CAST(try_strptime(bought_on, '%d/%m/%Y') AS DATE))",
    "bought_at": "CASE WHEN TRY_CAST(split_part(bought_at, ':', 1) AS INT) < 24 THEN CAST(CAST(split_part(bought_at, ':', 1) AS INT) * 60 + CAST(split_part(bought_at, ':', 2) AS INT) AS INT) END",
}
_HAVE = "({0} IS NOT NULL AND trim({0}) <> '')"
_COUNT = "CAST(count(*) FILTER ({0}) AS BIGINT)"


@query("t12_typing_report", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{k}' AS kind, {_COUNT.format(_HAVE.format(c))} AS informed, {_COUNT.format(_HAVE.format(c) + f' AND {_READ[c]} IS NOT NULL')} AS converted,
    {_COUNT.format(_HAVE.format(c) + f' AND {_READ[c]} IS NULL')} AS failures, CAST(0 AS BIGINT) AS fractional,
    CASE WHEN count(*) FILTER ({_HAVE.format(c)} AND {_READ[c]} IS NULL) > 0 THEN 'BLOQUEAR' ELSE 'CONVERTER' END AS action FROM bronze"""
    for c, k in PLAN.items()))
def typing_report(spark, sf_dir) -> DataFrame:
    return silver.typing_report(bronze(spark, sf_dir), PLAN)


_FINE = " AND ".join(f"(NOT {_HAVE.format(c)} OR {_READ[c]} IS NOT NULL)" for c in PLAN)


@query("t12_typed_rows", f"SELECT row_id, client_id, {', '.join(f'{_READ[c]} AS {c}' for c in PLAN)} FROM bronze WHERE {_FINE}")
def typed_rows(spark, sf_dir) -> DataFrame:
    """The rows that convert as a whole, typed."""
    return silver.typed_rows(bronze(spark, sf_dir), PLAN, ("row_id", "client_id"))


_YES = "CASE lower(trim({0})) WHEN 'sim' THEN 'Sim' WHEN 'não' THEN 'Não' WHEN 'nao' THEN 'Não' ELSE trim({0}) END"
_STATE = "CASE state WHEN 'São Paulo' THEN 'SP' WHEN 'Rio de  Janeiro' THEN 'RJ' WHEN 'Bahia' THEN 'BA' ELSE upper(state) END"


def _standard() -> dict:
    return {"free_shipping": silver.yes_or_no(F.col("free_shipping")), "late_flag": silver.yes_or_no(F.col("late_flag")), "coupon": silver.yes_or_no(F.col("coupon")), "state": silver.unit(F.col("state"))}


_NEW = {"free_shipping": _YES.format("free_shipping"), "late_flag": _YES.format("late_flag"), "coupon": _YES.format("coupon"), "state": _STATE}


@query("t14_standard_texts", f"""SELECT row_id, {', '.join(f'{e} AS {c}' for c, e in _NEW.items())},
  CASE WHEN {_STATE} IN ('SP', 'RJ', 'MG', 'ES') THEN 'Sudeste' WHEN {_STATE} = 'BA' THEN 'Nordeste' END AS region FROM line""", LINES_SQL)
def standard_texts(spark, sf_dir) -> DataFrame:
    """Yes-or-no words and states in one spelling, and the region of the state."""
    new = _standard()
    return lines(spark, sf_dir).select("row_id", *[v.alias(c) for c, v in new.items()], silver.region(new["state"]).alias("region"))


@query("t14_text_changes", "SELECT field, before, after, rule_id, action, CAST(count(*) AS BIGINT) AS changes FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS field, {c} AS before, {e} AS after, 'TR016' AS rule_id, 'padronizar_sem_alterar_significado' AS action FROM line WHERE {c} IS DISTINCT FROM {e}" for c, e in _NEW.items()) + ") x GROUP BY ALL", LINES_SQL)
def text_changes(spark, sf_dir) -> DataFrame:
    audit = silver.changes(lines(spark, sf_dir), "row_id", _standard(), "TR016", "padronizar_sem_alterar_significado")
    return audit.groupBy("field", "before", "after", "rule_id", "action").agg(F.count("*").alias("changes"))


_SURPLUS = f"surplus AS (SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY {LISTED} ORDER BY row_id) AS place FROM bronze) x WHERE place > 1)"


@query("t10_without_duplicates", f"WITH {_SURPLUS} SELECT * FROM bronze WHERE row_id NOT IN (SELECT row_id FROM surplus)")
def without_duplicates(spark, sf_dir) -> DataFrame:
    return _dedup(spark, sf_dir)[0]


@query("t10_removal_audit", f"WITH {_SURPLUS} SELECT row_id, 'linha_completa' AS field, 'presente' AS before, 'removida' AS after, 'TR017' AS rule_id, 'remover_excedente_duplicado' AS action FROM surplus")
def removal_audit(spark, sf_dir) -> DataFrame:
    return _dedup(spark, sf_dir)[1]


def _dedup(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    b = stored(bronze(spark, sf_dir))  # several figures come of rows and plan: each is made once
    return silver.without_planned(b, "row_id", stored(treat.dedup_plan(b, COLUMNS, "row_id")), "TR017")


@query("t21_surplus_rows", f"WITH {_SURPLUS} SELECT row_id FROM surplus")
def surplus_rows(spark, sf_dir) -> DataFrame:
    return treat.dedup_plan(bronze(spark, sf_dir), COLUMNS, "row_id").filter("action = 'REMOVER'").select("row_id")


_ITEM_RULES = {"product": ("TR018", "TR018"), "category": ("TR020", "TR019"), "unit": ("TR021", "TR021")}
_MODE = "(SELECT item_id, arg_min(v, (-n, v)) AS v FROM (SELECT item_id, {0} AS v, count(*) AS n FROM line WHERE {0} IS NOT NULL GROUP BY ALL) x GROUP BY item_id)"
_CANON = f"""canon AS (SELECT i.item_id, p.v AS canonical_product, c.v AS canonical_category, u.v AS canonical_unit FROM (SELECT DISTINCT item_id FROM line) i
  LEFT JOIN {_MODE.format('product')} p ON p.item_id = i.item_id LEFT JOIN {_MODE.format('category')} c ON c.item_id = i.item_id LEFT JOIN {_MODE.format('unit')} u ON u.item_id = i.item_id)"""


@query("t6_item_corrections", f"WITH {_CANON}, " + "b AS (SELECT line.*, canonical_product, canonical_category, canonical_unit FROM line JOIN canon ON canon.item_id = line.item_id) " + " UNION ALL ".join(
    f"SELECT row_id, '{a}' AS field, {a} AS original, canonical_{a} AS proposed, CASE WHEN {a} IS NULL THEN '{gone}' ELSE '{d}' END AS rule_id FROM b WHERE canonical_{a} IS NOT NULL AND lower({a}) IS DISTINCT FROM lower(canonical_{a})"
    for a, (d, gone) in _ITEM_RULES.items()), LINES_SQL)
def item_corrections(spark, sf_dir) -> DataFrame:
    """Product, category and unit after the canonical item map."""
    return items.corrections(lines(spark, sf_dir), "row_id", "item_id", _ITEM_RULES)


# Raw-row corrections, open points and decisions: ages recovered by client; a decision for every seventh client.
_AGE = "one AS (SELECT client_id, min(age) AS a FROM bronze GROUP BY client_id HAVING count(DISTINCT age) = 1)"
_CORR = f"{_AGE}, corr AS (SELECT row_id, 'age' AS field, a AS proposed, 'TR001' AS rule_id FROM bronze JOIN one ON one.client_id = bronze.client_id WHERE age IS NULL)"
_PEND = "pend AS (SELECT row_id, 'coupon' AS field, 'TR005' AS rule_id FROM bronze WHERE coupon IS NULL UNION ALL SELECT row_id, 'payment', 'TR006' FROM bronze WHERE payment IS NULL OR trim(payment) = '')"
_DECI = """deci AS (SELECT row_id, 'coupon' AS field, 'substituir' AS kind, 'O' AS value FROM bronze WHERE coupon IS NULL AND CAST(order_id AS BIGINT) % 7 = 0
  UNION ALL SELECT row_id, 'payment', 'encerrar', NULL FROM bronze WHERE payment IS NULL AND CAST(order_id AS BIGINT) % 5 = 0
  UNION ALL SELECT row_id, 'age', 'excluir', NULL FROM bronze WHERE age IS NULL AND CAST(order_id AS BIGINT) % 3 = 0)"""


def corrections(spark, sf_dir) -> DataFrame:
    found = treat.recover(bronze(spark, sf_dir), "row_id", "age", "client_id").filter("recovery = 'DETERMINISTICO'")
    return found.select("row_id", F.lit("age").alias("field"), F.col("candidate").alias("proposed"), F.lit("TR001").alias("rule_id"))


def open_points(b: DataFrame) -> DataFrame:
    gone = [F.when(F.col("coupon").isNull(), F.struct(F.lit("coupon").alias("field"), F.lit("TR005").alias("rule_id"))), F.when(T.missing(F.col("payment")), F.struct(F.lit("payment").alias("field"), F.lit("TR006").alias("rule_id")))]
    return b.select("row_id", F.explode(F.array_compact(F.array(*gone))).alias("p")).select("row_id", "p.*")


def decisions(b: DataFrame) -> DataFrame:
    of = lambda k: F.col("order_id").cast("long") % k == 0
    made = lambda field, kind, value: F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), F.lit(value).cast("string").alias("value"))
    told = [F.when(F.col("coupon").isNull() & of(7), made("coupon", "substituir", "O")), F.when(F.col("payment").isNull() & of(5), made("payment", "encerrar", None)), F.when(F.col("age").isNull() & of(3), made("age", "excluir", None))]
    return b.select("row_id", F.explode(F.array_compact(F.array(*told))).alias("d")).select("row_id", "d.*")


def _laid(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    b = bronze(spark, sf_dir)
    return silver.decided(corrections(spark, sf_dir), open_points(b), decisions(b))


@query("t7_open_points", f"WITH {_PEND} SELECT * FROM pend")
def pending(spark, sf_dir) -> DataFrame:
    """Cells that stay null until a rule of the business decides them, with the rule they wait for."""
    return open_points(bronze(spark, sf_dir))


@query("t8_corrections_after_decisions", f"""WITH {_CORR}, {_DECI}, gone AS (SELECT row_id FROM deci WHERE kind = 'excluir'), s AS (SELECT * FROM deci WHERE kind = 'substituir')
  SELECT coalesce(c.row_id, s.row_id) AS row_id, coalesce(c.field, s.field) AS field, coalesce(s.value, c.proposed) AS proposed, CASE WHEN s.value IS NOT NULL THEN 'DECISAO' ELSE c.rule_id END AS rule_id
  FROM corr c FULL JOIN s ON c.row_id = s.row_id AND c.field = s.field WHERE coalesce(c.row_id, s.row_id) NOT IN (SELECT row_id FROM gone)""")
def decided_corrections(spark, sf_dir) -> DataFrame:
    return _laid(spark, sf_dir)[0]


@query("t8_open_after_decisions", f"""WITH {_PEND}, {_DECI} SELECT * FROM pend WHERE row_id NOT IN (SELECT row_id FROM deci WHERE kind = 'excluir')
  AND NOT EXISTS (SELECT 1 FROM deci d WHERE d.row_id = pend.row_id AND d.field = pend.field AND kind <> 'excluir')""")
def decided_pending(spark, sf_dir) -> DataFrame:
    return _laid(spark, sf_dir)[1]


@query("t9_plan_controls", f"""WITH {_CORR}, {_DECI}, a AS (SELECT row_id, field, proposed, rule_id FROM corr UNION ALL SELECT row_id, field, value, 'DECISAO' FROM deci WHERE kind = 'substituir'),
  o AS (SELECT CAST(count(*) - count(DISTINCT (row_id, field)) AS DOUBLE) AS d, CAST(count(*) FILTER (proposed IS NULL AND rule_id <> 'TR003') AS DOUBLE) AS n, CAST(count(*) FILTER (rule_id NOT IN ('TR001', 'TR003')) AS DOUBLE) AS u FROM a)
  SELECT c AS control, v AS observed, CAST(0 AS DOUBLE) AS expected, true AS critical, CASE WHEN v = 0 THEN 'aprovado' ELSE 'reprovado' END AS status
  FROM (SELECT 'correcoes_duplicadas' AS c, d AS v FROM o UNION ALL SELECT 'propostas_nulas', n FROM o UNION ALL SELECT 'regras_fora_do_plano', u FROM o) x""")
def plan_controls(spark, sf_dir) -> DataFrame:
    """Controls of the plan before it is applied; corrections that decisions add lie outside the plan's rules."""
    b = bronze(spark, sf_dir)
    added = decisions(b).filter("kind = 'substituir'").select("row_id", "field", F.col("value").alias("proposed"), F.lit("DECISAO").alias("rule_id"))
    cells = corrections(spark, sf_dir).unionByName(added)
    null, outside = F.col("proposed").isNull() & (F.col("rule_id") != "TR003"), ~F.col("rule_id").isin("TR001", "TR003")
    per_cell = cells.groupBy("row_id", "field").agg(F.count("*").alias("n"), F.count_if(null).alias("null"), F.count_if(outside).alias("outside"))
    facts = per_cell.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("correcoes_duplicadas"), F.coalesce(F.sum("null"), F.lit(0)).alias("propostas_nulas"), F.coalesce(F.sum("outside"), F.lit(0)).alias("regras_fora_do_plano"))
    return silver.controls(facts, {c: F.lit(0) for c in facts.columns})


# Treatments (rule, field, level, situation, action, confidence) and where each applies.
MATRIX = (
    ("TR001", "age", "cliente", "ausente com um valor no histórico", "corrigir_deterministicamente", "alta", "age IS NULL"),
    ("TR003", "coupon", "pedido", "situação sem cupom", "corrigir_deterministicamente", "media", "coupon = 'P'"),
    ("TR005", "coupon", "pedido", "ausente", "manter_pendente_regra_negocio", "baixa", "coupon IS NULL"),
    ("TR006", "payment", "pedido", "ausente ou em branco", "manter_pendente_regra_negocio", "baixa", "payment IS NULL OR trim(payment) = ''"),
    ("TR010", "amount", "item_pedido", "valor que não se lê", "recalcular_validacao_apos_correcao", "media", "amount = 'abc'"),
    ("TR012", "bought_on", "pedido", "data que não existe", "recalcular_validacao_apos_correcao", "media", "bought_on = '31/02/2025'"),
    ("TR013", "bought_at", "pedido", "horário fora do dia", "preservar_valor_origem", "media", "bought_at = '24:00'"),
    ("TR016", "payment", "pedido", "caixa e espaços", "padronizar_sem_alterar_significado", "alta", "trim(payment) <> '' AND upper(trim(payment)) <> payment"),
)


@query("t3_treatment_matrix", " UNION ALL ".join(
    f"SELECT '{r}' AS rule_id, '{f}' AS field, '{lv}' AS level, '{s}' AS situation, '{a}' AS action, '{cf}' AS confidence, CAST(count(*) AS BIGINT) AS cases FROM bronze WHERE {w}" for r, f, lv, s, a, cf, w in MATRIX))
def treatment_matrix(spark, sf_dir) -> DataFrame:
    """Every treatment with the number of its cases, counted in one pass."""
    one = bronze(spark, sf_dir).agg(*[F.count_if(F.expr(m[-1])).alias(m[0]) for m in MATRIX])
    names = ("rule_id", "field", "level", "situation", "action", "confidence")
    told = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, m[:-1], strict=True)], F.col(m[0]).alias("cases")) for m in MATRIX]
    return one.select(F.explode(F.array(*told)).alias("m")).select("m.*")


_CONTROL = "SELECT c AS control, CAST(o AS DOUBLE) AS observed, CAST(e AS DOUBLE) AS expected, true AS critical, CASE WHEN o = e THEN 'aprovado' ELSE 'reprovado' END AS status FROM ({0}) x"


@query("t17_reconciliation", f"WITH {_SURPLUS}, slim AS (SELECT * FROM bronze WHERE row_id NOT IN (SELECT row_id FROM surplus)) " + _CONTROL.format("""
  SELECT 'linhas_silver' AS c, (SELECT count(*) FROM slim) AS o, (SELECT count(*) FROM bronze) - (SELECT count(*) FROM surplus) AS e
  UNION ALL SELECT 'pedidos_preservados', (SELECT count(DISTINCT order_id) FROM slim), (SELECT count(DISTINCT order_id) FROM bronze)
  UNION ALL SELECT 'clientes_preservados', (SELECT count(DISTINCT client_id) FROM slim), (SELECT count(DISTINCT client_id) FROM bronze)
  UNION ALL SELECT 'linha_de_origem_repetida', (SELECT count(*) - count(DISTINCT row_id) FROM slim), 0
  UNION ALL SELECT 'cupom_nulo', (SELECT count(*) FROM slim WHERE coupon IS NULL), 0"""))
def reconciliation(spark, sf_dir) -> DataFrame:
    """Raw against treated rows: counts, keys kept, lineage, and coupons still null."""
    b = bronze(spark, sf_dir)
    slim, audit = _dedup(spark, sf_dir)
    keys = lambda d, p: d.agg(F.count("*").alias(f"{p}rows"), F.countDistinct("order_id").alias(f"{p}orders"), F.countDistinct("client_id").alias(f"{p}clients"))
    per_row = slim.groupBy("row_id").agg(F.count("*").alias("n"), F.count_if(F.col("coupon").isNull()).alias("g")).agg(F.sum(F.col("n") - 1).alias("linha_de_origem_repetida"), F.sum("g").alias("cupom_nulo"))
    facts = keys(b, "b_").crossJoin(keys(slim, "s_")).crossJoin(audit.agg(F.count("*").alias("gone"))).crossJoin(per_row)  # one row each
    facts = facts.withColumns({"linhas_silver": F.col("s_rows"), "pedidos_preservados": F.col("s_orders"), "clientes_preservados": F.col("s_clients")})
    c = F.col
    return silver.controls(facts, {"linhas_silver": c("b_rows") - c("gone"), "pedidos_preservados": c("b_orders"), "clientes_preservados": c("b_clients"), "linha_de_origem_repetida": F.lit(0), "cupom_nulo": F.lit(0)})


@query("t20_plan_acceptance", f"WITH {_SURPLUS}, {_CORR} " + _CONTROL.format("""
  SELECT 'remocoes_do_plano' AS c, (SELECT count(*) FROM surplus) AS o, (SELECT count(*) FROM bronze WHERE row_id % 2 = 1) AS e
  UNION ALL SELECT 'correcoes_do_plano', (SELECT count(*) FROM corr), (SELECT count(DISTINCT (row_id, field)) FROM corr)
  UNION ALL SELECT 'tipagem_bloqueada', (SELECT count(*) FROM (SELECT 1 WHERE EXISTS (SELECT 1 FROM bronze WHERE amount = 'abc'))), 0"""))
def plan_acceptance(spark, sf_dir) -> DataFrame:
    """Whether the plan may be applied: removals as the source repeats rows, corrections told once, amounts that type."""
    b = bronze(spark, sf_dir)
    plan = surplus_rows(spark, sf_dir).agg(F.count("*").alias("remocoes_do_plano"))
    cells = corrections(spark, sf_dir).groupBy("row_id", "field").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("correcoes_do_plano"), F.count("*").alias("cells"))
    source = b.agg(F.count_if(F.col("row_id") % 2 == 1).alias("repeats"))
    blocked = silver.typing_report(b, {"amount": "number"}).agg(F.count_if(F.col("action") == "BLOQUEAR").alias("tipagem_bloqueada"))
    facts = plan.crossJoin(cells).crossJoin(source).crossJoin(blocked)  # one row each
    return silver.controls(facts, {"remocoes_do_plano": F.col("repeats"), "correcoes_do_plano": F.col("cells"), "tipagem_bloqueada": F.lit(0)})


# Treated lines: texts in one spelling, and which cells are on record as open: a category that is missing where the item
# has several, and a value that departs from its formula while one of the factors is impossible.
_OPEN_VALUE = f"abs(value - qty * price * (1 - discount / 100)) > {R.MONEY} AND (qty <= 0 OR price <= 0 OR discount < 0 OR discount > 100 OR value < 0)"
_SILVER = f"""silver AS (SELECT l.* EXCLUDE (free_shipping, late_flag, coupon, state), {', '.join(f'{e} AS {c}' for c, e in _NEW.items())},
  nullif(concat_ws(' | ', CASE WHEN category IS NULL AND n_category > 1 THEN 'category:TR019' END, CASE WHEN {_OPEN_VALUE} THEN 'value:TR010' END), '') AS open_points
  FROM line l JOIN (SELECT item_id AS of_item, count(DISTINCT lower(category)) AS n_category FROM line GROUP BY item_id) n ON n.of_item = l.item_id)"""


def treated(spark, sf_dir) -> DataFrame:
    rows = lines(spark, sf_dir)
    of_item = rows.groupBy("item_id").agg(F.countDistinct(F.lower("category")).alias("n_category"))
    out = rows.withColumns(_standard()).join(of_item, "item_id")
    told = F.array_compact(F.array(F.when(F.col("category").isNull() & (F.col("n_category") > 1), "category:TR019"), F.when(F.expr(_OPEN_VALUE), "value:TR010")))
    return out.withColumn("open_points", F.nullif(F.array_join(told, " | "), F.lit(""))).drop("n_category")


@query("s1_structure", f"WITH {_SILVER} " + _CONTROL.format("""
  SELECT 'linhas_silver' AS c, (SELECT count(*) FROM silver) AS o, (SELECT count(*) FROM lineitem) AS e
  UNION ALL SELECT 'linha_de_origem_repetida', (SELECT count(*) - count(DISTINCT row_id) FROM silver), 0
  UNION ALL SELECT 'itens_no_mapa', (SELECT count(DISTINCT item_id) FROM silver WHERE product IS NOT NULL), (SELECT count(DISTINCT item_id) FROM silver)
  UNION ALL SELECT 'nulos_transportadora', (SELECT count(*) FROM silver WHERE carrier IS NULL), 0
  UNION ALL SELECT 'nulos_cupom', (SELECT count(*) FROM silver WHERE coupon IS NULL), 0"""), LINES_SQL)
def structure(spark, sf_dir) -> DataFrame:
    s = treated(spark, sf_dir)
    source = spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(F.count("*").alias("source_rows"))
    one = s.agg(F.count("*").alias("linhas_silver"), F.count_if(F.col("carrier").isNull()).alias("nulos_transportadora"), F.count_if(F.col("coupon").isNull()).alias("nulos_cupom"))
    rows = s.groupBy("row_id").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("linha_de_origem_repetida"))
    of_item = s.groupBy("item_id").agg(F.max(F.col("product").isNotNull()).alias("ok")).agg(F.count_if("ok").alias("itens_no_mapa"), F.count("*").alias("item_count"))
    facts = one.crossJoin(source).crossJoin(rows).crossJoin(of_item)  # one row each
    zero = F.lit(0)
    return silver.controls(facts, {"linhas_silver": F.col("source_rows"), "linha_de_origem_repetida": zero, "itens_no_mapa": F.col("item_count"), "nulos_transportadora": zero, "nulos_cupom": zero})


# What the domain rules of treated lines are called, the field they look at, and where they break.
DOMAIN_RULES = (
    ("idade_fora_16_100", "age", "age < 16 OR age > 100"), ("renda_negativa", "income", "income < 0"), ("renda_extrema_superior", "income", "income > 1000000"),
    ("quantidade_nao_positiva", "qty", "qty <= 0"), ("quantidade_extrema", "qty", "qty >= 100"), ("custo_nao_positivo", "cost", "cost <= 0"), ("preco_nao_positivo", "price", "price <= 0"),
    ("desconto_fora_0_100", "discount", "discount < 0 OR discount > 100"), ("avaliacao_fora_1_5", "rating", "rating < 1 OR rating > 5"), ("pontos_negativos", "points", "points < 0"),
    ("mes_ref_incoerente", "month_ref", "month_ref <> year(bought_on) * 100 + month(bought_on)"),
    ("dominio_invalido_free_shipping", "free_shipping", "free_shipping NOT IN ('Sim', 'Não')"), ("dominio_invalido_unit", "unit", "unit NOT IN ('un')"),
    ("dominio_invalido_occupation", "occupation", "occupation NOT IN ('Empregado', 'Estudante')"),
)
_S2 = " UNION ALL ".join([f"SELECT row_id, order_id, '{r}' AS rule_id, '{f}' AS field, open_points IS NOT NULL AS on_record FROM silver WHERE {w}" for r, f, w in DOMAIN_RULES] + ["SELECT row_id, order_id, 'estado_fora_uf' AS rule_id, 'state' AS field, open_points IS NOT NULL AS on_record FROM silver WHERE state = 'ZZ'"])


@query("s2_domain_violations", f"WITH {_SILVER} {_S2}", LINES_SQL)
def domain_violations(spark, sf_dir) -> DataFrame:
    rules = [(r, f, F.expr(w)) for r, f, w in DOMAIN_RULES] + [("estado_fora_uf", "state", ~F.col("state").isin(*silver.UNITS.values()))]
    hit = F.array_compact(F.array(*[F.when(T.holds(w), F.struct(F.lit(r).alias("rule_id"), F.lit(f).alias("field"))) for r, f, w in rules]))
    return treated(spark, sf_dir).select("row_id", "order_id", F.col("open_points").isNotNull().alias("on_record"), F.explode(hit).alias("h")).select("row_id", "order_id", "h.*", "on_record")


_S3 = """SELECT row_id, order_id, value, qty * price * (1 - discount / 100) AS recalculated, contains(coalesce(open_points, ''), 'value:TR010') AS on_record,
  CASE WHEN contains(coalesce(open_points, ''), 'value:TR010') THEN 'divergencia_conhecida_e_rastreada' ELSE 'divergencia_nao_rastreada' END AS classification
  FROM silver WHERE abs(value - qty * price * (1 - discount / 100)) > 0.01"""


@query("s3_value_formula", f"WITH {_SILVER} {_S3}", LINES_SQL)
def value_formula(spark, sf_dir) -> DataFrame:
    known = T.holds(F.contains("open_points", F.lit("value:TR010")))
    again = F.col("qty") * F.col("price") * (1 - F.col("discount") / 100)
    out = treated(spark, sf_dir).filter(F.abs(F.col("value") - again) > R.MONEY)
    return out.select("row_id", "order_id", "value", again.alias("recalculated"), known.alias("on_record"), F.when(known, "divergencia_conhecida_e_rastreada").otherwise("divergencia_nao_rastreada").alias("classification"))


_S5 = """SELECT * FROM (SELECT *, CASE WHEN legacy THEN 'produto_legado_a_corrigir' WHEN category_missing AND on_record THEN 'categoria_nula_conhecida_e_rastreada' WHEN category_differs THEN 'categoria_semantica_divergente'
    WHEN product_differs THEN 'produto_divergente_do_item' WHEN unit_differs THEN 'medida_divergente_do_item' ELSE 'revisar' END AS classification
  FROM (SELECT row_id, s.item_id, product, canonical_product, category, canonical_category, unit, canonical_unit, coalesce(product <> canonical_product, false) AS product_differs,
    coalesce(category IS NOT NULL AND category IS DISTINCT FROM canonical_category, false) AS category_differs, coalesce(unit <> canonical_unit, false) AS unit_differs, product = 'Legado descontinuado' AS legacy, category IS NULL AS category_missing,
    contains(coalesce(open_points, ''), 'category:TR019') AS on_record FROM silver s JOIN canon ON canon.item_id = s.item_id) y) z
  WHERE product_differs OR category_differs OR unit_differs OR legacy OR category_missing"""


@query("s5_item_mapping", f"WITH {_CANON}, {_SILVER} {_S5}", LINES_SQL)
def item_mapping(spark, sf_dir) -> DataFrame:
    known = T.holds(F.contains("open_points", F.lit("category:TR019")))
    return items.departures(treated(spark, sf_dir).withColumn("on_record", known), "row_id", "item_id", "legado descontinuado", "on_record")


_SUMMARY = f"""WITH {_CANON}, {_SILVER}, q AS (SELECT 'dominios' AS area, 'violacoes_objetivas' AS metric, count(*) AS n, 'corrigir' AS bad FROM ({_S2}) a UNION ALL SELECT 'calculos', 'divergencias_formula_valor', count(*), 'corrigir' FROM ({_S3}) b
  UNION ALL SELECT 'itens', 'inconsistencias_cadastrais', count(*), 'corrigir' FROM ({_S5}) c UNION ALL SELECT 'frete', 'incoerencias_frete_gratis', count(*), 'investigar' FROM silver WHERE coalesce(free_shipping = 'Sim', false) <> (abs(freight) <= 0.01))"""


@query("s7_quality_summary", _SUMMARY + " SELECT area, metric, CAST(n AS BIGINT) AS n, CASE WHEN n = 0 THEN 'conforme' ELSE bad END AS status FROM q", LINES_SQL)
def quality_summary(spark, sf_dir) -> DataFrame:
    freight = treated(spark, sf_dir).filter(T.holds(F.col("free_shipping") == "Sim") != (F.abs("freight") <= R.MONEY))
    parts = [("dominios", "violacoes_objetivas", domain_violations(spark, sf_dir), "corrigir"), ("calculos", "divergencias_formula_valor", value_formula(spark, sf_dir), "corrigir"), ("itens", "inconsistencias_cadastrais", item_mapping(spark, sf_dir), "corrigir"), ("frete", "incoerencias_frete_gratis", freight, "investigar")]
    counted = [d.agg(F.count("*").alias("n")).select(F.lit(a).alias("area"), F.lit(m).alias("metric"), "n", F.when(F.col("n") == 0, "conforme").otherwise(bad).alias("status")) for a, m, d, bad in parts]
    out = counted[0]
    for d in counted[1:]:
        out = out.unionByName(d)
    return out


@query("s7_verdict", _SUMMARY + """, s AS (SELECT count(*) - count(DISTINCT row_id) AS broken, count(open_points) AS open_rows FROM silver)
  SELECT CAST(broken AS BIGINT) AS broken_controls, CAST((SELECT sum(n) FROM q) AS BIGINT) AS findings, CAST(open_rows AS BIGINT) AS open_rows,
  CASE WHEN broken > 0 THEN 'reprovado_estruturalmente' WHEN (SELECT sum(n) FROM q) > 0 THEN 'aprovado_com_ressalvas_semanticas' WHEN open_rows > 0 THEN 'aprovado_com_pendencias_nao_imputaveis' ELSE 'aprovado' END AS verdict FROM s""", LINES_SQL)
def verdict(spark, sf_dir) -> DataFrame:
    """One row: broken lineage, findings, rows with open points, and what follows for the table as a whole."""
    s = treated(spark, sf_dir)
    rows = s.groupBy("row_id").agg(F.count("*").alias("n"), F.count("open_points").alias("o")).agg(F.sum(F.col("n") - 1).alias("broken_controls"), F.sum("o").alias("open_rows"))
    both = rows.crossJoin(quality_summary(spark, sf_dir).agg(F.sum("n").alias("findings")))  # one row each
    kind = F.when(F.col("broken_controls") > 0, "reprovado_estruturalmente").when(F.col("findings") > 0, "aprovado_com_ressalvas_semanticas").when(F.col("open_rows") > 0, "aprovado_com_pendencias_nao_imputaveis").otherwise("aprovado")
    return both.withColumn("verdict", kind)


_BUSINESS, _TECHNICAL = ("coupon", "carrier", "actual", "late_flag", "category", "rating"), ("row_id", "open_points")


@query("p25_null_profile", f"WITH {_SILVER} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{k}' AS class, CAST(count(*) - count({c}) AS BIGINT) AS nulls, round(100.0e0 * (count(*) - count({c})) / count(*), 4) AS percent, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_values,
    CASE WHEN '{k}' = 'negocio' THEN CASE WHEN count({c}) = count(*) THEN 'sem_nulos' ELSE 'pendencia_de_negocio_documentada' END WHEN '{c}' = 'row_id' THEN 'nulo_indicaria_quebra_de_linhagem' ELSE 'nulo_significa_nenhuma_pendencia_registrada' END AS meaning FROM silver"""
    for k, cs in (("negocio", _BUSINESS), ("tecnico", _TECHNICAL)) for c in cs), LINES_SQL)
def null_profile(spark, sf_dir) -> DataFrame:
    """Nulls and distinct values per column, by one grouping of (column, value)."""
    s = treated(spark, sf_dir).select(*[F.col(c).cast("string").alias(c) for c in _BUSINESS + _TECHNICAL])
    told = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in s.columns])
    n = s.select(F.explode(told).alias("x")).select("x.*").groupBy("column", "value").agg(F.count("*").alias("n"))
    one = n.groupBy("column").agg(F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.sum("n").alias("rows"), F.count("value").alias("distinct_values"))
    business = F.col("column").isin(*_BUSINESS)
    meaning = F.when(business & (F.col("nulls") == 0), "sem_nulos").when(business, "pendencia_de_negocio_documentada").when(F.col("column") == "row_id", "nulo_indicaria_quebra_de_linhagem").otherwise("nulo_significa_nenhuma_pendencia_registrada")
    return one.select("column", F.when(business, "negocio").otherwise("tecnico").alias("class"), "nulls", T.percent(F.col("nulls"), F.col("rows")).alias("percent"), "distinct_values", meaning.alias("meaning"))


@query("p26_rows_with_nulls", f"WITH {_SILVER} SELECT row_id, concat_ws(' | ', {', '.join(f'CASE WHEN {c} IS NULL THEN {chr(39)}{c}{chr(39)} END' for c in _BUSINESS)}) AS null_fields, CAST({' + '.join(f'({c} IS NULL)::INT' for c in _BUSINESS)} AS INT) AS nulls FROM silver WHERE {' OR '.join(f'{c} IS NULL' for c in _BUSINESS)}", LINES_SQL)
def rows_with_nulls(spark, sf_dir) -> DataFrame:
    gone = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in _BUSINESS]))
    return treated(spark, sf_dir).select("row_id", F.array_join(gone, " | ").alias("null_fields"), F.size(gone).alias("nulls")).filter("nulls > 0")


_ATTR = ("product", "category", "unit")


@query("k15_item_consistency", f"WITH u AS ({' UNION ALL '.join(f'SELECT item_id, {chr(39)}{a}{chr(39)} AS attribute, {a} AS value FROM line' for a in _ATTR)}), n AS (SELECT item_id, attribute, value, count(*) AS n FROM u GROUP BY ALL)" + """
  SELECT item_id, attribute, CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (value IS NULL), 0) AS BIGINT) AS missing, CAST(count(value) AS BIGINT) AS forms, coalesce(round(100.0e0 * max(n) FILTER (value IS NOT NULL) / nullif(sum(n) FILTER (value IS NOT NULL), 0), 4), 0) AS support_percent,
  CASE WHEN count(value) = 0 THEN 'SEM_VALOR' WHEN count(value) > 1 THEN 'CONFLITANTE' WHEN coalesce(sum(n) FILTER (value IS NULL), 0) > 0 THEN 'INCOMPLETO' ELSE 'CONSISTENTE' END AS kind FROM n GROUP BY item_id, attribute""", LINES_SQL)
def item_consistency(spark, sf_dir) -> DataFrame:
    return items.consistency(lines(spark, sf_dir), "item_id", _ATTR)


@query("k16_item_mapping", """WITH n AS (SELECT item_id, product, category, unit, count(*) AS rows, min(row_id) AS first_row, max(row_id) AS last_row FROM line GROUP BY ALL)
  SELECT *, CAST(count(*) OVER (PARTITION BY item_id) AS BIGINT) AS combinations, round(100.0e0 * rows / sum(rows) OVER (PARTITION BY item_id), 4) AS percent FROM n""", LINES_SQL)
def item_mappings(spark, sf_dir) -> DataFrame:
    return items.mapping(lines(spark, sf_dir), "item_id", _ATTR, "row_id")


@query("k9_before_and_after_dedup", f"""WITH a AS (SELECT order_id, client_id, count(*) AS n FROM bronze GROUP BY ALL), b AS (SELECT order_id, client_id, count(*) AS n FROM (SELECT DISTINCT {LISTED} FROM bronze) x GROUP BY ALL)
  SELECT a.order_id, a.client_id, CAST(a.n AS BIGINT) AS before, CAST(b.n AS BIGINT) AS after, CASE WHEN b.n > 1 THEN 'REPETICAO_DIVERGENTE' WHEN a.n > 1 THEN 'REPETICAO_EXATA' ELSE 'UNICA' END AS kind FROM a FULL JOIN b ON a.order_id = b.order_id AND a.client_id = b.client_id""")
def before_and_after(spark, sf_dir) -> DataFrame:
    """Rows of each order and client before and after exact repeats are taken out, from one grouping."""
    distinct = bronze(spark, sf_dir).groupBy(*COLUMNS).agg(F.count("*").alias("n"))
    both = distinct.groupBy("order_id", "client_id").agg(F.sum("n").alias("before"), F.count("*").alias("after"))
    return both.withColumn("kind", F.when(F.col("after") > 1, "REPETICAO_DIVERGENTE").when(F.col("before") > 1, "REPETICAO_EXATA").otherwise("UNICA"))


@query("k18_row_meaning", """WITH k AS (SELECT (SELECT count(*) = count(DISTINCT order_id) FROM line) AS by_order, (SELECT count(*) = count(DISTINCT (order_id, item_id)) FROM line) AS by_item, (SELECT count(*) = count(DISTINCT row_id) FROM line) AS by_line)
  SELECT *, CASE WHEN by_order THEN 'uma_linha_por_pedido' WHEN by_item THEN 'uma_linha_por_pedido_e_item' WHEN by_line THEN 'uma_linha_por_linha_de_pedido' ELSE 'indefinido' END AS meaning FROM k""", LINES_SQL)
def row_meaning(spark, sf_dir) -> DataFrame:
    """What a row stands for, from which keys hold once; the row's own number is the last resort."""
    s = lines(spark, sf_dir)
    held = [s.groupBy(*k).agg(F.count("*").alias("n")).agg((F.max("n") == 1).alias(name)) for name, k in (("by_order", ["order_id"]), ("by_item", ["order_id", "item_id"]), ("by_line", ["row_id"]))]
    kind = F.when(F.col("by_order"), "uma_linha_por_pedido").when(F.col("by_item"), "uma_linha_por_pedido_e_item").when(F.col("by_line"), "uma_linha_por_linha_de_pedido").otherwise("indefinido")
    return held[0].crossJoin(held[1]).crossJoin(held[2]).withColumn("meaning", kind)  # one row each
