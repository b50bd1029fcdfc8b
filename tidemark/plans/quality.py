"""Data-quality queries: profiles, keys, rules, recovery, treatment and integrity of the star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import checks, keys, ordering, profile, treat
from tidemark.operators.checks import Rule
from tidemark.sources import tables
from tidemark.sources.bronze import BRONZE_SQL, bronze
from tidemark.sources.lines import LINES_SQL, lines
from tidemark.sources.commerce import STAR_SQL, client, delivery, item, order, read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
COLUMNS = ("order_id", "client_id", "payment", "amount", "bought_on", "bought_at", "coupon", "city", "age")
LISTED = ", ".join(COLUMNS)


def query(name: str, sql: str | None = None, base: str = BRONZE_SQL):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            body = sql.strip()
            ORACLE[name] = f"WITH {base}, {body[5:]}" if body.startswith("WITH ") else f"WITH {base} {body}"
        return f

    return put


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


PCT = "coalesce(round(100.0e0 * {a} / nullif({b}, 0), 4), 0)"
pct = lambda a, b: PCT.format(a=a, b=b)
big = lambda e: f"CAST({e} AS BIGINT)"
nn = lambda cond: big(f"count(CASE WHEN {cond} THEN 1 END)")
NORMAL = "translate(lower(regexp_replace(trim({c}), '\\s+', ' ', 'g')), 'ãáâàéêíóôõúç', 'aaaaeeiooouc')"
gone = lambda c: f"({c} IS NULL OR trim({c}) = '')"


@query("p1_column_profile", union([f"""SELECT '{c}' AS "column", {big('count(*)')} AS rows, {nn(f'{c} IS NULL')} AS nulls, {nn(f"{c} IS NOT NULL AND trim({c}) = ''")} AS blanks, {nn(f'{c} IS NOT NULL AND trim({c}) <> {c}')} AS outer_spaces, {nn(f'NOT {gone(c)}')} AS filled,
  {big(f'count(DISTINCT {c})')} AS distinct_values, CAST(min(length({c})) AS INT) AS min_length, CAST(max(length({c})) AS INT) AS max_length, {pct(f'count(DISTINCT {c})', 'count(*)')} AS cardinality FROM bronze""" for c in COLUMNS]))
def column_profile(spark, sf_dir) -> DataFrame:
    return profile.columns(bronze(spark, sf_dir), COLUMNS)


_DATED = "coalesce(TRY_CAST({0} AS DATE), CAST(try_strptime({0}, '%d/%m/%Y') AS DATE)) IS NOT NULL AND contains({0}, CASE WHEN {0} LIKE '%/%' THEN '/' ELSE '-' END)"
_TIMED = "regexp_matches({0}, '^([0-9]|1[0-9]|2[0-3]):[0-5][0-9]$')"
_SHARE = "coalesce(round(100.0e0 * count(*) FILTER (NOT {gone} AND {cond}) / nullif(count(*) FILTER (NOT {gone}), 0), 4), 0)"


def _reads(column: str, cond: str) -> str:
    return _SHARE.format(gone=gone(column), cond=cond.format(column))


@query("p2_convertibility", "WITH c AS (" + union([
    f"""SELECT '{c}' AS "column", {_reads(c, "TRY_CAST(replace(trim({0}), ',', '.') AS DOUBLE) IS NOT NULL")} AS numeric, {_reads(c, _DATED)} AS dated, {_reads(c, _TIMED)} AS timed, {big(f'count(DISTINCT {c})')} AS distinct_values FROM bronze"""
    for c in COLUMNS]) + """) SELECT *, CASE WHEN dated >= 95 THEN 'data' WHEN timed >= 95 THEN 'hora' WHEN numeric >= 95 THEN 'numerico' WHEN distinct_values <= 20 THEN 'categorico' ELSE 'texto' END AS suggested FROM c""")
def convertibility(spark, sf_dir) -> DataFrame:
    return profile.convertibility(bronze(spark, sf_dir), COLUMNS)


@query("p4_exact_duplicates", f"""WITH g AS (SELECT {LISTED}, count(*) AS n FROM bronze GROUP BY ALL) SELECT {big('sum(n)')} AS rows, {nn('n > 1')} AS groups, {big('coalesce(sum(CASE WHEN n > 1 THEN n END), 0)')} AS rows_in_groups, {big('coalesce(sum(CASE WHEN n > 1 THEN n - 1 END), 0)')} AS surplus, {pct('coalesce(sum(CASE WHEN n > 1 THEN n - 1 END), 0)', 'sum(n)')} AS percent FROM g""")
def exact_duplicates(spark, sf_dir) -> DataFrame:
    return profile.exact_duplicates(bronze(spark, sf_dir), COLUMNS)


@query("p5_duplicate_groups", f"SELECT {LISTED}, min(row_id) AS first_row, {big('count(*)')} AS group_size FROM bronze GROUP BY {LISTED} HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir) -> DataFrame:
    return profile.duplicate_groups(bronze(spark, sf_dir), COLUMNS, "row_id")


@query("p7_missing_patterns", f"SELECT coalesce(nullif(concat_ws(' | ', CASE WHEN {gone('payment')} THEN 'payment' END, CASE WHEN {gone('coupon')} THEN 'coupon' END, CASE WHEN {gone('age')} THEN 'age' END), ''), 'COMPLETO') AS pattern, {big('count(*)')} AS rows FROM bronze GROUP BY 1")
def missing_patterns(spark, sf_dir) -> DataFrame:
    return profile.missing_patterns(bronze(spark, sf_dir), ("payment", "coupon", "age"))


AMOUNT = "CASE WHEN amount LIKE 'R$%' THEN TRY_CAST(replace(replace(amount, 'R$ ', ''), ',', '.') AS DOUBLE) ELSE TRY_CAST(amount AS DOUBLE) END"


@query("p8_typing_errors", f"WITH t AS (SELECT row_id, amount, {AMOUNT} AS v FROM bronze) SELECT row_id, amount AS raw FROM t WHERE v IS NULL")
def typing_errors(spark, sf_dir) -> DataFrame:
    b = bronze(spark, sf_dir)
    return b.filter(T.number(F.col("amount")).isNull() & ~T.missing(F.col("amount"))).select("row_id", F.col("amount").alias("raw"))


@query("p10_statistics", f"""WITH v AS (SELECT DISTINCT client_id, {AMOUNT} AS v FROM bronze), s AS (SELECT {big('count(v)')} AS n, {big('count(DISTINCT v)')} AS distinct_values, min(v) AS lowest, max(v) AS highest, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std,
  quantile_cont(v, 0.01) AS p01, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.99) AS p99 FROM v)
SELECT n, distinct_values, lowest, highest, mean, std, round(p01, 6) AS p01, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(p99, 6) AS p99, round(q1 - 1.5 * (q3 - q1), 6) AS fence_low, round(q3 + 1.5 * (q3 - q1), 6) AS fence_high, round(q1 - 3 * (q3 - q1), 6) AS far_low, round(q3 + 3 * (q3 - q1), 6) AS far_high FROM s""")
def statistics(spark, sf_dir) -> DataFrame:
    return profile.statistics(bronze(spark, sf_dir), ["client_id"], T.number(F.col("amount")))


@query("p11_outliers", """WITH u AS (SELECT DISTINCT client_id, income FROM line), q AS (SELECT quantile_cont(income, 0.25) AS q1, quantile_cont(income, 0.75) AS q3 FROM u),
  f AS (SELECT round(q1 - 1.5 * (q3 - q1), 6) AS a, round(q3 + 1.5 * (q3 - q1), 6) AS b, round(q1 - 3 * (q3 - q1), 6) AS c, round(q3 + 3 * (q3 - q1), 6) AS d FROM q)
  SELECT row_id, client_id, income AS value, CASE WHEN income < c OR income > d THEN 'EXTREMO' ELSE 'MODERADO' END AS kind FROM line, f WHERE income < a OR income > b""", LINES_SQL)
def outlier_rows(spark, sf_dir) -> DataFrame:
    """Lines whose client's income lies beyond the fences over clients."""
    i = lines(spark, sf_dir)
    return profile.outliers(i, profile.statistics(i, ["client_id"], F.col("income")), "income", ["row_id", "client_id"])


@query("p12_domain", f"""WITH n AS (SELECT 'payment' AS "column", payment AS value, {big('count(*)')} AS n FROM bronze GROUP BY payment UNION ALL SELECT 'coupon', coupon, {big('count(*)')} FROM bronze GROUP BY coupon)
SELECT *, coalesce(CASE WHEN "column" = 'payment' THEN value IN ('1-URGENT', '2-HIGH') ELSE value IN ('F', 'O') END, false) AS allowed FROM n""")
def domain(spark, sf_dir) -> DataFrame:
    return profile.domain(bronze(spark, sf_dir), {"payment": ("1-URGENT", "2-HIGH"), "coupon": ("F", "O")})


_CONST = ("payment", "coupon", "city")


@query("p13_constancy", "WITH n AS (" + union([f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM bronze GROUP BY {c}" for c in _CONST]) + f""") SELECT "column", {big('count(*)')} AS "values", {big('sum(n)')} AS rows, max(n) * 1.0e0 / sum(n) AS top_share, CASE WHEN count(*) = 1 THEN 'CONSTANTE' WHEN max(n) * 1.0e0 / sum(n) >= 0.95 THEN 'DOMINANTE' ELSE 'VARIAVEL' END AS kind FROM n GROUP BY "column\"""")
def constancy(spark, sf_dir) -> DataFrame:
    return profile.constancy(bronze(spark, sf_dir), _CONST)


@query("p16_formula", f"SELECT {big('count(*)')} AS rows, {nn('abs(CAST(net AS DOUBLE) - CAST(gross AS DOUBLE)) > 0.01')} AS divergent, {pct('(count(*) - count(CASE WHEN abs(CAST(net AS DOUBLE) - CAST(gross AS DOUBLE)) > 0.01 THEN 1 END))', 'count(*)')} AS within, round(corr(CAST(net AS DOUBLE), CAST(gross AS DOUBLE)), 6) AS correlation FROM item", STAR_SQL)
def formula(spark, sf_dir) -> DataFrame:
    return profile.formula(item(spark, sf_dir), F.col("net"), F.col("gross"))


_KEYS = (("order_id",), ("order_id", "client_id"), ("client_id",))


def _key_sql(table: str, key: tuple[str, ...], out: str) -> str:
    miss = " OR ".join(gone(c) for c in key)
    return f"(SELECT '{' + '.join(key)}' AS candidate, sum(n) - count(*) = 0 AND coalesce(sum(CASE WHEN {miss} THEN n END), 0) = 0 AS {out}_unique, {big('sum(n) - count(*)')} AS {out}_surplus FROM (SELECT {', '.join(key)}, count(*) AS n FROM {table} GROUP BY ALL) g)"


@query("k4_candidate_keys", f"WITH slim AS (SELECT DISTINCT {LISTED} FROM bronze), r AS (" + union([f"SELECT * FROM {_key_sql('bronze', k, 'raw')} x" for k in _KEYS]) + "), s AS (" + union([f"SELECT * FROM {_key_sql('slim', k, 'net')} x" for k in _KEYS]) + ") SELECT r.candidate, raw_unique, raw_surplus, net_unique, net_surplus, CASE WHEN raw_unique THEN 'CONFIRMADA' WHEN net_unique THEN 'POTENCIAL' ELSE 'NAO_UNICA' END AS verdict FROM r JOIN s ON r.candidate = s.candidate")
def candidate_keys(spark, sf_dir) -> DataFrame:
    return keys.test_keys(bronze(spark, sf_dir), _KEYS, COLUMNS)


_IDS = ("order_id", "client_id", "payment")


@query("k1_identifiers", union([f"""SELECT '{c}' AS identifier, {big('sum(n)')} AS rows, {big(f'coalesce(sum(CASE WHEN {gone("v")} THEN n END), 0)')} AS missing, {nn(f'NOT {gone("v")}')} AS distinct_values, {big(f'coalesce(sum(CASE WHEN NOT {gone("v")} AND n > 1 THEN n END), 0)')} AS repeated_rows,
  {big(f'max(CASE WHEN NOT {gone("v")} THEN n END)')} AS most, arg_min(v, (-n, v)) FILTER (WHERE NOT {gone("v")}) AS most_frequent FROM (SELECT {c} AS v, count(*) AS n FROM bronze GROUP BY {c}) x""" for c in _IDS]))
def identifiers(spark, sf_dir) -> DataFrame:
    return keys.identifiers(bronze(spark, sf_dir), _IDS)


@query("k7_orders_per_client", f"WITH g AS (SELECT client_id, count(*) AS n FROM ord GROUP BY client_id) SELECT {big('count(*)')} AS clients, CAST(sum(n) AS DOUBLE) / count(*) AS mean, quantile_cont(CAST(n AS DOUBLE), 0.5) AS median, round(quantile_cont(CAST(n AS DOUBLE), 0.95), 6) AS p95, {big('max(n)')} AS most, {nn('n > 1')} AS repurchasing, {pct('count(CASE WHEN n > 1 THEN 1 END)', 'count(*)')} AS repurchase_percent FROM g", STAR_SQL)
def orders_per_client(spark, sf_dir) -> DataFrame:
    g = order(spark, sf_dir).groupBy("client_id").agg(F.count("*").alias("n"))
    again = F.count_if(F.col("n") > 1)
    return g.agg(F.count("*").alias("clients"), T.ratio(F.sum("n"), F.count("*")).alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.round(F.percentile("n", F.lit(0.95)), 6).alias("p95"), F.max("n").alias("most"), again.alias("repurchasing"), T.percent(again, F.count("*")).alias("repurchase_percent"))


@query("k8_order_item_combinations", f"SELECT order_id, product_id, {big('count(*)')} AS rows, {big('count(DISTINCT line_no)')} AS lines, {big('count(DISTINCT net)')} AS net_values FROM item GROUP BY order_id, product_id HAVING count(*) > 1", STAR_SQL)
def order_item_combinations(spark, sf_dir) -> DataFrame:
    g = item(spark, sf_dir).groupBy("order_id", "product_id").agg(F.count("*").alias("rows"), F.countDistinct("line_no").alias("lines"), F.countDistinct("net").alias("net_values"))
    return g.filter("rows > 1")


@query("k11_dedup_impact", f"WITH slim AS (SELECT DISTINCT {LISTED} FROM bronze), a AS (SELECT 'bruto' AS universe, {big('count(*)')} AS rows, {big('count(DISTINCT order_id)')} AS orders, {big('count(DISTINCT client_id)')} AS clients FROM bronze), b AS (SELECT 'sem_excedente', {big('count(*)')}, {big('count(DISTINCT order_id)')}, {big('count(DISTINCT client_id)')} FROM slim) SELECT * FROM a UNION ALL SELECT * FROM b")
def dedup_impact(spark, sf_dir) -> DataFrame:
    b = bronze(spark, sf_dir)
    of = lambda df, name: df.agg(F.count("*").alias("rows"), F.countDistinct("order_id").alias("orders"), F.countDistinct("client_id").alias("clients")).select(F.lit(name).alias("universe"), "*")
    return of(b, "bruto").unionByName(of(b.select(*COLUMNS).distinct(), "sem_excedente"))


@query("p14_client_recalculation", "SELECT client_id, CAST(count(*) AS BIGINT) AS orders, CAST(count(DISTINCT order_date) AS BIGINT) AS purchase_days, CAST(date_diff('day', max(order_date), DATE '2001-12-31') AS INT) AS recency, CASE WHEN count(DISTINCT order_date) > 1 THEN CAST(date_diff('day', min(order_date), max(order_date)) AS DOUBLE) / (count(DISTINCT order_date) - 1) END AS mean_interval, CAST(sum(net) AS DOUBLE) / count(*) AS ticket FROM ord GROUP BY client_id", STAR_SQL)
def client_recalculation(spark, sf_dir, as_of: str = "2001-12-31") -> DataFrame:
    days = F.countDistinct("order_date")
    gap = F.when(days > 1, F.datediff(F.max("order_date"), F.min("order_date")).cast("double") / (days - 1))
    return order(spark, sf_dir).groupBy("client_id").agg(F.count("*").alias("orders"), days.alias("purchase_days"), F.datediff(F.lit(as_of).cast("date"), F.max("order_date")).alias("recency"), gap.alias("mean_interval"), T.ratio(F.sum("net"), F.count("*")).alias("ticket"))


@query("k5_order_distribution", f"SELECT order_id, {big('count(*)')} AS rows, min(line_no) AS first_row, max(line_no) AS last_row, {big('count(DISTINCT client_id)')} AS n_client_id, {big('count(DISTINCT product_id)')} AS n_product_id, {big('count(DISTINCT category)')} AS n_category FROM item GROUP BY order_id", STAR_SQL)
def order_distribution(spark, sf_dir) -> DataFrame:
    return keys.group_distribution(item(spark, sf_dir), "order_id", "line_no", ("client_id", "product_id", "category"))


@query("k10_differing_columns", f"""WITH m AS (SELECT order_id, line_no FROM item GROUP BY ALL HAVING count(*) > 1), g AS (SELECT i.order_id, i.line_no, {big('count(DISTINCT product_id)')} AS p, {big('count(DISTINCT category)')} AS c, {big('count(DISTINCT net)')} AS v FROM item i JOIN m ON i.order_id = m.order_id AND i.line_no = m.line_no GROUP BY ALL)
SELECT order_id, line_no, 'product_id' AS "column", p AS n_values FROM g WHERE p > 1 UNION ALL SELECT order_id, line_no, 'category', c FROM g WHERE c > 1 UNION ALL SELECT order_id, line_no, 'net', v FROM g WHERE v > 1""", STAR_SQL)
def differing_columns(spark, sf_dir) -> DataFrame:
    return keys.differing_columns(item(spark, sf_dir), ("order_id", "line_no"), ("product_id", "category", "net"))


@query("k12_granularity", f"WITH g AS (SELECT order_id, count(*) AS n, count(DISTINCT client_id) AS o FROM item GROUP BY order_id) SELECT {big('count(*)')} AS groups, {nn('n = 1')} AS single, {nn('n > 1')} AS multi, CAST(sum(n) AS DOUBLE) / count(*) AS mean, quantile_cont(CAST(n AS DOUBLE), 0.5) AS median, round(quantile_cont(CAST(n AS DOUBLE), 0.95), 6) AS p95, {big('max(n)')} AS most, {nn('o > 1')} AS several_owners FROM g", STAR_SQL)
def granularity(spark, sf_dir) -> DataFrame:
    return keys.granularity(item(spark, sf_dir), "order_id", "client_id")


@query("k13_lines_histogram", f"SELECT n AS rows, {big('count(*)')} AS groups FROM (SELECT {big('count(*)')} AS n FROM item GROUP BY order_id) g GROUP BY n", STAR_SQL)
def lines_histogram(spark, sf_dir) -> DataFrame:
    return keys.histogram(item(spark, sf_dir), "order_id")


_VARY = ("client_id", "product_id", "category", "line_no")


@query("k14_varying_columns", "WITH g AS (SELECT " + ", ".join(f"count(DISTINCT {c}) AS {c}" for c in _VARY) + " FROM item GROUP BY order_id HAVING count(*) > 1) " + union([f"SELECT {big('count(*)')} AS groups, '{c}' AS \"column\", {nn(f'{c} > 1')} AS varying, {pct(f'count(CASE WHEN {c} > 1 THEN 1 END)', 'count(*)')} AS percent FROM g" for c in _VARY]), STAR_SQL)
def varying_columns(spark, sf_dir) -> DataFrame:
    return keys.varying_columns(item(spark, sf_dir), "order_id", _VARY)


@query("k17_canonical_map", "WITH u AS (" + union([f"SELECT client_id, '{c}' AS attribute, {c} AS value FROM bronze" for c in ("age", "payment", "city")]) + f"""), n AS (SELECT client_id, attribute, value, count(*) AS n, value IS NOT NULL AND trim(value) <> '' AS known, {NORMAL.format(c='value')} AS form FROM u GROUP BY ALL),
  g AS (SELECT client_id, attribute, arg_min(value, (-n, value)) FILTER (known) AS canonical, max(n) FILTER (known) AS support, coalesce(sum(n) FILTER (known), 0) AS k, sum(n) AS rows, count(*) FILTER (known) AS raw_values, count(DISTINCT form) FILTER (known) AS normal_values FROM n GROUP BY client_id, attribute)
  SELECT client_id, attribute, canonical, coalesce(round(100.0e0 * coalesce(support, 0) / nullif(k, 0), 4), 0) AS support_percent, {big('raw_values')} AS raw_values, {big('normal_values')} AS normal_values,
  concat_ws(' | ', CASE WHEN k < rows THEN 'AUSENTE' END, CASE WHEN normal_values > 1 THEN 'CONFLITO' END, CASE WHEN raw_values > normal_values THEN 'VARIANTE' END) AS problems FROM g""")
def canonical_map(spark, sf_dir) -> DataFrame:
    return keys.canonical_map(bronze(spark, sf_dir), "client_id", ("age", "payment", "city"))


@query("k20_frequency_text", "WITH n AS (SELECT region, coalesce(education, '<NULO>') AS g, count(*) AS n FROM client GROUP BY ALL) SELECT region, string_agg(concat(g, ': ', CAST(n AS VARCHAR)), ' | ' ORDER BY n DESC, g) AS frequencies FROM n GROUP BY region", STAR_SQL)
def frequency_text(spark, sf_dir) -> DataFrame:
    return keys.frequency_text(client(spark, sf_dir), "region", "education")


@query("k21_attribute_conflicts", f"SELECT client_id, 'payment' AS attribute, {big('count(DISTINCT CASE WHEN NOT ' + gone('payment') + ' THEN payment END)')} AS n_values FROM bronze GROUP BY client_id HAVING count(DISTINCT CASE WHEN NOT {gone('payment')} THEN payment END) > 1 UNION ALL SELECT client_id, 'age', {big('count(DISTINCT age)')} FROM bronze GROUP BY client_id HAVING count(DISTINCT age) > 1")
def attribute_conflicts(spark, sf_dir) -> DataFrame:
    return keys.attribute_conflicts(bronze(spark, sf_dir), "client_id", ("payment", "age"))


@query("r1_recover_age", """WITH n AS (SELECT client_id, age AS v, count(*) AS n FROM bronze WHERE age IS NOT NULL GROUP BY ALL), s AS (SELECT client_id, arg_min(v, (-n, v)) AS candidate, max(n) AS support, sum(n) AS known, count(DISTINCT v) AS d FROM n GROUP BY client_id)
SELECT b.row_id, b.client_id, candidate, CAST(coalesce(support, 0) AS BIGINT) AS support, CAST(coalesce(known, 0) AS BIGINT) AS known, CASE WHEN d IS NULL THEN 'SEM_EVIDENCIA' WHEN d = 1 THEN 'DETERMINISTICO' ELSE 'CONFLITO' END AS recovery FROM bronze b LEFT JOIN s ON b.client_id = s.client_id WHERE b.age IS NULL""")
def recover_age(spark, sf_dir) -> DataFrame:
    return treat.recover(bronze(spark, sf_dir), "row_id", "age", "client_id")


@query("r4_recover_jointly", """WITH f AS (SELECT client_id, count(DISTINCT coupon) AS c, count(DISTINCT age) AS a FROM bronze GROUP BY client_id), x AS (SELECT row_id, b.client_id, concat_ws(' | ', CASE WHEN coupon IS NULL THEN 'coupon' END, CASE WHEN age IS NULL THEN 'age' END) AS missing, concat_ws(' | ', CASE WHEN coupon IS NULL AND c = 1 THEN 'coupon' END, CASE WHEN age IS NULL AND a = 1 THEN 'age' END) AS recoverable FROM bronze b JOIN f ON b.client_id = f.client_id)
SELECT *, CASE WHEN recoverable = '' THEN 'NENHUMA' WHEN recoverable = missing THEN 'TOTAL' ELSE 'PARCIAL' END AS recovery FROM x WHERE missing <> ''""")
def recover_jointly(spark, sf_dir) -> DataFrame:
    return treat.recover_jointly(bronze(spark, sf_dir), "row_id", ("coupon", "age"), "client_id")


@query("r5_recoverability", """WITH n AS (SELECT client_id, count(DISTINCT age) AS d FROM bronze GROUP BY client_id) SELECT 'age' AS analysis, CASE WHEN d = 0 THEN 'SEM_EVIDENCIA' WHEN d = 1 THEN 'DETERMINISTICO' ELSE 'CONFLITO' END AS recovery, CAST(count(*) AS BIGINT) AS rows FROM bronze b JOIN n ON b.client_id = n.client_id WHERE age IS NULL GROUP BY 2""")
def recoverability(spark, sf_dir) -> DataFrame:
    return recover_age(spark, sf_dir).groupBy(F.lit("age").alias("analysis"), "recovery").agg(F.count("*").alias("rows"))


def rules() -> tuple[Rule, ...]:
    return (
        Rule("Q_AGE", F.expr("TRY_CAST(age AS INT) NOT BETWEEN 16 AND 80"), "client", "alta"),
        Rule("Q_AMOUNT", T.number(F.col("amount")) <= 1, "row", "alta"),
        Rule("Q_TIME", T.time_of_day(F.col("bought_at")).isNull(), "row", "media"),
        Rule("Q_COUPON", F.col("coupon").isNull(), "order", "baixa"),
    )


RULES_SQL = (("Q_AGE", "client", "alta", "TRY_CAST(age AS INT) NOT BETWEEN 16 AND 80"), ("Q_AMOUNT", "row", "alta", f"{AMOUNT} <= 1"), ("Q_TIME", "row", "media", "bought_at = '24:00'"), ("Q_COUPON", "order", "baixa", "coupon IS NULL"))


@query("q1_rule_summary", union([f"SELECT '{i}' AS rule_id, '{lv}' AS level, '{sv}' AS severity, {big('count(*)')} AS rows, {nn(c)} AS violations, {pct(f'count(CASE WHEN {c} THEN 1 END)', 'count(*)')} AS percent, CASE WHEN count(CASE WHEN {c} THEN 1 END) = 0 THEN 'CONFORME' ELSE 'DIVERGENTE' END AS status FROM bronze" for i, lv, sv, c in RULES_SQL]))
def rule_summary(spark, sf_dir) -> DataFrame:
    return checks.rule_summary(bronze(spark, sf_dir), rules())


@query("q1_rule_violations", union([f"SELECT row_id, order_id, '{i}' AS rule_id FROM bronze WHERE {c}" for i, _, _, c in RULES_SQL]))
def rule_violations(spark, sf_dir) -> DataFrame:
    return checks.rule_violations(bronze(spark, sf_dir), rules(), ("row_id", "order_id"))


@query("t2_dedup_plan", f"WITH w AS (SELECT row_id, min(row_id) OVER p AS group_first, {big('count(*) OVER p')} AS group_size, CAST(row_number() OVER (PARTITION BY {LISTED} ORDER BY row_id) AS INT) AS place FROM bronze WINDOW p AS (PARTITION BY {LISTED})) SELECT *, CASE WHEN place = 1 THEN 'MANTER' ELSE 'REMOVER' END AS action FROM w WHERE group_size > 1")
def dedup_plan(spark, sf_dir) -> DataFrame:
    return treat.with_places(treat.dedup_plan(bronze(spark, sf_dir), COLUMNS, "row_id"), "row_id")


def corrections(spark, sf_dir) -> DataFrame:
    """Recovered ages, upper-case payments (second in priority), and coupons set to unknown."""
    b = bronze(spark, sf_dir)
    form = lambda field, old, new, rule, p: [F.col("row_id"), F.lit(field).alias("field"), old.alias("original"), new.alias("proposed"), F.lit(rule).alias("rule_id"), F.lit(p).alias("priority")]
    age = recover_age(spark, sf_dir).filter("recovery = 'DETERMINISTICO'").select(*form("age", F.lit(None).cast("string"), F.col("candidate"), "TR001", 1))
    pay = b.filter(F.col("payment").isNotNull() & (F.upper(F.trim("payment")) != F.col("payment"))).select(*form("payment", F.col("payment"), F.nullif(F.upper(F.trim("payment")), F.lit("")), "TR016", 2))
    off = b.filter("coupon = 'P'").select(*form("coupon", F.col("coupon"), F.lit(None).cast("string"), "TR003", 1))
    return age.unionByName(pay).unionByName(off)


CORRECTED_SQL = """WITH one AS (SELECT client_id, min(age) AS a FROM bronze GROUP BY client_id HAVING count(DISTINCT age) = 1),
fixed AS (SELECT row_id, order_id, b.client_id, CASE WHEN payment IS NOT NULL AND upper(trim(payment)) <> payment THEN nullif(upper(trim(payment)), '') ELSE payment END AS payment, amount, bought_on, bought_at, CASE WHEN coupon = 'P' THEN NULL ELSE coupon END AS coupon, city, CASE WHEN age IS NULL THEN a ELSE age END AS age FROM bronze b LEFT JOIN one ON b.client_id = one.client_id)"""


@query("t11_apply_corrections", CORRECTED_SQL + " SELECT * FROM fixed")
def corrected(spark, sf_dir) -> DataFrame:
    return treat.apply_corrections(bronze(spark, sf_dir), "row_id", corrections(spark, sf_dir))[0]


AUDIT_SQL = CORRECTED_SQL + ", audit AS (" + union([f"SELECT b.row_id, '{c}' AS field, b.{c} AS before, f.{c} AS after, '{r}' AS rule_id, 'CORRIGIR' AS action FROM bronze b JOIN fixed f ON b.row_id = f.row_id WHERE b.{c} IS DISTINCT FROM f.{c}" for c, r in (("age", "TR001"), ("payment", "TR016"), ("coupon", "TR003"))]) + ")"


@query("t11_audit", AUDIT_SQL + " SELECT * FROM audit")
def audit(spark, sf_dir) -> DataFrame:
    return treat.apply_corrections(bronze(spark, sf_dir), "row_id", corrections(spark, sf_dir))[1]


@query("t18_change_summary", AUDIT_SQL + f" SELECT action, rule_id, field, {big('count(*)')} AS changes FROM audit GROUP BY ALL")
def change_summary(spark, sf_dir) -> DataFrame:
    return treat.change_summary(audit(spark, sf_dir))


@query("t13_standard_variants", "WITH n AS (SELECT 'k' AS k, trim(city) AS v, count(*) AS n FROM bronze GROUP BY ALL), b AS (SELECT arg_min(v, (-n, v)) AS best FROM n) SELECT row_id, best AS city FROM bronze, b")
def standard_variants(spark, sf_dir) -> DataFrame:
    return treat.standard_variants(bronze(spark, sf_dir), "city").select("row_id", "city")


@query("t13_payment_variants", """WITH n AS (SELECT lower(trim(payment)) AS k, trim(payment) AS v, count(*) AS n FROM bronze WHERE payment IS NOT NULL AND trim(payment) <> '' GROUP BY ALL), b AS (SELECT k, arg_min(v, (-n, v)) AS best FROM n GROUP BY k)
  SELECT row_id, coalesce(best, payment) AS payment FROM bronze LEFT JOIN b ON b.k = lower(trim(payment))""")
def payment_variants(spark, sf_dir) -> DataFrame:
    """The most frequent spelling of each payment, several in one column."""
    return treat.standard_variants(bronze(spark, sf_dir), "payment").select("row_id", "payment")


@query("t15_quarantine", "WITH e AS (SELECT order_id FROM bronze GROUP BY order_id HAVING count(coupon) = 0 AND count(age) = 0) SELECT row_id, order_id FROM bronze WHERE order_id IN (SELECT order_id FROM e)")
def quarantined(spark, sf_dir) -> DataFrame:
    return treat.quarantine(bronze(spark, sf_dir), "order_id", ("coupon", "age"))[1].select("row_id", "order_id")


@query("t16_lineage", AUDIT_SQL + """, r AS (SELECT row_id, string_agg(DISTINCT rule_id, ' | ' ORDER BY rule_id) AS rules_applied FROM audit GROUP BY row_id) SELECT b.row_id, rules_applied, CASE WHEN b.payment IS NULL THEN 'PEND01' END AS open_points, CASE WHEN b.payment IS NULL THEN 'pendente' WHEN rules_applied IS NOT NULL THEN 'tratado' ELSE 'sem_alteracao' END AS quality_status FROM bronze b LEFT JOIN r ON b.row_id = r.row_id""")
def lineage(spark, sf_dir) -> DataFrame:
    b = bronze(spark, sf_dir)
    pending = b.filter("payment IS NULL").select("row_id", F.lit("PEND01").alias("rule_id"))
    return treat.lineage(b.select("row_id"), "row_id", audit(spark, sf_dir), pending)


@query("d1_dense_dimension", "SELECT CAST(row_number() OVER (ORDER BY n) AS BIGINT) AS name_sk, n AS c_name FROM (SELECT DISTINCT c_name AS n FROM customer) x")
def dense_dimension(spark, sf_dir) -> DataFrame:
    return ordering.dense_keys(read(spark, sf_dir, "customer"), ["c_name"], "name_sk")


@query("d2_date_dimension", """WITH b AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS z FROM orders), d AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM b)
SELECT day AS full_date, CAST(strftime(day, '%Y%m%d') AS INT) AS date_sk, CAST(year(day) AS INT) AS year, CAST(quarter(day) AS INT) AS quarter, CAST(month(day) AS INT) AS month, CAST(weekofyear(day) AS INT) AS iso_week, CAST(dayofyear(day) AS INT) AS day_of_year, CAST(isodow(day) AS INT) AS weekday, CAST(year(day) * 100 + month(day) AS INT) AS year_month, isodow(day) >= 6 AS is_weekend FROM d""")
def date_dimension(spark, sf_dir) -> DataFrame:
    span = read(spark, sf_dir, "orders").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("z"))
    days = span.select(F.explode(F.sequence("a", "z")).alias("full_date"))
    parts = T.calendar(F.col("full_date"))
    return days.select("full_date", *[parts[n].alias(n) for n in ("date_sk", "year", "quarter", "month", "iso_week", "day_of_year", "weekday", "year_month", "is_weekend")])


@query("d11_client_month", """WITH m AS (SELECT client_id, ym, CAST(count(*) AS BIGINT) AS orders, sum(net) AS net, max(order_date) AS last_d, min(order_date) AS first_d FROM ord GROUP BY client_id, ym),
h AS (SELECT max(ym) AS z FROM ord), c AS (SELECT client_id, min(ym) AS a FROM ord GROUP BY client_id),
g AS (SELECT client_id, CAST(unnest(generate_series(make_date(a // 100, a % 100, 1), make_date(z // 100, z % 100, 1), INTERVAL 1 MONTH)) AS DATE) AS month_start FROM c, h),
j AS (SELECT g.client_id, month_start, coalesce(orders, 0) AS orders, coalesce(net, 0) AS net, last_d FROM g LEFT JOIN m ON g.client_id = m.client_id AND year(month_start) * 100 + month(month_start) = m.ym)
SELECT client_id, month_start, orders, CAST(net AS DOUBLE) AS net, CAST(net AS DOUBLE) / nullif(orders, 0) AS ticket, CAST(sum(orders) OVER w AS BIGINT) AS orders_so_far, CAST(date_diff('day', max(last_d) OVER w, last_day(month_start)) AS INT) AS recency FROM j WINDOW w AS (PARTITION BY client_id ORDER BY month_start ROWS UNBOUNDED PRECEDING)""", STAR_SQL)
def client_month(spark, sf_dir) -> DataFrame:
    """Monthly snapshot from a client's first month to the last month of the data; empty months hold zeros."""
    from pyspark.sql import Window

    o = order(spark, sf_dir).withColumn("month_start", F.trunc("order_date", "MM"))
    m = o.groupBy("client_id", "month_start").agg(F.count("*").alias("orders"), F.sum("net").alias("net"), F.max("order_date").alias("last_d"))
    horizon = o.agg(F.max("month_start").alias("z"))
    first = o.groupBy("client_id").agg(F.min("month_start").alias("a"))
    grid = first.crossJoin(F.broadcast(horizon)).select("client_id", F.explode(F.sequence("a", "z", F.expr("INTERVAL 1 MONTH"))).alias("month_start"))  # one row
    j = grid.join(m, ["client_id", "month_start"], "left").withColumn("orders", F.coalesce("orders", F.lit(0)))
    w = Window.partitionBy("client_id").orderBy("month_start").rowsBetween(Window.unboundedPreceding, 0)
    return j.select("client_id", "month_start", "orders", F.coalesce(F.col("net"), F.lit(0)).cast("double").alias("net"), T.ratio(F.col("net"), F.nullif(F.col("orders"), F.lit(0))).alias("ticket"), F.sum("orders").over(w).alias("orders_so_far"), F.datediff(F.last_day("month_start"), F.max("last_d").over(w)).alias("recency"))


_GRAIN = {"item": ("order_id", "line_no"), "ord": ("order_id",), "client": ("client_id",), "delivery": ("order_id",)}


@query("g5_grain_checks", "WITH t AS (" + union([f"SELECT '{t}' AS table_name, {big('sum(n)')} AS rows, {big('count(*)')} AS keys, {nn('n > 1')} AS duplicate_groups, CAST(0 AS BIGINT) AS null_keys FROM (SELECT {', '.join(g)}, count(*) AS n FROM {t} GROUP BY ALL) x" for t, g in _GRAIN.items()]) + ") SELECT *, CASE WHEN duplicate_groups = 0 AND null_keys = 0 THEN 'APROVADO' ELSE 'REPROVADO' END AS status FROM t", STAR_SQL)
def grain_checks(spark, sf_dir) -> DataFrame:
    made = {"item": item, "ord": order, "client": client, "delivery": delivery}
    return checks.grain_checks({t: (made[t](spark, sf_dir), g) for t, g in _GRAIN.items()})


_FK = (("lineitem_orders", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders_customer", "orders", "o_custkey", "customer", "c_custkey"), ("orders_lineitem", "orders", "o_orderkey", "lineitem", "l_orderkey"), ("lineitem_part", "lineitem", "l_partkey", "part", "p_partkey"))


@query("g8_orphans", "WITH t AS (" + union([f"SELECT '{n}' AS relation, {big('count(*)')} AS rows, {nn(f'p.k IS NULL AND c.{fk} IS NOT NULL')} AS orphans, {nn(f'c.{fk} IS NULL')} AS nulls FROM {c} c LEFT JOIN (SELECT DISTINCT {pk} AS k FROM {p}) p ON c.{fk} = p.k" for n, c, fk, p, pk in _FK]) + ") SELECT *, CASE WHEN orphans = 0 THEN 'APROVADO' ELSE 'REPROVADO' END AS status FROM t")
def orphans(spark, sf_dir) -> DataFrame:
    return checks.orphans([(n, read(spark, sf_dir, c), fk, read(spark, sf_dir, p), pk) for n, c, fk, p, pk in _FK])


@query("g2_volumes", union([f"SELECT '{t}' AS table_name, {big('count(*)')} AS rows FROM {t}" for t in ("customer", "orders", "lineitem", "part", "supplier", "nation", "region")]))
def volumes(spark, sf_dir) -> DataFrame:
    return tables.counts({t: read(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "part", "supplier", "nation", "region")})


@query("g13_arithmetic", f"SELECT {big('count(*)')} AS rows, {nn('abs(gross - discount - net) > 0.01')} AS discount_breaks, {nn('abs(net - cost - margin) > 0.01')} AS margin_breaks, {nn('net < 0')} AS negative_net FROM ord", STAR_SQL)
def arithmetic(spark, sf_dir) -> DataFrame:
    return order(spark, sf_dir).agg(F.count("*").alias("rows"), F.count_if(F.abs(F.expr("gross - discount - net")) > 0.01).alias("discount_breaks"), F.count_if(F.abs(F.expr("net - cost - margin")) > 0.01).alias("margin_breaks"), F.count_if(F.col("net") < 0).alias("negative_net"))


_SUMS = ("gross", "net", "cost", "margin", "discount")


@query("g14_orders_vs_items", "WITH o AS (SELECT " + ", ".join(f"sum({c}) AS {c}" for c in _SUMS) + " FROM ord), i AS (SELECT " + ", ".join(f"sum({c}) AS {c}" for c in _SUMS) + " FROM item) " + union([f"SELECT '{c}' AS measure, CAST(o.{c} AS DOUBLE) AS of_orders, CAST(i.{c} AS DOUBLE) AS of_items, CASE WHEN abs(o.{c} - i.{c}) <= 0.01 THEN 'APROVADO' ELSE 'REPROVADO' END AS status FROM o, i" for c in _SUMS]), STAR_SQL)
def orders_vs_items(spark, sf_dir) -> DataFrame:
    long = lambda df, n: df.agg(*[F.sum(c).cast("decimal(38,4)").alias(c) for c in _SUMS]).withColumn("one", F.lit(1)).unpivot("one", list(_SUMS), "measure", n).drop("one")
    both = long(order(spark, sf_dir), "a").join(long(item(spark, sf_dir), "b"), "measure")
    return both.select("measure", F.col("a").cast("double").alias("of_orders"), F.col("b").cast("double").alias("of_items"), F.when(F.abs(F.col("a") - F.col("b")) <= 0.01, "APROVADO").otherwise("REPROVADO").alias("status"))


@query("io13_content_hash", """WITH j AS (SELECT sha256(concat('{"c_custkey":', c_custkey, ',"c_name":"', c_name, '","c_mktsegment":"', c_mktsegment, '"}')) AS h FROM customer)
  SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(3 AS INT) AS n_columns, sha256(CAST(sum(CAST(concat('0x', substr(h, 1, 15)) AS BIGINT)) AS VARCHAR)) AS content_hash FROM j""")
def content_hash(spark, sf_dir) -> DataFrame:
    return tables.content(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"))
