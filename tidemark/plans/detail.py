"""Rows behind the summaries: profiles with samples, typing errors, clients and their orders, recoveries, decisions,
timestamps and contract casts; facts with all keys; volumes, grains and objects of the star; the last approved load."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import checks, silver, treat
from tidemark.operators import treatments as R
from tidemark.sources import loading, tables
from tidemark.sources.bronze import BRONZE_SQL, bronze
from tidemark.sources.commerce import order_context, read
from tidemark.sources.lines import LINES_SQL, lines

from . import treatments, warehouse
from .quality import COLUMNS
from .registry import Registry
from .silver import _HAVE, _READ, PLAN

query = Registry(BRONZE_SQL)
QUERIES, ORACLE = query.queries, query.oracle
big = lambda e: f"CAST({e} AS BIGINT)"
_BLANK = "({0} IS NULL OR trim({0}) = '')"


def column_values(rows: DataFrame, columns, row_id: str) -> DataFrame:
    """column, value, n, first_row: the distinct values of each column with their count and first row; one scan."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(row_id, each.alias("x")).select(row_id, "x.*").groupBy("column", "value").agg(F.count("*").alias("n"), F.min(row_id).alias("first_row"))


_VALUES = "vals AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, {c} AS value, row_id FROM bronze" for c in COLUMNS) + "), dist AS (SELECT c, value, count(*) AS n, min(row_id) AS first_row FROM vals GROUP BY ALL)"


@query("p1_column_samples", f"""WITH {_VALUES}, tot AS (SELECT c, {big('sum(n)')} AS rows, {big(f"coalesce(sum(n) FILTER ({_BLANK.format('value')}), 0)")} AS missing, {big(f"count(*) FILTER (NOT {_BLANK.format('value')})")} AS distinct_values,
  {big('min(length(value)) FILTER (NOT ' + _BLANK.format('value') + ')')} AS shortest, {big('max(length(value)) FILTER (NOT ' + _BLANK.format('value') + ')')} AS longest FROM dist GROUP BY c),
  few AS (SELECT c, value, first_row FROM dist WHERE NOT {_BLANK.format('value')} QUALIFY row_number() OVER (PARTITION BY c ORDER BY first_row, value) <= 5)
  SELECT tot.c AS "column", rows, missing, round(100.0e0 * missing / rows, 4) AS missing_pct, distinct_values, round(100.0e0 * distinct_values / nullif(rows - missing, 0), 4) AS cardinality_pct, shortest, longest, samples
  FROM tot JOIN (SELECT c, string_agg(value, ' | ' ORDER BY first_row, value) AS samples FROM few GROUP BY c) s ON s.c = tot.c""")
def column_samples(spark, sf_dir) -> DataFrame:
    """Each column with missing and distinct values, lengths, and the five values that come first."""
    values = tables.stored(column_values(bronze(spark, sf_dir), COLUMNS, "row_id"))
    have = ~T.missing(F.col("value"))
    size = F.length("value").cast("bigint")
    told = values.groupBy("column").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(~have, F.col("n"))), F.lit(0)).alias("missing"), F.count_if(have).alias("distinct_values"), F.min(F.when(have, size)).alias("shortest"), F.max(F.when(have, size)).alias("longest"))
    first = Window.partitionBy("column").orderBy("first_row", "value")
    few = values.filter(have).withColumn("place", F.row_number().over(first)).filter("place <= 5")
    samples = few.groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), " | ").alias("samples"))
    known = F.col("rows") - F.col("missing")
    return told.join(samples, "column").withColumns({"missing_pct": F.round(100.0 * F.col("missing") / F.col("rows"), 4), "cardinality_pct": F.round(F.try_divide(F.col("distinct_values") * 100.0, known), 4)})


@query("p8_typing_error_rows", " UNION ALL ".join(f"SELECT row_id, '{c}' AS \"column\", '{k}' AS kind, {c} AS value FROM bronze WHERE {_HAVE.format(c)} AND {_READ[c]} IS NULL" for c, k in PLAN.items()))
def typing_error_rows(spark, sf_dir) -> DataFrame:
    """Every value that does not read as the kind its column is planned to be."""
    bad = [F.when(~T.missing(F.col(c)) & silver.KINDS[k](F.col(c)).isNull(), F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col(c).alias("value"))) for c, k in PLAN.items()]
    return bronze(spark, sf_dir).select("row_id", F.explode(F.array_compact(F.array(*bad))).alias("e")).select("row_id", "e.*")


_FIRSTS = f"firsts AS (SELECT *, min(row_id) OVER (PARTITION BY {', '.join(COLUMNS)}) AS first_row FROM bronze)"


@query("k6_orders_of_clients", f"WITH {_FIRSTS} SELECT client_id, {big('count(DISTINCT order_id)')} AS orders, {big('count(*)')} AS rows, count(DISTINCT order_id) > 1 AS bought_again FROM firsts WHERE row_id = first_row GROUP BY client_id")
def orders_of_clients(spark, sf_dir) -> DataFrame:
    """Clients with their orders, without surplus copies, and whether they bought again."""
    b = bronze(spark, sf_dir)
    slim = b.groupBy(*COLUMNS).agg(F.min("row_id").alias("first_row"))
    return slim.groupBy("client_id").agg(F.countDistinct("order_id").alias("orders"), F.count("*").alias("rows")).withColumn("bought_again", F.col("orders") > 1)


@query("k11_dedup_concentration", f"""WITH {_FIRSTS}, g AS (SELECT client_id, count(*) AS rows, count(*) FILTER (row_id <> first_row) AS surplus FROM firsts GROUP BY client_id)
  SELECT {big('sum(rows)')} AS rows_before, {big('sum(rows - surplus)')} AS rows_after, {big('count(*)')} AS clients_before, {big('count(*) FILTER (rows > surplus)')} AS clients_after, {big('count(*) FILTER (surplus > 0)')} AS clients_touched,
  {big('max(surplus)')} AS most_of_a_client, round(100.0e0 * max(surplus) / nullif(sum(surplus), 0), 4) AS most_pct, round(100.0e0 * sum(surplus) / sum(rows), 4) AS removed_pct FROM g""")
def dedup_concentration(spark, sf_dir) -> DataFrame:
    """What removing surplus copies takes away, and how far it lies with few clients."""
    groups = bronze(spark, sf_dir).groupBy(*COLUMNS).agg(F.count("*").alias("n"))
    c = groups.groupBy("client_id").agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("surplus"))
    gone, rows = F.sum("surplus"), F.sum("rows")
    return c.agg(
        rows.alias("rows_before"), F.sum(F.col("rows") - F.col("surplus")).alias("rows_after"), F.count("*").alias("clients_before"), F.count_if(F.col("rows") > F.col("surplus")).alias("clients_after"), F.count_if(F.col("surplus") > 0).alias("clients_touched"),
        F.max("surplus").alias("most_of_a_client"), F.round(F.try_divide(F.max("surplus") * 100.0, gone), 4).alias("most_pct"), F.round(gone * 100.0 / rows, 4).alias("removed_pct"))


_RECOVERED = (("category", "item_id"), ("city", "client_id"), ("education", "client_id"))


@query("r2_recoveries", " UNION ALL ".join(f"""SELECT r.row_id, '{f}' AS field, '{g}' AS by_group, m.v AS candidate, {big('coalesce(m.n, 0)')} AS support, CASE WHEN k.kinds IS NULL OR k.kinds = 0 THEN 'SEM_EVIDENCIA' WHEN k.kinds = 1 THEN 'DETERMINISTICO' ELSE 'CONFLITO' END AS recovery
  FROM raw r LEFT JOIN (SELECT {g}, count(DISTINCT lower({f})) AS kinds FROM raw GROUP BY {g}) k ON k.{g} = r.{g} LEFT JOIN (SELECT {g}, arg_min({f}, (-n, {f})) AS v, max(n) AS n FROM (SELECT {g}, {f}, count(*) AS n FROM raw WHERE {f} IS NOT NULL GROUP BY ALL) x GROUP BY {g}) m ON m.{g} = r.{g} WHERE r.{f} IS NULL""" for f, g in _RECOVERED), treatments.TREATED_SQL)  # fmt: skip
def recoveries(spark, sf_dir) -> DataFrame:
    """Missing categories by item, cities and educations by client, with what their group holds."""
    rows = tables.stored(treatments.raw(spark, sf_dir))
    return checks.union([treat.recover(rows, "row_id", f, g).select("row_id", F.lit(f).alias("field"), F.lit(g).alias("by_group"), "candidate", "support", "recovery") for f, g in _RECOVERED])


@query("v7_decision_summary", f"SELECT field, action, confidence, {big('count(*)')} AS rules, {big('sum(cases)')} AS cases FROM (" + " UNION ALL ".join(f"SELECT '{t[1]}' AS field, '{t[4]}' AS action, '{t[5]}' AS confidence, {treatments._COUNTED[t[7]]} AS cases FROM told WHERE {t[6]}" for t in R.TREATMENTS) + ") x GROUP BY ALL", treatments.TREATED_SQL)
def decision_summary(spark, sf_dir) -> DataFrame:
    """What is decided for each field, over all analyses: rules and cases by action and confidence."""
    return R.full_matrix(treatments.asked(spark, sf_dir)).groupBy("field", "action", "confidence").agg(F.count("*").alias("rules"), F.sum("cases").alias("cases"))


_MINUTES = "(TRY_CAST(split_part(bought_at, ':', 1) AS INT) * 60 + TRY_CAST(split_part(bought_at, ':', 2) AS INT))"


@query("sf7_order_timestamps", f"SELECT row_id, CASE WHEN TRY_CAST(split_part(bought_at, ':', 1) AS INT) < 24 THEN CAST({_READ['bought_on']} AS TIMESTAMP) + to_minutes({_MINUTES}) END AS bought FROM bronze")
def order_timestamps(spark, sf_dir) -> DataFrame:
    """Date and time of day as one timestamp; null where either does not read."""
    day, minute = T.date(F.col("bought_on")), T.time_of_day(F.col("bought_at"))
    return bronze(spark, sf_dir).select("row_id", F.try_add(day.cast("timestamp"), F.make_dt_interval(mins=minute)).alias("bought"))


@query("o_contract_cast", f"""SELECT row_id, TRY_CAST(order_id AS BIGINT) AS order_id, TRY_CAST(age AS TINYINT) AS age, CAST({_READ['amount']} AS DECIMAL(19,6)) AS amount, {_READ['bought_on']} AS bought_on,
  CASE WHEN TRY_CAST(split_part(bought_at, ':', 1) AS INT) < 24 THEN CAST({_MINUTES} AS INT) END AS minute_of_day, payment FROM bronze""")
def contract_cast(spark, sf_dir) -> DataFrame:
    """Raw text by the types of a contract."""
    kinds = {"order_id": ("order_id", "int64"), "age": ("age", "int8"), "amount": ("amount", "float64"), "bought_on": ("bought_on", "date"), "minute_of_day": ("bought_at", "time"), "payment": ("payment", "string")}
    return bronze(spark, sf_dir).select("row_id", *[T.typed(F.col(c), k).alias(n) for n, (c, k) in kinds.items()])


_RESULTS = {"payments": ("payment", "coupon"), "cities": ("city",), "prices": ("amount", "bought_on")}
_RESULT_SQL = "SELECT '{0}' AS result, CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER ({2}), 0) AS BIGINT) AS rows_with_null, CAST(sum(n) - count(*) AS BIGINT) AS duplicates FROM (SELECT {1}, count(*) AS n FROM bronze GROUP BY ALL) x"


@query("io11_exported_results", " UNION ALL ".join(_RESULT_SQL.format(n, ", ".join(cs), " OR ".join(f"{c} IS NULL" for c in cs)) for n, cs in _RESULTS.items()))
def exported_results(spark, sf_dir) -> DataFrame:
    """Named results written out and read back: rows, rows with nulls and repeated rows of each."""
    b = bronze(spark, sf_dir)
    return tables.exported({n: b.select(*cs) for n, cs in _RESULTS.items()}, tables.scratch(spark)).drop("content_hash")


star = Registry(warehouse.WAREHOUSE_SQL)
_MEASURES = ("line_count", "units", "products", "gross", "discount", "net", "cost", "margin")


@star("d9_full_order_fact", f"""SELECT f.order_id, {', '.join(f'f.{k}' for k in warehouse._ORDER_KEYS)}, o.line_count, o.products, {', '.join(f'CAST(o.{m} AS DOUBLE) AS {m}' for m in _MEASURES if m not in ('line_count', 'products'))}, CAST(o.discount AS DOUBLE) / nullif(CAST(o.gross AS DOUBLE), 0) AS weighted_discount,
  CAST(o.margin AS DOUBLE) / nullif(CAST(o.net AS DOUBLE), 0) AS margin_pct, coalesce(o.coupon, 'Nao informado') AS coupon_status, o.campaign <> 'Sem campanha' AS with_campaign FROM f_order f JOIN full_order o ON o.order_id = f.order_id""")
def full_order_fact(spark, sf_dir) -> DataFrame:
    """Orders with all keys, sums, weighted discount, coupon status and campaign flag."""
    context = tables.stored(order_context(spark, sf_dir))
    keys = warehouse.order_keys(context, warehouse.dimensions(spark, sf_dir, context)).select("order_id", *warehouse._ORDER_KEYS)
    money = [F.col(m).cast("double").alias(m) if m not in ("line_count", "products") else F.col(m) for m in _MEASURES]
    more = [T.ratio(F.col("discount"), F.col("gross")).alias("weighted_discount"), T.ratio(F.col("margin"), F.col("net")).alias("margin_pct"), F.coalesce("coupon", F.lit("Nao informado")).alias("coupon_status"), (F.col("campaign") != "Sem campanha").alias("with_campaign")]
    return keys.join(context.select("order_id", *money, *more), "order_id")


@star("d10_delivery_with_order", """SELECT order_id, carrier, promised, actual, actual - promised AS diff, CASE WHEN actual > promised THEN actual - promised ELSE 0 END AS late_days, CASE WHEN actual < promised THEN promised - actual ELSE 0 END AS early_days,
  status, late_flag, rating, CAST(freight AS DOUBLE) AS freight, CAST(net AS DOUBLE) AS order_net, CAST(units AS DOUBLE) AS order_units FROM delivery""")
def delivery_with_order(spark, sf_dir) -> DataFrame:
    """Deliveries with differences clipped at zero either way, and the order's value and units beside them."""
    d, diff = order_context(spark, sf_dir), F.col("actual") - F.col("promised")
    money = [F.col(c).cast("double").alias(n) for c, n in (("freight", "freight"), ("net", "order_net"), ("units", "order_units"))]
    return d.select("order_id", "carrier", "promised", "actual", diff.alias("diff"), T.clip_low(diff).alias("late_days"), T.clip_low(-diff).alias("early_days"), "status", "late_flag", "rating", *money)


def mapped_geography(states: DataFrame) -> DataFrame:
    """The distinct units of a column `state` with region and country; a unit without a region fails the query."""
    units = states.select(silver.unit(F.col("state")).alias("state")).filter("state IS NOT NULL").distinct()
    told = F.raise_error(F.concat(F.lit("no region for "), F.col("state"))).cast("string")
    return units.withColumn("region", F.coalesce(silver.region(F.col("state")), told)).withColumn("country", F.lit("Brasil"))


@query("d4_mapped_geography", """SELECT DISTINCT state, CASE WHEN state IN ('SP', 'RJ', 'MG') THEN 'Sudeste' ELSE 'Nordeste' END AS region, 'Brasil' AS country
  FROM (SELECT CASE state WHEN 'São Paulo' THEN 'SP' WHEN 'Rio de  Janeiro' THEN 'RJ' WHEN 'Bahia' THEN 'BA' ELSE upper(state) END AS state FROM line WHERE state <> 'zz') x""", LINES_SQL)
def geography(spark, sf_dir) -> DataFrame:
    """The units of order lines with their region, but for the one that the source is known to make up."""
    return mapped_geography(lines(spark, sf_dir).filter("state <> 'zz'"))


_EXPECTED = {"dim_client": "customer", "fact_item": "lineitem"}


@star("g2_star_volumes", " UNION ALL ".join(f"SELECT '{t}' AS table_name, {big('count(*)')} AS rows, " + (f"{big(f'(SELECT count(*) FROM {_EXPECTED[t]})')}" if t in _EXPECTED else big(1440) if t == "dim_time" else "CAST(NULL AS BIGINT)")
    + " AS expected, " + (f"CASE WHEN count(*) = (SELECT count(*) FROM {_EXPECTED[t]}) THEN 'APROVADO' ELSE 'REPROVADO' END" if t in _EXPECTED else "CASE WHEN count(*) = 1440 THEN 'APROVADO' ELSE 'REPROVADO' END" if t == "dim_time" else "'INFORMATIVO'") + f" AS status FROM {warehouse._TABLE_SQL[t]}" for t in warehouse.SPECIFIED))
def star_volumes(spark, sf_dir) -> DataFrame:
    """Rows of the fourteen tables beside what is expected of them, where something is."""
    dims, facts = warehouse.built(spark, sf_dir)
    made = {f"dim_{n}": df for n, df in dims.items()} | {f"fact_{n}": df for n, df in facts.items()}
    parts = []
    for name in warehouse.SPECIFIED:
        source = spark.range(1440) if name == "dim_time" else read(spark, sf_dir, _EXPECTED[name]) if name in _EXPECTED else None
        rows = made[name].agg(F.count("*").alias("rows")).withColumn("table_name", F.lit(name))
        if source is None:
            rows = rows.withColumns({"expected": F.lit(None).cast("bigint"), "status": F.lit("INFORMATIVO")})
        else:
            rows = rows.crossJoin(source.agg(F.count("*").alias("expected"))).withColumn("status", F.when(F.col("rows") == F.col("expected"), "APROVADO").otherwise("REPROVADO"))  # one row each
        parts.append(rows)
    return checks.union(parts)


@star("g5_dimension_grain", " UNION ALL ".join(f"SELECT '{d}' AS table_name, {big('count(*)')} AS rows, {big('count(DISTINCT k)')} AS keys, {big('count(k) - count(DISTINCT k)')} AS duplicate_groups, {big('count(*) - count(k)')} AS null_keys, CASE WHEN count(*) = count(DISTINCT k) THEN 'APROVADO' ELSE 'REPROVADO' END AS status FROM ({q}) t" for d, q in warehouse._DIM_SQL.items()))
def dimension_grain(spark, sf_dir) -> DataFrame:
    """The ten dimensions at their grain: repeated and null keys."""
    dims, _ = warehouse.built(spark, sf_dir)
    return checks.grain_checks({d: (df, (f"{d}_sk",)) for d, df in dims.items()})


@star("g17_required_objects", " UNION ALL ".join(f"SELECT 'star_{t}' AS object, true AS present, {big('count(*)')} AS rows FROM {warehouse._FACT_SQL[t]}" for t in warehouse._FACT_SQL) + " UNION ALL SELECT 'star_missing', false, CAST(NULL AS BIGINT) FROM ord HAVING count(*) > 0")
def required_objects(spark, sf_dir) -> DataFrame:
    """Whether the views that reports need are there, with their rows; one of those asked for is not."""
    facts = warehouse.built(spark, sf_dir)[1]
    for name, df in facts.items():
        df.createOrReplaceTempView(f"star_{name}")
    return tables.present(spark, [*[f"star_{n}" for n in facts], "star_missing"])


@star("io15_last_load", " UNION ALL ".join(f"SELECT '{t}' AS table_name, {big('count(*)')} AS source_rows, {big('count(*)')} AS target_rows, 'APROVADO' AS status FROM {q}" for t, q in (("order", "f_order"), ("client_month", "f_client_month"))))
def last_load(spark, sf_dir) -> DataFrame:
    """The last approved load, of several, against what it was made from, table by table; a later load that failed
    does not count."""
    facts = {k: v for k, v in warehouse.built(spark, sf_dir)[1].items() if k in ("order", "client_month")}
    root = tables.scratch(spark)
    few = {n: (lambda df=df: df.limit(5)) for n, df in facts.items()}
    loading.full_refresh(spark, few, root, "first")
    loading.full_refresh(spark, {n: (lambda df=df: df) for n, df in facts.items()}, root, "second")
    try:
        loading.full_refresh(spark, few, root, "third", check=lambda name, df: name != "client_month")
    except ValueError:
        pass  # it is on record as failed
    last = loading.last_approved(spark.read.schema(loading.AUDIT).parquet(f"{root}/audit"))
    run = last.select("run_id").distinct().first()[0]
    return tables.reconcile(facts, {n: spark.read.parquet(f"{root}/{run}/{n}") for n in facts})


QUERIES |= star.queries
ORACLE |= star.oracle
