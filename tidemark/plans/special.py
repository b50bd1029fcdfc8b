"""Analytical queries that need more than one grouping of one fact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ordering
from tidemark.operators.ordering import quantiles
from tidemark.sources.commerce import STAR_SQL, client, delivery, item, order
from tidemark.sources.tables import stored

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None, star: bool = True):
    """Register a query under a name with its oracle."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = f"WITH {STAR_SQL}, {sql.strip()[5:]}" if star and sql.strip().startswith("WITH ") else f"WITH {STAR_SQL} {sql}" if star else sql
        return f

    return put


def dbl(e: str, name: str) -> Column:
    return F.expr(e).cast("double").alias(name)


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def by_client(spark, sf_dir) -> DataFrame:
    """One row per client with orders."""
    return order(spark, sf_dir).groupBy("client_id").agg(
        F.count("*").alias("orders"), dbl("sum(net)", "net"), dbl("sum(margin)", "margin"), dbl("sum(units)", "units"), F.min("order_date").alias("first_date"), F.max("order_date").alias("last_date"), F.countDistinct("order_date").alias("purchase_days")
    )


BY_CLIENT = """per_client AS (SELECT client_id, CAST(count(*) AS BIGINT) AS orders, CAST(sum(net) AS DOUBLE) AS net, CAST(sum(margin) AS DOUBLE) AS margin,
  CAST(sum(units) AS DOUBLE) AS units, min(order_date) AS first_date, max(order_date) AS last_date, CAST(count(DISTINCT order_date) AS BIGINT) AS purchase_days FROM ord GROUP BY client_id)"""

#: Numeric and text variables that are described, by table.
NUMERIC = {
    "item": ("qty", "gross", "discount", "net", "cost", "margin"),
    "ord": ("line_count", "units", "products", "gross", "discount", "net", "cost", "margin", "minute_of_day"),
    "delivery": ("promised", "actual", "diff", "late_days", "early_days", "rating", "freight"),
    "client": ("age", "income"),
}
TEXT = {
    "ord": ("payment", "channel", "campaign", "external_event", "coupon", "time_band"),
    "delivery": ("status", "carrier", "region", "city", "late_flag", "free_shipping"),
    "client": ("gender", "education", "region", "city"),
    "item": ("category",),
}
TABLES = {"item": item, "ord": order, "delivery": delivery, "client": client}


def _long(spark, sf_dir, columns: dict, kind: str) -> DataFrame:
    """(unit, variable, value) of the given columns of each table."""
    parts = []
    for table, names in columns.items():
        wide = TABLES[table](spark, sf_dir).select(F.lit(table).alias("unit"), *[F.col(n).cast(kind).alias(n) for n in names])
        parts.append(wide.unpivot("unit", list(names), "variable", "value"))
    return reduce(DataFrame.unionByName, parts)


def _numbered(spark, sf_dir, columns: dict) -> DataFrame:
    """(variable, value): the given numeric columns of each table, told apart by their place in the list,
    since numbers are grouped and put in order much faster than names."""
    parts, before = [], 0
    for table, names in columns.items():
        each = F.posexplode(F.array(*[F.col(n).cast("double") for n in names])).alias("place", "value")
        parts.append(TABLES[table](spark, sf_dir).select(each).select((F.col("place") + before).alias("variable"), "value"))
        before += len(names)
    return reduce(DataFrame.unionByName, parts)


def _named(place: Column, columns: dict) -> dict[str, Column]:
    """Table and name of a variable by its place."""
    pairs = [(t, n) for t, names in columns.items() for n in names]
    return {c: F.element_at(F.array(*[F.lit(p[i]) for p in pairs]), place + 1) for i, c in enumerate(("unit", "variable"))}


def _long_sql(columns: dict, kind: str) -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS unit, '{n}' AS variable, CAST({n} AS {kind}) AS value FROM {t}" for t, names in columns.items() for n in names)


# The percentiles shown.
PERCENTILES = {"p01": 0.01, "p05": 0.05, "p10": 0.1, "q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
_CUTS_SQL = ", ".join(f"quantile_cont(value, {p}) AS {n}" for n, p in PERCENTILES.items())


@query("e02a_univariate", f"""WITH long AS ({_long_sql(NUMERIC, 'DOUBLE')}),
st AS (SELECT unit, variable, CAST(count(*) AS BIGINT) AS n, CAST(count(value) AS BIGINT) AS valid, min(value) AS lowest, max(value) AS highest, avg(value) AS mean,
  stddev_samp(value) AS std, {_CUTS_SQL} FROM long GROUP BY unit, variable),
fr AS (SELECT unit, variable, value, count(*) AS k FROM long WHERE value IS NOT NULL GROUP BY ALL),
mo AS (SELECT unit, variable, value AS mode FROM fr QUALIFY row_number() OVER (PARTITION BY unit, variable ORDER BY k DESC, value) = 1),
ou AS (SELECT l.unit, l.variable, CAST(count(CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) THEN 1 END) AS BIGINT) AS outliers FROM long l JOIN st ON l.unit = st.unit AND l.variable = st.variable GROUP BY l.unit, l.variable)
SELECT st.unit, st.variable, n, valid, n - valid AS missing, lowest, highest, round(highest - lowest, 4) AS spread, round(mean, 4) AS mean, round(std, 4) AS std,
  CASE WHEN mean <> 0 THEN round(100.0e0 * std / mean, 4) END AS cv_pct, {", ".join(f"round({n}, 6) AS {n}" for n in PERCENTILES)}, mode, round(q3 - q1, 6) AS iqr,
  round(q1 - 1.5 * (q3 - q1), 8) AS fence_low, round(q3 + 1.5 * (q3 - q1), 8) AS fence_high, outliers, round(100.0e0 * outliers / valid, 4) AS outlier_pct,
  CASE WHEN q3 - q1 = 0 THEN 'NAO_APLICAVEL' ELSE 'APLICAVEL' END AS iqr_rule
FROM st JOIN mo ON st.unit = mo.unit AND st.variable = mo.variable JOIN ou ON st.unit = ou.unit AND st.variable = ou.variable""")
def univariate(spark, sf_dir) -> DataFrame:
    """All statistics come from one table of distinct values with their counts, written once."""
    key = ["variable"]
    often = stored(_numbered(spark, sf_dir, NUMERIC).groupBy(*key, "value").agg(F.count("*").alias("count")))
    known = often.dropna(subset=["value"])
    weight = F.col("count") * F.col("value")
    sizes = often.groupBy(*key).agg(F.sum("count").alias("n"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("count"))), F.lit(0)).alias("valid"))
    stats = known.groupBy(*key).agg(F.min("value").alias("lowest"), F.max("value").alias("highest"), (F.sum(weight) / F.sum("count")).alias("mean"), F.max("count").alias("most"))
    # the mode in a second pass: numbers are aggregated by hash, pairs of them would be sorted
    mode = known.join(stats.select(*key, "most"), key).filter(F.col("count") == F.col("most")).groupBy(*key).agg(F.min("value").alias("mode"))
    stats = sizes.join(stats.drop("most"), key).join(mode, key).join(quantiles(known, key, "value", "count", PERCENTILES), key).withColumn("iqr", F.col("q3") - F.col("q1"))
    stats = stored(stats.withColumns({"fence_low": F.col("q1") - 1.5 * F.col("iqr"), "fence_high": F.col("q3") + 1.5 * F.col("iqr")}))
    far = (F.col("value") < F.col("fence_low")) | (F.col("value") > F.col("fence_high"))
    std = F.sqrt(F.sum(F.col("count") * (F.col("value") - F.col("mean")) ** 2) / F.nullif(F.sum("count") - 1, F.lit(0)))
    rest = known.join(stats.select(*key, "mean", "fence_low", "fence_high"), key).groupBy(*key).agg(std.alias("std"), F.sum(F.when(far, F.col("count")).otherwise(0)).alias("outliers"))
    out = stats.join(rest, key).withColumns({
        "missing": F.col("n") - F.col("valid"), "spread": F.round(F.col("highest") - F.col("lowest"), 4),
        "cv_pct": F.when(F.col("mean") != 0, F.round(100 * F.col("std") / F.col("mean"), 4)), "outlier_pct": F.round(100 * F.col("outliers") / F.col("valid"), 4),
        "iqr_rule": F.when(F.col("iqr") == 0, "NAO_APLICAVEL").otherwise("APLICAVEL"),
    })
    return out.withColumns({c: F.round(c, 6) for c in (*PERCENTILES, "iqr")} | {c: F.round(c, 8) for c in ("fence_low", "fence_high")} | {c: F.round(c, 4) for c in ("mean", "std")} | _named(F.col("variable"), NUMERIC))


@query("e02b_category_frequency", f"""WITH long AS ({_long_sql(TEXT, 'VARCHAR')}), fr AS (SELECT unit, variable, coalesce(nullif(trim(value), ''), '[NULO]') AS value, CAST(count(*) AS BIGINT) AS n FROM long GROUP BY ALL)
SELECT *, n * 1.0e0 / sum(n) OVER (PARTITION BY unit, variable) AS share, CAST(dense_rank() OVER (PARTITION BY unit, variable ORDER BY n DESC) AS INT) AS place, value <> '[NULO]' AS filled FROM fr""")
def category_frequency(spark, sf_dir) -> DataFrame:
    long = _long(spark, sf_dir, TEXT, "string")
    n = long.groupBy("unit", "variable", F.coalesce(F.nullif(F.trim("value"), F.lit("")), F.lit("[NULO]")).alias("value")).agg(F.count("*").alias("n"))
    of = Window.partitionBy("unit", "variable")
    return n.withColumn("share", F.col("n") / F.sum("n").over(of)).withColumn("place", F.dense_rank().over(of.orderBy(F.desc("n")))).withColumn("filled", F.col("value") != "[NULO]")


@query("e02c_category_modes", f"""WITH long AS ({_long_sql(TEXT, 'VARCHAR')}), fr AS (SELECT unit, variable, value, CAST(count(*) AS BIGINT) AS n FROM long WHERE value IS NOT NULL GROUP BY ALL)
SELECT unit, variable, value, n FROM fr QUALIFY dense_rank() OVER (PARTITION BY unit, variable ORDER BY n DESC) = 1""")
def category_modes(spark, sf_dir) -> DataFrame:
    n = _long(spark, sf_dir, TEXT, "string").dropna(subset=["value"]).groupBy("unit", "variable", "value").agg(F.count("*").alias("n"))
    top = n.groupBy("unit", "variable").agg(F.max("n").alias("n"))
    return n.join(top, ["unit", "variable", "n"]).select("unit", "variable", "value", "n")


def coverage(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Filled share of each column, classified. One pass over df."""
    one = df.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in names])
    long = one.unpivot("n", list(names), "variable", "filled")
    share = F.col("filled") / F.col("n")
    return long.withColumn("share", share).withColumn("coverage", F.when(share >= 0.95, "ALTA").when(share >= 0.8, "MODERADA").otherwise("BAIXA")).withColumn("availability", F.when(F.col("filled") > 0, "DISPONIVEL").otherwise("INDISPONIVEL"))


def coverage_sql(table: str, names: tuple[str, ...]) -> str:
    parts = " UNION ALL ".join(f"SELECT CAST(count(*) AS BIGINT) AS n, '{c}' AS variable, CAST(count({c}) AS BIGINT) AS filled FROM {table}" for c in names)
    return f"SELECT *, filled * 1.0e0 / n AS share, CASE WHEN filled * 1.0e0 / n >= 0.95 THEN 'ALTA' WHEN filled * 1.0e0 / n >= 0.8 THEN 'MODERADA' ELSE 'BAIXA' END AS coverage, CASE WHEN filled > 0 THEN 'DISPONIVEL' ELSE 'INDISPONIVEL' END AS availability FROM ({parts}) x"


for _name, _table, _cols in (("e03b_client_completeness", "client", ("gender", "age", "income", "education", "city", "region")), ("e09m_marketing_coverage", "ord", ("payment", "channel", "campaign", "external_event", "coupon")), ("e10m_logistics_coverage", "delivery", ("carrier", "promised", "actual", "late_flag", "rating", "freight", "free_shipping"))):
    query(_name, coverage_sql(_table, _cols))(lambda spark, sf_dir, t=_table, c=_cols: coverage(TABLES[t](spark, sf_dir), c))


_RESULT = ("payment", "campaign", "channel", "external_event", "coupon")
_RESULT_SQL = " UNION ALL ".join(f"SELECT '{a}' AS attribute, {a} AS value, client_id, net, gross, discount, margin, units FROM ord" for a in _RESULT)


@query("e03h_attributes_by_result", f"""WITH long AS ({_RESULT_SQL})
SELECT attribute, value, CAST(count(*) AS BIGINT) AS orders, CAST(count(DISTINCT client_id) AS BIGINT) AS clients, CAST(sum(net) AS DOUBLE) AS net,
  CAST(sum(net) AS DOUBLE) / count(*) AS ticket, CAST(sum(units) AS DOUBLE) / count(*) AS items_per_order,
  CAST(sum(discount) AS DOUBLE) / nullif(CAST(sum(gross) AS DOUBLE), 0) AS discount_pct, CAST(sum(margin) AS DOUBLE) / nullif(CAST(sum(net) AS DOUBLE), 0) AS margin_pct
FROM long GROUP BY attribute, value""")
def attributes_by_result(spark, sf_dir) -> DataFrame:
    """Orders by one marketing attribute at a time. Orders are grouped by client first, so that counting
    clients moves one row per client and value."""
    sums = ["net", "gross", "discount", "margin", "units"]
    long = order(spark, sf_dir).select("client_id", *sums, *_RESULT).unpivot(["client_id", *sums], list(_RESULT), "attribute", "value")
    of_client = long.groupBy("attribute", "value", "client_id").agg(F.count("*").alias("orders"), *[F.sum(c).alias(c) for c in sums])
    total = {c: F.sum(c) for c in ("orders", *sums)}
    return of_client.groupBy("attribute", "value").agg(
        total["orders"].alias("orders"), F.count("client_id").alias("clients"), total["net"].cast("double").alias("net"),
        div(total["net"], total["orders"]).alias("ticket"), div(total["units"], total["orders"]).alias("items_per_order"),
        div(total["discount"], total["gross"]).alias("discount_pct"), div(total["margin"], total["net"]).alias("margin_pct"),
    )


PAIRS = (("orders", "net"), ("orders", "units"), ("net", "margin"), ("units", "net"), ("age", "net"), ("income", "net"))


@query("e03j_correlations", f"""WITH {BY_CLIENT}, b AS (SELECT * FROM per_client JOIN client USING (client_id)),
r AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM b WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in PAIRS)})
SELECT *, CASE WHEN abs(r) < 0.1 THEN 'DESPREZIVEL' WHEN abs(r) < 0.3 THEN 'FRACA' WHEN abs(r) < 0.5 THEN 'MODERADA' ELSE 'FORTE' END AS strength, CASE WHEN r < 0 THEN 'NEGATIVA' WHEN r > 0 THEN 'POSITIVA' ELSE 'NULA' END AS direction FROM r""")
def correlations(spark, sf_dir) -> DataFrame:
    b = by_client(spark, sf_dir).join(client(spark, sf_dir), "client_id")
    pairs = F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for x, y in PAIRS])
    r = b.select(F.explode(pairs).alias("p")).select("p.*").dropna().groupBy("a", "b").agg(F.round(F.corr("x", "y"), 6).alias("r"))
    size = F.abs("r")
    return r.withColumn("strength", F.when(size < 0.1, "DESPREZIVEL").when(size < 0.3, "FRACA").when(size < 0.5, "MODERADA").otherwise("FORTE")).withColumn("direction", F.when(F.col("r") < 0, "NEGATIVA").when(F.col("r") > 0, "POSITIVA").otherwise("NULA"))


@query("e04h_fragmentation", """WITH s AS (SELECT 'perfil' AS scheme, concat_ws('|', gender, education, region) AS k FROM client UNION ALL SELECT 'local', concat_ws('|', region, city) FROM client), g AS (SELECT scheme, k, count(*) AS n FROM s GROUP BY scheme, k)
SELECT scheme, CAST(count(*) AS BIGINT) AS segments, CAST(sum(n) AS DOUBLE) / count(*) AS mean_size, CAST(min(n) AS BIGINT) AS smallest, CAST(count(CASE WHEN n < 10 THEN 1 END) AS BIGINT) AS small_segments FROM g GROUP BY scheme""")
def fragmentation(spark, sf_dir) -> DataFrame:
    c = client(spark, sf_dir)
    keys = F.explode(F.array(F.struct(F.lit("perfil").alias("scheme"), F.concat_ws("|", "gender", "education", "region").alias("k")), F.struct(F.lit("local").alias("scheme"), F.concat_ws("|", "region", "city").alias("k"))))
    g = c.select(keys.alias("s")).groupBy("s.scheme", "s.k").agg(F.count("*").alias("n"))
    return g.groupBy("scheme").agg(F.count("*").alias("segments"), div(F.sum("n"), F.count("*")).alias("mean_size"), F.min("n").alias("smallest"), F.count_if(F.col("n") < 10).alias("small_segments"))


FEATURES = ("orders", "net", "margin", "units", "purchase_days")


@query("e04i_z_scores", f"""WITH {BY_CLIENT}, m AS (SELECT {", ".join(f"avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}" for f in FEATURES)} FROM per_client)
SELECT client_id, {", ".join(f"round(({f} - m_{f}) / nullif(s_{f}, 0), 5) AS z_{f}" for f in FEATURES)} FROM per_client, m""")
def z_scores(spark, sf_dir) -> DataFrame:
    b = by_client(spark, sf_dir)
    one = b.agg(*[F.avg(f).alias(f"m_{f}") for f in FEATURES], *[F.stddev_samp(f).alias(f"s_{f}") for f in FEATURES])
    both = b.crossJoin(F.broadcast(one))  # one row
    return both.select("client_id", *[F.round(F.try_divide(F.col(f) - F.col(f"m_{f}"), F.col(f"s_{f}")), 5).alias(f"z_{f}") for f in FEATURES])


@query("e05_client_profile", f"""WITH {BY_CLIENT}, cat AS (SELECT client_id, category, count(DISTINCT order_id) AS o, sum(qty) AS q, sum(net) AS v FROM item GROUP BY client_id, category),
fav AS (SELECT client_id, category AS favourite FROM cat QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY o DESC, q DESC, v DESC, category) = 1),
dv AS (SELECT client_id, CAST(sum(late_days) AS BIGINT) AS late_days, CAST(sum(rating) AS DOUBLE) / nullif(count(rating), 0) AS mean_rating, CAST(count(CASE WHEN status = 'Atrasado' THEN 1 END) AS DOUBLE) / count(*) AS late_rate FROM delivery GROUP BY client_id)
SELECT c.client_id, client_name, region, orders, net, margin, units, first_date, last_date, favourite, late_days, mean_rating, late_rate, CAST(date_diff('day', last_date, DATE '2001-12-31') AS INT) AS recency
FROM client c LEFT JOIN per_client USING (client_id) LEFT JOIN fav USING (client_id) LEFT JOIN dv USING (client_id)""")
def client_profile(spark, sf_dir, as_of: str = "2001-12-31") -> DataFrame:
    """Each fact is brought to one row per client before joining."""
    cat = item(spark, sf_dir).groupBy("client_id", "category").agg(F.countDistinct("order_id").alias("o"), F.sum("qty").alias("q"), F.sum("net").alias("v"))
    fav = cat.groupBy("client_id").agg(F.min_by("category", F.struct(-F.col("o"), -F.col("q"), -F.col("v"), F.col("category"))).alias("favourite"))
    dv = delivery(spark, sf_dir).groupBy("client_id").agg(F.sum("late_days").alias("late_days"), div(F.sum("rating"), F.count("rating")).alias("mean_rating"), div(F.count_if(F.col("status") == "Atrasado"), F.count("*")).alias("late_rate"))
    base = client(spark, sf_dir).select("client_id", "client_name", "region").join(by_client(spark, sf_dir).drop("purchase_days"), "client_id", "left")
    return base.join(fav, "client_id", "left").join(dv, "client_id", "left").withColumn("recency", F.datediff(F.lit(as_of).cast("date"), "last_date"))


DATASET_SQL = f"""WITH {BY_CLIENT}, ds AS (SELECT c.client_id, age, income, coalesce(orders, 0) AS orders, net, CASE WHEN income = 0 THEN 1 ELSE 0 END AS zero_income,
  CASE WHEN purchase_days > 1 THEN CAST(date_diff('day', first_date, last_date) AS DOUBLE) / (purchase_days - 1) END AS mean_interval, CASE WHEN coalesce(purchase_days, 0) < 2 THEN 1 ELSE 0 END AS interval_missing,
  CASE WHEN orders IS NULL THEN 'SEM_COMPRA' WHEN income IS NULL THEN 'PARCIAL' ELSE 'ELEGIVEL' END AS eligibility FROM client c LEFT JOIN per_client USING (client_id))"""


def dataset(spark, sf_dir) -> DataFrame:
    c = client(spark, sf_dir).select("client_id", "age", "income").join(by_client(spark, sf_dir), "client_id", "left")
    many = F.col("purchase_days") > 1
    return c.select(
        "client_id", "age", "income", F.coalesce("orders", F.lit(0)).alias("orders"), "net", F.when(F.col("income") == 0, 1).otherwise(0).alias("zero_income"),
        F.when(many, F.datediff("last_date", "first_date").cast("double") / (F.col("purchase_days") - 1)).alias("mean_interval"), F.when(F.coalesce(many, F.lit(False)), 0).otherwise(1).alias("interval_missing"),
        F.when(F.col("orders").isNull(), "SEM_COMPRA").when(F.col("income").isNull(), "PARCIAL").otherwise("ELEGIVEL").alias("eligibility"),
    )


query("e06a_segmentation_dataset", DATASET_SQL + " SELECT * FROM ds")(dataset)
query("e06b_coverage", DATASET_SQL + ", u AS (" + coverage_sql("ds", ("age", "income", "net", "mean_interval")) + ") SELECT * FROM u")(lambda s, d: coverage(dataset(s, d), ("age", "income", "net", "mean_interval")))


@query("e06c_eligibility", DATASET_SQL + " SELECT eligibility, CAST(count(*) AS BIGINT) AS clients, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM ds GROUP BY eligibility")
def eligibility(spark, sf_dir) -> DataFrame:
    n = dataset(spark, sf_dir).groupBy("eligibility").agg(F.count("*").alias("clients"))
    return n.withColumn("share", F.col("clients") / F.sum("clients").over(Window.partitionBy()))  # a row per class


@query("e06d_limitations", DATASET_SQL + " SELECT CAST(count(*) AS BIGINT) AS clients, CAST(count(CASE WHEN income IS NULL THEN 1 END) AS BIGINT) AS no_income, CAST(count(CASE WHEN income < 0 THEN 1 END) AS BIGINT) AS negative_income, CAST(sum(interval_missing) AS BIGINT) AS no_interval, CAST(count(CASE WHEN orders = 0 THEN 1 END) AS BIGINT) AS no_orders FROM ds")
def limitations(spark, sf_dir) -> DataFrame:
    return dataset(spark, sf_dir).agg(F.count("*").alias("clients"), F.count_if(F.col("income").isNull()).alias("no_income"), F.count_if(F.col("income") < 0).alias("negative_income"), F.sum("interval_missing").cast("long").alias("no_interval"), F.count_if(F.col("orders") == 0).alias("no_orders"))


FIRST_SQL = "fm AS (SELECT client_id, min(ym) AS first_ym FROM ord GROUP BY client_id), tagged AS (SELECT o.*, CASE WHEN o.ym = first_ym THEN 'NOVO' ELSE 'RECORRENTE' END AS kind FROM ord o JOIN fm ON o.client_id = fm.client_id)"


def tagged(spark, sf_dir) -> DataFrame:
    """Orders as of new or recurring clients: new in the whole month of the first purchase observed."""
    o = order(spark, sf_dir)
    first = o.groupBy("client_id").agg(F.min("ym").alias("first_ym"))
    return o.join(first, "client_id").withColumn("kind", F.when(F.col("ym") == F.col("first_ym"), "NOVO").otherwise("RECORRENTE"))


@query("e07c_new_recurring", f"""WITH {FIRST_SQL} SELECT ym, CAST(count(DISTINCT client_id) AS BIGINT) AS clients, CAST(count(DISTINCT CASE WHEN kind = 'NOVO' THEN client_id END) AS BIGINT) AS new_clients, CAST(count(DISTINCT CASE WHEN kind = 'RECORRENTE' THEN client_id END) AS BIGINT) AS recurring_clients FROM tagged GROUP BY ym""")
def new_recurring(spark, sf_dir) -> DataFrame:
    of = lambda k: F.countDistinct(F.when(F.col("kind") == k, F.col("client_id")))
    return tagged(spark, sf_dir).groupBy("ym").agg(F.countDistinct("client_id").alias("clients"), of("NOVO").alias("new_clients"), of("RECORRENTE").alias("recurring_clients"))


@query("ac4_new_vs_recurring", f"""WITH {FIRST_SQL} SELECT ym, kind, CAST(count(DISTINCT client_id) AS BIGINT) AS clients, CAST(count(*) AS BIGINT) AS orders, CAST(sum(net) AS DOUBLE) AS net, CAST(sum(margin) AS DOUBLE) AS margin, CAST(sum(net) AS DOUBLE) / count(*) AS ticket FROM tagged GROUP BY ym, kind""")
def new_vs_recurring(spark, sf_dir) -> DataFrame:
    return tagged(spark, sf_dir).groupBy("ym", "kind").agg(F.countDistinct("client_id").alias("clients"), F.count("*").alias("orders"), dbl("sum(net)", "net"), dbl("sum(margin)", "margin"), div(F.sum("net"), F.count("*")).alias("ticket"))


@query("ac5_share_of_recurring", f"""WITH {FIRST_SQL}, g AS (SELECT ym, kind, sum(net) AS n, sum(margin) AS m FROM tagged GROUP BY ym, kind)
SELECT ym, kind, CAST(n AS DOUBLE) AS net, CAST(m AS DOUBLE) AS margin, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY ym) AS DOUBLE) AS net_share, CAST(m AS DOUBLE) / CAST(sum(m) OVER (PARTITION BY ym) AS DOUBLE) AS margin_share FROM g""")
def share_of_recurring(spark, sf_dir) -> DataFrame:
    g = tagged(spark, sf_dir).groupBy("ym", "kind").agg(F.sum("net").alias("n"), F.sum("margin").alias("m"))
    month = Window.partitionBy("ym")
    return g.select("ym", "kind", F.col("n").cast("double").alias("net"), F.col("m").cast("double").alias("margin"), div(F.col("n"), F.sum("n").over(month)).alias("net_share"), div(F.col("m"), F.sum("m").over(month)).alias("margin_share"))


PARETO_SQL = "pc AS (SELECT client_id, sum(net) AS n FROM ord GROUP BY client_id), pr AS (SELECT client_id, n, row_number() OVER w AS place, count(*) OVER () AS clients, sum(n) OVER (ORDER BY n DESC, client_id ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER () AS whole FROM pc WINDOW w AS (ORDER BY n DESC, client_id))"


def pareto(spark, sf_dir) -> DataFrame:
    """Clients by falling revenue with running revenue, in two phases."""
    pc = order(spark, sf_dir).groupBy("client_id").agg(F.sum("net").alias("n"))
    out = ordering.running(pc, [F.desc("n"), F.col("client_id")], {"upto": F.col("n")}, rank="place", total_rows="clients")
    return out.withColumnRenamed("upto_total", "whole")


@query("e07e_pareto_clients", f"""WITH {PARETO_SQL} SELECT client_id, CAST(n AS DOUBLE) AS net, CAST(place AS BIGINT) AS place, CAST(upto AS DOUBLE) / CAST(whole AS DOUBLE) AS net_share_upto, CAST(place AS DOUBLE) / clients AS client_share_upto FROM pr""")
def pareto_clients(spark, sf_dir) -> DataFrame:
    return pareto(spark, sf_dir).select("client_id", F.col("n").cast("double").alias("net"), "place", div(F.col("upto"), F.col("whole")).alias("net_share_upto"), div(F.col("place"), F.col("clients")).alias("client_share_upto"))


@query("e08j_concentration", f"""WITH {PARETO_SQL} SELECT CASE WHEN place * 10 <= clients THEN 'TOP_10' WHEN place * 5 <= clients THEN 'DE_10_A_20' ELSE 'DEMAIS_80' END AS band, CAST(count(*) AS BIGINT) AS clients, CAST(sum(n) AS DOUBLE) AS net, CAST(sum(n) AS DOUBLE) / CAST(max(whole) AS DOUBLE) AS net_share FROM pr GROUP BY 1""")
def concentration(spark, sf_dir) -> DataFrame:
    band = F.when(F.col("place") * 10 <= F.col("clients"), "TOP_10").when(F.col("place") * 5 <= F.col("clients"), "DE_10_A_20").otherwise("DEMAIS_80")
    return pareto(spark, sf_dir).groupBy(band.alias("band")).agg(F.count("*").alias("clients"), dbl("sum(n)", "net"), div(F.sum("n"), F.max("whole")).alias("net_share"))


@query("x5_abc_clients", f"""WITH {PARETO_SQL} SELECT CASE WHEN CAST(upto - n AS DOUBLE) / CAST(whole AS DOUBLE) < 0.8 THEN 'A' WHEN CAST(upto - n AS DOUBLE) / CAST(whole AS DOUBLE) < 0.95 THEN 'B' ELSE 'C' END AS abc, CAST(count(*) AS BIGINT) AS clients, CAST(sum(n) AS DOUBLE) AS net FROM pr GROUP BY 1""")
def abc_clients(spark, sf_dir) -> DataFrame:
    before = div(F.col("upto") - F.col("n"), F.col("whole"))  # who crosses a limit belongs to the band it completes
    return pareto(spark, sf_dir).groupBy(F.when(before < 0.8, "A").when(before < 0.95, "B").otherwise("C").alias("abc")).agg(F.count("*").alias("clients"), dbl("sum(n)", "net"))


@query("e07j_category_pairs", """WITH c AS (SELECT DISTINCT order_id, category FROM item) SELECT a.category AS first_category, b.category AS second_category, CAST(count(*) AS BIGINT) AS orders FROM c a JOIN c b ON a.order_id = b.order_id AND a.category < b.category GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20""")
def category_pairs(spark, sf_dir) -> DataFrame:
    """Pairs within an order's distinct categories, without a self join."""
    held = item(spark, sf_dir).groupBy("order_id").agg(F.sort_array(F.collect_set("category")).alias("c"))  # at most as many as there are categories
    pairs = F.flatten(F.transform("c", lambda x, i: F.transform(F.slice("c", i + 2, F.size("c")), lambda y: F.struct(x.alias("first_category"), y.alias("second_category")))))
    return held.select(F.explode(pairs).alias("p")).groupBy("p.first_category", "p.second_category").agg(F.count("*").alias("orders")).orderBy(F.desc("orders"), "first_category", "second_category").limit(20)


METRICS = """CAST(count(DISTINCT o.client_id) AS BIGINT) AS clients, CAST(count(*) AS BIGINT) AS orders, CAST(sum(o.units) AS DOUBLE) AS units, CAST(sum(o.net) AS DOUBLE) AS net, coalesce(CAST(sum(o.net) AS DOUBLE) / nullif(count(*), 0), 0) AS ticket,
  CAST(sum(o.margin) AS DOUBLE) AS margin, CAST(sum(rating) AS DOUBLE) / nullif(count(rating), 0) AS mean_rating, coalesce(CAST(count(CASE WHEN lower(trim(late_flag)) = 'sim' THEN 1 END) AS DOUBLE) / nullif(count(late_flag), 0), 0) AS late_rate"""


def metrics(spark, sf_dir, *by: str) -> DataFrame:
    """The eight canonical measures; zero denominators give 0. Facts are grouped apart, then joined."""
    o = order(spark, sf_dir).groupBy(*by).agg(F.countDistinct("client_id").alias("clients"), F.count("*").alias("orders"), dbl("sum(units)", "units"), dbl("sum(net)", "net"), F.coalesce(div(F.sum("net"), F.count("*")), F.lit(0.0)).alias("ticket"), dbl("sum(margin)", "margin"))
    late = F.count_if(F.lower(F.trim("late_flag")) == "sim")
    d = delivery(spark, sf_dir).groupBy(*by).agg(div(F.sum("rating"), F.count("rating")).alias("mean_rating"), F.coalesce(div(late, F.count("late_flag")), F.lit(0.0)).alias("late_rate"))
    return o.join(d, list(by), "left") if by else o.crossJoin(F.broadcast(d))  # one row each


query("e12b_canonical_metrics", f"SELECT {METRICS} FROM ord o JOIN delivery d ON o.order_id = d.order_id")(metrics)
query("e12c_canonical_monthly", f"SELECT o.ym, {METRICS} FROM ord o JOIN delivery d ON o.order_id = d.order_id GROUP BY o.ym")(lambda s, d: metrics(s, d, "ym"))

_MONTHLY_SQL = "m0 AS (SELECT ym, CAST(count(DISTINCT client_id) AS DOUBLE) AS c, CAST(count(*) AS DOUBLE) / count(DISTINCT client_id) AS f, CAST(sum(net) AS DOUBLE) / count(*) AS t, CAST(sum(net) AS DOUBLE) AS net FROM ord GROUP BY ym), m AS (SELECT *, lag(c) OVER w AS c0, lag(f) OVER w AS f0, lag(t) OVER w AS t0, lag(net) OVER w AS net0 FROM m0 WINDOW w AS (ORDER BY ym))"
_EFFECT = {
    "clients_effect": "(c - c0) * (f0 * t0 / 3 + (f * t0 + f0 * t) / 6 + f * t / 3)",
    "frequency_effect": "(f - f0) * (c0 * t0 / 3 + (c * t0 + c0 * t) / 6 + c * t / 3)",
    "ticket_effect": "(t - t0) * (c0 * f0 / 3 + (c * f0 + c0 * f) / 6 + c * f / 3)",
}


@query("ac2_shapley", f"""WITH {_MONTHLY_SQL} SELECT ym, net, net - net0 AS net_delta, {", ".join(f"round({e}, 4) AS {n}" for n, e in _EFFECT.items())}, abs(net - net0 - ({" + ".join(_EFFECT.values())})) <= 0.01 AS closes FROM m""")
def shapley(spark, sf_dir) -> DataFrame:
    """Revenue = clients x frequency x ticket; each factor's Shapley share of the monthly change, in doubles."""
    m = order(spark, sf_dir).groupBy("ym").agg(F.countDistinct("client_id").cast("double").alias("c"), div(F.count("*"), F.countDistinct("client_id")).alias("f"), div(F.sum("net"), F.count("*")).alias("t"), dbl("sum(net)", "net"))
    w = Window.orderBy("ym")  # a row a month
    m = m.select("*", *[F.lag(x).over(w).alias(f"{x}0") for x in ("c", "f", "t", "net")])
    whole = F.expr(" + ".join(_EFFECT.values()))
    delta = F.col("net") - F.col("net0")
    return m.select("ym", "net", delta.alias("net_delta"), *[F.round(F.expr(e), 4).alias(n) for n, e in _EFFECT.items()], (F.abs(delta - whole) <= 0.01).alias("closes"))


@query("ac9_first_last", """WITH m AS (SELECT ym, CAST(sum(net) AS DOUBLE) AS net, CAST(sum(margin) AS DOUBLE) AS margin, CAST(count(*) AS BIGINT) AS orders FROM ord GROUP BY ym)
SELECT a.ym AS first_ym, b.ym AS last_ym, a.net AS first_net, b.net AS last_net, b.net - a.net AS net_delta, (b.net - a.net) / nullif(a.net, 0) AS net_change, b.margin - a.margin AS margin_delta, b.orders - a.orders AS orders_delta
FROM m a, m b WHERE a.ym = (SELECT min(ym) FROM m) AND b.ym = (SELECT max(ym) FROM m)""")
def first_last(spark, sf_dir) -> DataFrame:
    m = order(spark, sf_dir).groupBy("ym").agg(dbl("sum(net)", "net"), dbl("sum(margin)", "margin"), F.count("*").alias("orders"))
    s = F.struct("ym", "net", "margin", "orders")
    one = m.agg(F.min_by(s, "ym").alias("a"), F.max_by(s, "ym").alias("b"))
    return one.selectExpr("a.ym AS first_ym", "b.ym AS last_ym", "a.net AS first_net", "b.net AS last_net", "b.net - a.net AS net_delta", "(b.net - a.net) / nullif(a.net, 0) AS net_change", "b.margin - a.margin AS margin_delta", "b.orders - a.orders AS orders_delta")


@query("x2_recurrence", f"""WITH {BY_CLIENT} SELECT CAST(count(*) AS BIGINT) AS clients, CAST(count(CASE WHEN orders > 1 THEN 1 END) AS BIGINT) AS recurring, CAST(count(CASE WHEN orders > 1 THEN 1 END) AS DOUBLE) / count(*) AS repurchase_rate,
CAST(sum(date_diff('day', last_date, DATE '2001-12-31')) AS DOUBLE) / count(*) AS mean_recency, round(avg(CASE WHEN purchase_days > 1 THEN CAST(date_diff('day', first_date, last_date) AS DOUBLE) / (purchase_days - 1) END), 6) AS mean_interval FROM per_client""")
def recurrence(spark, sf_dir, as_of: str = "2001-12-31") -> DataFrame:
    again = F.count_if(F.col("orders") > 1)
    gap = F.when(F.col("purchase_days") > 1, F.datediff("last_date", "first_date").cast("double") / (F.col("purchase_days") - 1))
    return by_client(spark, sf_dir).agg(F.count("*").alias("clients"), again.alias("recurring"), div(again, F.count("*")).alias("repurchase_rate"), div(F.sum(F.datediff(F.lit(as_of).cast("date"), "last_date")), F.count("*")).alias("mean_recency"), F.round(F.avg(gap), 6).alias("mean_interval"))


@query("x3_cohort_retention", """WITH f AS (SELECT client_id, min(ym) AS cohort FROM ord GROUP BY client_id)
SELECT cohort, CAST((o.ym // 100 - cohort // 100) * 12 + o.ym % 100 - cohort % 100 AS INT) AS month_no, CAST(count(DISTINCT o.client_id) AS BIGINT) AS clients FROM ord o JOIN f ON o.client_id = f.client_id GROUP BY 1, 2""")
def cohort_retention(spark, sf_dir) -> DataFrame:
    o = order(spark, sf_dir)
    first = o.groupBy("client_id").agg(F.min("ym").alias("cohort"))
    return o.join(first, "client_id").groupBy("cohort", F.expr("CAST((ym DIV 100 - cohort DIV 100) * 12 + ym % 100 - cohort % 100 AS INT)").alias("month_no")).agg(F.countDistinct("client_id").alias("clients"))
