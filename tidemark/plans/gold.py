"""Integrity of the star: reconciliations, keys, mandatory fields, metrics against a second path, coverage,
cardinality and grain; the full calendar and day; all foreign keys; the model's specification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import checks, ordering
from tidemark.sources.commerce import _RATE_SQL, STAR_SQL, client, delivery, item, order, read
from tidemark.sources.lines import LINES_SQL, lines
from tidemark.sources.tables import stored

from .registry import Registry

query = Registry(STAR_SQL)
QUERIES, ORACLE = query.queries, query.oracle

big = lambda e: f"CAST({e} AS BIGINT)"

# Fixed holidays, by month and day.
HOLIDAYS = {"01-01": "Confraternização Universal", "04-21": "Tiradentes", "05-01": "Dia do Trabalho", "09-07": "Independência", "10-12": "Nossa Senhora Aparecida", "11-02": "Finados", "11-15": "Proclamação da República", "12-25": "Natal"}
# Names of months and weekdays.
MONTHS = ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")
WEEKDAYS = ("segunda-feira", "terça-feira", "quarta-feira", "quinta-feira", "sexta-feira", "sábado", "domingo")

_listed = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_DAYS_SQL = """days AS (SELECT CAST(unnest(generate_series((SELECT CAST(min(o_orderdate) AS DATE) FROM orders), (SELECT CAST(max(o_orderdate) AS DATE) FROM orders), INTERVAL 1 DAY)) AS DATE) AS day)"""
_HOLIDAY_SQL = "CASE strftime(day, '%m-%d') " + " ".join(f"WHEN '{d}' THEN '{n}'" for d, n in HOLIDAYS.items()) + " END"


def name_of(i, names):
    """The i-th (from 1) of some names."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), i)


def calendar(spark, sf_dir) -> DataFrame:
    """Every day between the first and the last order, with its parts, names and holiday."""
    span = read(spark, sf_dir, "orders").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("z"))
    days = span.select(F.explode(F.sequence("a", "z")).alias("full_date"))
    special = F.create_map(*[F.lit(x) for kv in HOLIDAYS.items() for x in kv])[F.date_format("full_date", "MM-dd")]
    parts = T.calendar(F.col("full_date"))
    return days.select("full_date", *[v.alias(n) for n, v in parts.items()], name_of(F.month("full_date"), MONTHS).alias("month_name"), name_of(F.weekday("full_date") + 1, WEEKDAYS).alias("weekday_name"), special.alias("special_day"))


@query("d2_calendar", f"""WITH {_DAYS_SQL} SELECT day AS full_date, CAST(strftime(day, '%Y%m%d') AS INT) AS date_sk, CAST(year(day) AS INT) AS year, CAST((month(day) + 5) // 6 AS INT) AS half, CAST(quarter(day) AS INT) AS quarter, CAST(month(day) AS INT) AS month, CAST(weekofyear(day) AS INT) AS iso_week,
  CAST(dayofyear(day) AS INT) AS day_of_year, CAST(day(day) AS INT) AS day, CAST(isodow(day) AS INT) AS weekday, CAST(strftime(day, '%Y%m') AS INT) AS year_month, isodow(day) > 5 AS is_weekend,
  {_listed(MONTHS)}[month(day)] AS month_name, {_listed(WEEKDAYS)}[isodow(day)] AS weekday_name, {_HOLIDAY_SQL} AS special_day FROM days""")
def full_calendar(spark, sf_dir) -> DataFrame:
    return calendar(spark, sf_dir)


def minutes(spark, sf_dir) -> DataFrame:
    """All 1,440 minutes of a day with label, band and the orders placed in them."""
    h, m = F.floor(F.col("id") / 60).cast("int"), (F.col("id") % 60).cast("int")
    band = T.banded(F.col("id"), (("Madrugada", 359), ("Manha", 719), ("Tarde", 1079), ("Noite", None)))
    day = spark.range(1440).select(F.col("id").cast("int").alias("time_sk"), F.format_string("%02d:%02d", h, m).alias("hhmm"), h.alias("hour"), m.alias("minute"), band.alias("band"))
    seen = order(spark, sf_dir).groupBy(F.col("minute_of_day").alias("time_sk")).agg(F.count("*").alias("orders"))
    return day.join(seen, "time_sk", "left").withColumn("orders", F.coalesce("orders", F.lit(0)))


@query("d3_full_day", f"""WITH m AS (SELECT CAST(unnest(generate_series(0, 1439)) AS INT) AS t), c AS (SELECT minute_of_day AS t, count(*) AS n FROM ord GROUP BY 1)
  SELECT m.t AS time_sk, strftime(TIMESTAMP '2000-01-01 00:00:00' + to_minutes(m.t), '%H:%M') AS hhmm, CAST(m.t // 60 AS INT) AS hour, CAST(m.t % 60 AS INT) AS minute,
  CASE WHEN m.t < 360 THEN 'Madrugada' WHEN m.t < 720 THEN 'Manha' WHEN m.t < 1080 THEN 'Tarde' ELSE 'Noite' END AS band, {big('coalesce(n, 0)')} AS orders FROM m LEFT JOIN c ON c.t = m.t""")
def full_day(spark, sf_dir) -> DataFrame:
    return minutes(spark, sf_dir)


_DIMS = ("payment", "channel", "campaign", "external_event", "coupon")
_KEYED = ", ".join(f"k_{d} AS (SELECT {d}, {big('row_number() OVER (ORDER BY ' + d + ')')} AS {d}_sk FROM (SELECT DISTINCT {d} FROM ord WHERE {d} IS NOT NULL) x)" for d in _DIMS)


def small_keys(df: DataFrame, column: str) -> DataFrame:
    """Dense keys of a column with few values: numbered over the grouped values."""
    return df.filter(F.col(column).isNotNull()).select(column).distinct().withColumn(f"{column}_sk", F.row_number().over(Window.orderBy(column)).cast("long"))


def keyed_orders(spark, sf_dir) -> DataFrame:
    """Each order with the keys of all its dimensions. Only the key columns of `orders` are read for the small
    dimensions; their joins are many-to-one by construction (one row a value)."""
    o = order(spark, sf_dir)
    slim = o.select("order_id", "client_id", F.date_format("order_date", "yyyyMMdd").cast("int").alias("date_sk"), F.col("minute_of_day").alias("time_sk"), *_DIMS)
    plain = read(spark, sf_dir, "orders")
    for d in _DIMS:
        from_orders = order_attributes(plain).select(d)
        slim = slim.join(F.broadcast(small_keys(from_orders, d)), d, "left")  # a handful of values each
    place = client(spark, sf_dir).select("client_id", "city", "region")
    keys = ordering.dense_keys(place, ["city", "region"], "geography_sk")
    return slim.join(place, "client_id", "left").join(keys, ["city", "region"], "left").select("order_id", "client_id", "date_sk", "time_sk", "geography_sk", *[f"{d}_sk" for d in _DIMS])


def order_attributes(orders: DataFrame) -> DataFrame:
    """The small dimensions' columns of the orders table."""
    from tidemark.sources.commerce import ORDER_COLS, _cols

    return orders.selectExpr(*_cols(ORDER_COLS))


@query("d7_all_keys", f"""WITH {_KEYED}, g AS (SELECT city, region, {big('row_number() OVER (ORDER BY city, region)')} AS geography_sk FROM (SELECT DISTINCT city, region FROM client) x)
  SELECT order_id, o.client_id, CAST(strftime(order_date, '%Y%m%d') AS INT) AS date_sk, minute_of_day AS time_sk, geography_sk, {', '.join(f'{d}_sk' for d in _DIMS)} FROM ord o
  LEFT JOIN client c ON c.client_id = o.client_id LEFT JOIN g ON g.city = c.city AND g.region = c.region {' '.join(f'LEFT JOIN k_{d} ON k_{d}.{d} = o.{d}' for d in _DIMS)}""")
def all_keys(spark, sf_dir) -> DataFrame:
    return keyed_orders(spark, sf_dir)


@query("d12_client_month_intervals", f"""WITH d AS (SELECT DISTINCT client_id, order_date FROM ord), i AS (SELECT client_id, order_date, date_diff('day', lag(order_date) OVER (PARTITION BY client_id ORDER BY order_date), order_date) AS gap FROM d),
  m AS (SELECT client_id, CAST(date_trunc('month', order_date) AS DATE) AS month_start, sum(gap) AS s, count(gap) AS n, count(*) AS days FROM i GROUP BY ALL)
  SELECT client_id, month_start, {big('sum(days) OVER w')} AS purchase_days, CAST(sum(s) OVER w AS DOUBLE) / nullif(sum(n) OVER w, 0) AS mean_interval, {big('sum(days) OVER w * 10')} AS points, CAST(NULL AS VARCHAR) AS lifecycle
  FROM m WINDOW w AS (PARTITION BY client_id ORDER BY month_start ROWS UNBOUNDED PRECEDING)""")
def client_month_intervals(spark, sf_dir) -> DataFrame:
    """Per client and month with purchases: days of purchase so far, mean days between them, points (ten a day);
    the lifecycle column is reserved and always null."""
    days = order(spark, sf_dir).select("client_id", "order_date").distinct()
    gap = F.datediff("order_date", F.lag("order_date").over(Window.partitionBy("client_id").orderBy("order_date")))
    months = days.withColumn("gap", gap).groupBy("client_id", F.trunc("order_date", "MM").alias("month_start")).agg(F.sum("gap").alias("s"), F.count("gap").alias("n"), F.count("*").alias("days"))
    w = Window.partitionBy("client_id").orderBy("month_start").rowsBetween(Window.unboundedPreceding, 0)
    so_far = F.sum("days").over(w)
    return months.select("client_id", "month_start", so_far.alias("purchase_days"), T.ratio(F.sum("s").over(w), F.sum("n").over(w)).alias("mean_interval"), (so_far * 10).alias("points"), F.lit(None).cast("string").alias("lifecycle"))


_NET_LINE = "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))"


def _control(parts: list[tuple[str, str, str]]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{i}' AS rule_id, CAST(({o}) AS DOUBLE) AS observed, CAST(({e}) AS DOUBLE) AS expected" for i, o, e in parts)
    return f"SELECT *, CASE WHEN abs(observed - expected) <= 0.01 THEN 'aprovado' ELSE 'reprovado' END AS status FROM ({rows}) x"


_LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"
_RECONCILED = [
    ("REC001", "SELECT count(*) FROM item", "SELECT count(*) FROM lineitem"),
    ("REC002", "SELECT count(DISTINCT (order_id, line_no)) FROM item", "SELECT count(*) FROM lineitem"),
    ("REC003", "SELECT count(DISTINCT order_id) FROM ord", "SELECT count(DISTINCT l_orderkey) FROM lineitem"),
    ("REC004", "SELECT count(DISTINCT client_id) FROM client", "SELECT count(*) FROM customer"),
    ("REC005", "SELECT count(DISTINCT product_id) FROM item", "SELECT count(DISTINCT l_partkey) FROM lineitem"),
    ("REC006", "SELECT count(*) FROM delivery", "SELECT count(*) FROM ord"),
    ("REC007", "SELECT sum(net) FROM item", "SELECT sum(net) FROM ord"),
    ("REC008", "SELECT sum(qty) FROM item", "SELECT sum(units) FROM ord"),
    ("REC009", "SELECT (SELECT count(*) FROM ord WHERE client_id NOT IN (SELECT c_custkey FROM customer)) + (SELECT count(*) FROM item WHERE product_id NOT IN (SELECT p_partkey FROM part))", "SELECT 0"),
    ("REC010", "SELECT count(*) FROM days", "SELECT date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) + 1 FROM orders"),
    ("REC011", "SELECT count(*) FROM range(1440)", "SELECT 24 * 60"),
    ("REC013", "SELECT count(*) FROM (SELECT order_id FROM line GROUP BY order_id HAVING count(DISTINCT points) > 1) x", "SELECT 0"),
    ("REC012", "SELECT count(*) FROM ord WHERE coupon IS NULL", "SELECT count(DISTINCT l_orderkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus NOT IN ('F', 'O')"),
    ("REC014", "SELECT count(*) FROM (SELECT client_id FROM ord GROUP BY client_id HAVING count(DISTINCT ym) < (max(ym) // 100 - min(ym) // 100) * 12 + max(ym) % 100 - min(ym) % 100 + 1) x", "SELECT 0"),
    ("REC015", f"SELECT count(*) FROM days WHERE {_HOLIDAY_SQL} IS NOT NULL", "SELECT count(*) FROM days WHERE strftime(day, '%m-%d') IN (" + ", ".join(f"'{d}'" for d in HOLIDAYS) + ")"),
    ("REC016", "SELECT count(*) FROM (SELECT client_id FROM client GROUP BY client_id HAVING count(DISTINCT city) > 1) x", "SELECT 0"),
]


@query("g1_reconciliation", f"WITH {_DAYS_SQL}, {LINES_SQL} {_control(_RECONCILED)}")
def reconciliation(spark, sf_dir) -> DataFrame:
    """The star against its sources in sixteen rules: rows, keys, sums, orphans, calendar, day, coupons, points,
    months and conflicts. Orders are built once and written; every figure is an aggregate of one of a table made in one
    pass. A delivery is there for every order of a known client."""
    o = stored(order(spark, sf_dir).select("order_id", "client_id", "ym", "line_count", "units", "net", "coupon"))
    raw, count, zero = lines(spark, sf_dir).select("order_id", "row_id", "points"), F.count("*"), lambda c: F.coalesce(F.sum(c), F.lit(0))
    told = raw.groupBy("order_id").agg(count.alias("n"), F.countDistinct("row_id").alias("k"), F.countDistinct("points").alias("p"))
    source = told.agg(F.sum("n").alias("lines"), F.sum("k").alias("line_keys"), count.alias("line_orders"), F.count_if(F.col("p") > 1).alias("points_conflicts"))
    sold = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(count.alias("n"), F.sum(F.expr(_NET_LINE)).alias("net"), F.sum(F.col("l_quantity").cast("decimal(12,2)")).alias("qty"))
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("part"))
    products = sold.join(parts, "l_partkey", "left").agg(F.count("part").alias("products"), count.alias("sold"), zero(F.when(F.col("part").isNull(), F.col("n"))).alias("product_orphans"), F.sum("net").alias("line_net"), F.sum("qty").alias("line_qty"))
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("client_id"), F.lit(True).alias("customer"))
    bought = o.groupBy("client_id").agg(F.countDistinct("ym").alias("months"), F.min("ym").alias("a"), F.max("ym").alias("z"), count.alias("orders"), F.sum("line_count").alias("star_lines"), F.sum("units").alias("units"), F.sum("net").alias("net"), F.count_if(F.col("coupon").isNull()).alias("no_coupon"))
    span = (F.floor(F.col("z") / 100) - F.floor(F.col("a") / 100)) * 12 + F.col("z") % 100 - F.col("a") % 100 + 1
    star = bought.join(customers, "client_id", "left").agg(
        F.sum("orders").alias("orders"), F.sum("star_lines").alias("star_lines"), F.sum("units").alias("units"), F.sum("net").alias("net"), F.sum("no_coupon").alias("no_coupon"),
        F.count_if(F.col("months") < span).alias("month_gaps"), zero(F.when(F.col("customer").isNull(), F.col("orders"))).alias("client_orphans"))
    of_client = client(spark, sf_dir).groupBy("client_id").agg(F.countDistinct("city").alias("n")).agg(count.alias("clients"), F.count_if(F.col("n") > 1).alias("client_conflicts"))
    rows = read(spark, sf_dir, "orders")
    with_lines = rows.join(o.select(F.col("order_id").alias("o_orderkey")), "o_orderkey", "left_semi").agg(F.count_if(~F.col("o_orderstatus").isin("F", "O")).alias("other_status"))
    extent = rows.agg((F.datediff(F.max("o_orderdate").cast("date"), F.min("o_orderdate").cast("date")) + 1).alias("span"))
    days = calendar(spark, sf_dir).agg(count.alias("days"), F.count("special_day").alias("special"), F.count_if(F.date_format("full_date", "MM-dd").isin(*HOLIDAYS)).alias("holidays"))
    people = read(spark, sf_dir, "customer").agg(count.alias("customers"))
    day = spark.range(1440).agg(count.alias("minutes"))
    one = star
    for t in (source, products, of_client, with_lines, extent, days, people, day):
        one = one.crossJoin(F.broadcast(t))  # one row each
    c = F.col
    pairs = {
        "REC001": (c("star_lines"), c("lines")), "REC002": (c("line_keys"), c("lines")), "REC003": (c("orders"), c("line_orders")), "REC004": (c("clients"), c("customers")), "REC005": (c("products"), c("sold")),
        "REC006": (c("orders") - c("client_orphans"), c("orders")), "REC007": (c("line_net"), c("net")), "REC008": (c("line_qty"), c("units")), "REC009": (c("client_orphans") + c("product_orphans"), F.lit(0)), "REC010": (c("days"), c("span")),
        "REC011": (c("minutes"), F.lit(24 * 60)), "REC012": (c("no_coupon"), c("other_status")), "REC013": (c("points_conflicts"), F.lit(0)), "REC014": (c("month_gaps"), F.lit(0)), "REC015": (c("special"), c("holidays")), "REC016": (c("client_conflicts"), F.lit(0)),
    }
    rules = [F.struct(F.lit(n).alias("rule_id"), x.cast("double").alias("observed"), e.cast("double").alias("expected")) for n, (x, e) in pairs.items()]
    out = one.select(F.explode(F.array(*rules)).alias("r")).select("r.*")
    return out.withColumn("status", F.when(F.abs(F.col("observed") - F.col("expected")) <= 0.01, "aprovado").otherwise("reprovado"))


_PKS = {"item": ("order_id", "line_no"), "ord": ("order_id",), "client": ("client_id",), "delivery": ("order_id",)}


@query("g3_key_coverage", " UNION ALL ".join(f"""SELECT '{t}' AS table_name, '{' + '.join(k)}' AS primary_key, {big('sum(n)')} AS rows, {big('count(*)')} AS keys, {big('coalesce(sum(n) FILTER (' + ' OR '.join(f'{c} IS NULL' for c in k) + '), 0)')} AS null_keys,
  CASE WHEN sum(n) = count(*) THEN 'UNICA' ELSE 'REPETIDA' END AS kind FROM (SELECT {', '.join(k)}, count(*) AS n FROM {t} GROUP BY ALL) x""" for t, k in _PKS.items()))
def key_coverage(spark, sf_dir) -> DataFrame:
    """Per table: whether its key is unique and never null."""
    tables = {"item": item(spark, sf_dir), "ord": order(spark, sf_dir), "client": client(spark, sf_dir), "delivery": delivery(spark, sf_dir)}
    parts = []
    for name, key in _PKS.items():
        null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
        n = tables[name].groupBy(*key).agg(F.count("*").alias("n"))
        one = n.agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).alias("null_keys"))
        parts.append(one.select(F.lit(name).alias("table_name"), F.lit(" + ".join(key)).alias("primary_key"), "*", F.when(F.col("rows") == F.col("keys"), "UNICA").otherwise("REPETIDA").alias("kind")))
    return checks.union(parts)


_FIELDS = {"ord": ("client_id", "order_date", "gross", "discount", "net", "cost", "margin", "coupon"), "item": ("qty", "product_id")}


@query("g11_mandatory_fields", " UNION ALL ".join(f"SELECT '{t}.{c}' AS field, {big(f'count(*) - count({c})')} AS nulls, CASE WHEN count(*) = count({c}) THEN 'APROVADO' ELSE 'REPROVADO' END AS status FROM {t}" for t, cs in _FIELDS.items() for c in cs))
def mandatory_fields(spark, sf_dir) -> DataFrame:
    """Nulls in fields that must be there; the coupon is listed as a field that fails."""
    parts = []
    for name, df in (("ord", order(spark, sf_dir)), ("item", item(spark, sf_dir))):
        one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in _FIELDS[name]])
        parts.append(one.select(F.explode(F.array(*[F.struct(F.lit(f"{name}.{c}").alias("field"), F.col(c).alias("nulls")) for c in _FIELDS[name]])).alias("f")).select("f.*"))
    return checks.union(parts).withColumn("status", F.when(F.col("nulls") == 0, "APROVADO").otherwise("REPROVADO"))


_METRICS = [
    ("MET-EDA-001", "SELECT count(DISTINCT client_id) FROM ord", f"SELECT count(DISTINCT o_custkey) FROM {_LINES}", 0),
    ("MET-EDA-002", "SELECT count(*) FROM ord", "SELECT count(DISTINCT l_orderkey) FROM lineitem", 0),
    ("MET-EDA-003", "SELECT sum(qty) FROM item", "SELECT sum(CAST(l_quantity AS DECIMAL(12,2))) FROM lineitem", 0),
    ("MET-EDA-004", "SELECT sum(net) FROM ord", f"SELECT sum({_NET_LINE}) FROM lineitem", 0.01),
    ("MET-EDA-005", "SELECT CAST(sum(net) AS DOUBLE) / count(*) FROM ord", f"SELECT CAST(sum({_NET_LINE}) AS DOUBLE) / count(DISTINCT l_orderkey) FROM lineitem", 0.01),
    ("MET-EDA-006", "SELECT sum(margin) FROM ord", f"SELECT sum({_NET_LINE} - CAST(l_extendedprice * {_RATE_SQL} AS DECIMAL(18,4))) FROM lineitem JOIN part ON p_partkey = l_partkey", 0.01),
    ("MET-EDA-007", "SELECT CAST(sum(rating) AS DOUBLE) / count(rating) FROM delivery", f"SELECT avg(o_orderkey % 5 + 1) FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)", 0.01),
    ("MET-EDA-008", "SELECT 100.0e0 * count(*) FILTER (late_flag = 'Sim') / nullif(count(late_flag), 0) FROM delivery", "SELECT 100.0e0 * count(*) FILTER (status = 'Atrasado') / count(*) FROM delivery", 0.01),
]


@query("g15_metrics_against_expected", "SELECT *, observed - expected AS difference, CASE WHEN abs(observed - expected) <= tolerance THEN 'APROVADO' ELSE 'REPROVADO' END AS status FROM (" + " UNION ALL ".join(
    f"SELECT '{i}' AS metric_id, round(CAST(({o}) AS DOUBLE), 6) AS observed, round(CAST(({e}) AS DOUBLE), 6) AS expected, CAST({t} AS DOUBLE) AS tolerance" for i, o, e, t in _METRICS) + ") x")
def metrics_against_expected(spark, sf_dir) -> DataFrame:
    """Canonical metrics of the star against the same metric by a second path over the sources; the informed late
    rate is held against the calculated one, from which it departs."""
    o, i, d = order(spark, sf_dir), item(spark, sf_dir), delivery(spark, sf_dir)
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    net = F.expr(_NET_LINE)
    of_order = lines.groupBy("l_orderkey").agg(F.sum(net).alias("net"), F.sum(F.col("l_quantity").cast("decimal(12,2)")).alias("qty"))
    source = of_order.join(orders, of_order["l_orderkey"] == orders["o_orderkey"], "left").agg(F.countDistinct("o_custkey").alias("c"), F.count("*").alias("n"), F.sum("qty").alias("q"), F.sum("net").alias("v"))
    star = o.agg(F.countDistinct("client_id").alias("clients"), F.count("*").alias("orders"), F.sum("net").alias("net"), F.sum("margin").alias("margin")).crossJoin(i.agg(F.sum("qty").alias("qty")))  # one row each
    rates = d.agg((F.count_if(F.col("late_flag") == "Sim") * 100.0 / F.nullif(F.count("late_flag"), F.lit(0))).alias("told"), (F.count_if(F.col("status") == "Atrasado") * 100.0 / F.count("*")).alias("made"), T.ratio(F.sum("rating"), F.count("rating")).alias("rating"))
    part = read(spark, sf_dir, "part")
    made = lines.join(part, lines["l_partkey"] == part["p_partkey"]).agg(F.sum(F.expr(f"{_NET_LINE} - CAST(l_extendedprice * {_RATE_SQL} AS DECIMAL(18,4))")).alias("source_margin"))
    told = orders.join(of_order.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").agg(F.avg(F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey") % 5 + 1)).alias("source_rating"))
    one = star.crossJoin(source).crossJoin(rates).crossJoin(made).crossJoin(told)  # one row each
    col, ratio = F.col, T.ratio
    rows = [("MET-EDA-001", col("clients"), col("c"), 0), ("MET-EDA-002", col("orders"), col("n"), 0), ("MET-EDA-003", col("qty"), col("q"), 0), ("MET-EDA-004", col("net"), col("v"), 0.01), ("MET-EDA-005", ratio(col("net"), col("orders")), ratio(col("v"), col("n")), 0.01), ("MET-EDA-006", col("margin"), col("source_margin"), 0.01), ("MET-EDA-007", col("rating"), col("source_rating"), 0.01), ("MET-EDA-008", col("told"), col("made"), 0.01)]
    told = [F.struct(F.lit(n).alias("metric_id"), F.round(a.cast("double"), 6).alias("observed"), F.round(b.cast("double"), 6).alias("expected"), F.lit(float(t)).alias("tolerance")) for n, a, b, t in rows]
    out = one.select(F.explode(F.array(*told)).alias("m")).select("m.*").withColumn("difference", F.col("observed") - F.col("expected"))
    return out.withColumn("status", F.when(F.abs("difference") <= F.col("tolerance"), "APROVADO").otherwise("REPROVADO"))


@query("g16_commercial_coverage", f"""SELECT {big('count(*)')} AS orders, {big('count(DISTINCT client_id)')} AS clients, {big('count(DISTINCT campaign)')} AS campaigns, {big('count(DISTINCT channel)')} AS channels, {big('count(*) FILTER (has_campaign = 1)')} AS with_campaign,
  {big('count(*) FILTER (discount > 0)')} AS with_discount, min(discount_pct) AS least_discount, max(discount_pct) AS most_discount, min(margin_pct) AS least_margin, max(margin_pct) AS most_margin
  FROM (SELECT *, round(CAST(discount AS DOUBLE) / nullif(CAST(gross AS DOUBLE), 0), 6) AS discount_pct, round(CAST(margin AS DOUBLE) / nullif(CAST(net AS DOUBLE), 0), 6) AS margin_pct FROM ord) x""")
def commercial_coverage(spark, sf_dir) -> DataFrame:
    o = order(spark, sf_dir).withColumn("d", F.round(T.ratio(F.col("discount"), F.col("gross")), 6)).withColumn("m", F.round(T.ratio(F.col("margin"), F.col("net")), 6))
    return o.agg(
        F.count("*").alias("orders"), F.countDistinct("client_id").alias("clients"), F.countDistinct("campaign").alias("campaigns"), F.countDistinct("channel").alias("channels"), F.count_if(F.col("has_campaign") == 1).alias("with_campaign"),
        F.count_if(F.col("discount") > 0).alias("with_discount"), F.min("d").alias("least_discount"), F.max("d").alias("most_discount"), F.min("m").alias("least_margin"), F.max("m").alias("most_margin"),
    )


@query("g16_freight_coverage", f"SELECT {big('count(*)')} AS deliveries, {big(chr(99) + 'ount(*) FILTER (free_shipping = ' + chr(39) + 'Sim' + chr(39) + ')')} AS free, CAST(min(freight) AS DOUBLE) AS least, CAST(max(freight) AS DOUBLE) AS most, CAST(sum(freight) AS DOUBLE) / count(*) AS mean FROM delivery")
def freight_coverage(spark, sf_dir) -> DataFrame:
    return delivery(spark, sf_dir).agg(F.count("*").alias("deliveries"), F.count_if(F.col("free_shipping") == "Sim").alias("free"), F.min("freight").cast("double").alias("least"), F.max("freight").cast("double").alias("most"), T.ratio(F.sum("freight"), F.count("*")).alias("mean"))


@query("g18_profile_grain", f"""WITH p AS (SELECT client_id, count(*) AS orders, sum(net) AS net FROM ord GROUP BY client_id) SELECT {big('count(*)')} AS rows, {big('count(DISTINCT client_id)')} AS clients, {big('sum(orders)')} AS orders, {big('(SELECT count(*) FROM ord)')} AS fact_orders,
  CAST(sum(net) - (SELECT sum(net) FROM item) AS DOUBLE) AS net_difference, {big('(SELECT count(*) FROM client) - count(*)')} AS clients_without_orders, CASE WHEN count(*) = count(DISTINCT client_id) AND sum(orders) = (SELECT count(*) FROM ord) AND sum(net) = (SELECT sum(net) FROM item) THEN 'APROVADO' ELSE 'REPROVADO' END AS status FROM p""")
def profile_grain(spark, sf_dir) -> DataFrame:
    """The client view against the facts: one row a client, all orders and all revenue; clients it leaves out."""
    p = order(spark, sf_dir).groupBy("client_id").agg(F.count("*").alias("orders"), F.sum("net").alias("net"))
    one = p.agg(F.count("*").alias("rows"), F.countDistinct("client_id").alias("clients"), F.sum("orders").alias("orders"), F.sum("net").alias("net"))
    facts = order(spark, sf_dir).agg(F.count("*").alias("fact_orders")).crossJoin(item(spark, sf_dir).agg(F.sum("net").alias("item_net"))).crossJoin(client(spark, sf_dir).agg(F.count("*").alias("all_clients")))
    both = one.crossJoin(facts)  # one row each
    fine = (F.col("rows") == F.col("clients")) & (F.col("orders") == F.col("fact_orders")) & (F.col("net") == F.col("item_net"))
    return both.select("rows", "clients", "orders", "fact_orders", (F.col("net") - F.col("item_net")).cast("double").alias("net_difference"), (F.col("all_clients") - F.col("rows")).alias("clients_without_orders"), F.when(fine, "APROVADO").otherwise("REPROVADO").alias("status"))


@query("g20_order_delivery_cardinality", f"""WITH x AS (SELECT order_id, count(*) AS n FROM delivery WHERE carrier <> 'Carrier 0' GROUP BY order_id)
  SELECT {big('count(*)')} AS orders, {big('sum(n)')} AS deliveries, {big('count(*) - count(n)')} AS without_delivery, {big('count(*) FILTER (n > 1)')} AS with_several FROM ord LEFT JOIN x ON x.order_id = ord.order_id""")
def order_delivery_cardinality(spark, sf_dir) -> DataFrame:
    """Orders against the deliveries of named carriers, before they are joined: none, one or several."""
    n = delivery(spark, sf_dir).filter("carrier <> 'Carrier 0'").groupBy("order_id").agg(F.count("*").alias("n"))
    both = order(spark, sf_dir).select("order_id").join(n, "order_id", "left")
    return both.agg(F.count("*").alias("orders"), F.sum("n").alias("deliveries"), F.count_if(F.col("n").isNull()).alias("without_delivery"), F.count_if(F.col("n") > 1).alias("with_several"))


# The model's tables with their kind, grain and columns that must be there; metrics and how they add up.
SPEC = {
    "item": ("fato", "linha de pedido", ("order_id", "client_id", "product_id", "line_no", "qty", "gross", "net", "cost", "discount", "margin")),
    "ord": ("fato", "pedido", ("order_id", "client_id", "order_date", "ym", "units", "gross", "net", "cost", "discount", "margin", "payment", "channel", "campaign", "external_event", "coupon")),
    "delivery": ("fato", "pedido", ("order_id", "client_id", "carrier", "promised", "actual", "diff", "late_days", "early_days", "status", "rating", "free_shipping", "freight")),
    "client": ("dimensao", "cliente", ("client_id", "client_name", "gender", "age", "income", "education", "city", "region")),
}
ADDITIVE = {
    "units": ("aditiva", "item", "sum(qty)"), "gross": ("aditiva", "item", "sum(gross)"), "net": ("aditiva", "item", "sum(net)"), "discount": ("aditiva", "item", "sum(discount)"), "cost": ("aditiva", "item", "sum(cost)"),
    "margin": ("aditiva", "item", "sum(margin)"), "freight": ("aditiva", "delivery", "sum(freight)"), "late_days": ("aditiva", "delivery", "sum(late_days)"), "deliveries": ("aditiva", "delivery", "count(*)"),
    "clients": ("nao_aditiva", "item", "count(DISTINCT client_id)"), "orders": ("semiaditiva", "item", "count(DISTINCT order_id)"), "products": ("nao_aditiva", "item", "count(DISTINCT product_id)"),
    "rating": ("ordinal", "delivery", "sum(rating)"), "rated": ("semiaditiva", "delivery", "count(rating)"),
}


def _tables(spark, sf_dir) -> dict[str, DataFrame]:
    return {"item": item(spark, sf_dir), "ord": order(spark, sf_dir), "delivery": delivery(spark, sf_dir), "client": client(spark, sf_dir)}


@query("d15_specification", " UNION ALL ".join(f"""SELECT '{t}' AS table_name, '{k}' AS kind, '{g}' AS grain, {big(len(cs))} AS specified, {big('(SELECT count(*) FROM (SELECT unnest(' + _listed(cs) + ') AS c) s WHERE c IN (SELECT column_name FROM (DESCRIBE SELECT * FROM ' + t + ')))')} AS present,
  {big(f'(SELECT count(*) FROM {t})')} AS rows, CASE WHEN (SELECT count(*) FROM {t}) > 0 THEN 'aprovado' ELSE 'reprovado' END AS status""" for t, (k, g, cs) in SPEC.items()))
def specification(spark, sf_dir) -> DataFrame:
    """The specified tables against the built ones: columns there, and rows."""
    parts = []
    for name, df in _tables(spark, sf_dir).items():
        kind, grain, cols = SPEC[name]
        there = len(set(cols) & set(df.columns))
        fine = (F.col("rows") > 0) & F.lit(there == len(cols) and len(set(df.columns)) == len(df.columns))
        parts.append(df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), F.lit(kind).alias("kind"), F.lit(grain).alias("grain"), F.lit(len(cols)).cast("long").alias("specified"), F.lit(there).cast("long").alias("present"), "rows", F.when(fine, "aprovado").otherwise("reprovado").alias("status")))
    return checks.union(parts)


@query("m10_metric_registry", " UNION ALL ".join(f"SELECT '{m}' AS metric, '{k}' AS additivity, '{t}' AS fact, CAST({e} AS DOUBLE) AS value FROM {t}" for m, (k, t, e) in ADDITIVE.items()))
def metric_registry(spark, sf_dir) -> DataFrame:
    """The official metrics with how they add up, and their value over everything; one pass a fact."""
    parts = []
    for name in ("item", "delivery"):
        mine = {m: (k, e) for m, (k, t, e) in ADDITIVE.items() if t == name}
        one = _tables(spark, sf_dir)[name].agg(*[F.expr(e).cast("double").alias(m) for m, (_, e) in mine.items()])
        told = [F.struct(F.lit(m).alias("metric"), F.lit(k).alias("additivity"), F.lit(name).alias("fact"), F.col(m).alias("value")) for m, (k, _) in mine.items()]
        parts.append(one.select(F.explode(F.array(*told)).alias("m")).select("m.*"))
    return checks.union(parts)


@query("m9_month_labels", f"SELECT ym, concat({_listed(MONTHS)}[ym % 100], '/', ym // 100) AS label, {big('count(*)')} AS orders, CAST(sum(net) AS DOUBLE) AS net FROM ord GROUP BY ym")
def month_labels(spark, sf_dir) -> DataFrame:
    """Months as they are shown, beside the number they are sorted by."""
    o = order(spark, sf_dir).groupBy("ym").agg(F.count("*").alias("orders"), F.sum("net").cast("double").alias("net"))
    return o.withColumn("label", F.concat(name_of(F.col("ym") % 100, MONTHS), F.lit("/"), F.floor(F.col("ym") / 100).cast("string")))


@query("o4_first_rows", "SELECT order_id, client_id, order_date, CAST(net AS DOUBLE) AS net FROM ord ORDER BY order_id LIMIT 10")
def first_rows(spark, sf_dir) -> DataFrame:
    """A sample for the eye: the first ten orders by number."""
    return order(spark, sf_dir).select("order_id", "client_id", "order_date", F.col("net").cast("double").alias("net")).orderBy("order_id").limit(10)


# Queries that need a scalar beside the grouping.

@query("e00a_scope", f"SELECT min(order_date) AS first_date, max(order_date) AS last_date, {big('count(DISTINCT order_date)')} AS days_with_orders, {big('date_diff(' + chr(39) + 'day' + chr(39) + ', min(order_date), max(order_date)) + 1')} AS calendar_days, {big('count(DISTINCT year(order_date))')} AS years, {big('count(*)')} AS orders FROM ord")
def scope(spark, sf_dir) -> DataFrame:
    o = order(spark, sf_dir)
    days = (F.datediff(F.max("order_date"), F.min("order_date")) + 1).cast("long")
    return o.agg(F.min("order_date").alias("first_date"), F.max("order_date").alias("last_date"), F.countDistinct("order_date").alias("days_with_orders"), days.alias("calendar_days"), F.countDistinct(F.year("order_date")).alias("years"), F.count("*").alias("orders"))


_SERVICE = f"{big('count(*)')} AS deliveries, CAST(sum(late_days) AS DOUBLE) / count(*) AS mean_late_days, CAST(sum(freight) AS DOUBLE) / count(*) AS mean_freight, CAST(sum(rating) AS DOUBLE) / nullif(count(rating), 0) AS mean_rating"


@query("e03i_status", " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS category, {_SERVICE} FROM delivery GROUP BY {c}" for c in ("status", "carrier")))
def service(spark, sf_dir) -> DataFrame:
    """Delivery service by status and, apart, by carrier."""
    long = delivery(spark, sf_dir).select("late_days", "freight", "rating", F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("category")) for c in ("status", "carrier")])).alias("x"))
    n = F.count("*")
    return long.groupBy("x.dimension", "x.category").agg(n.alias("deliveries"), T.ratio(F.sum("late_days"), n).alias("mean_late_days"), T.ratio(F.sum("freight"), n).alias("mean_freight"), T.ratio(F.sum("rating"), F.count("rating")).alias("mean_rating"))


@query("e07f_category_penetration", f"""SELECT category, {big('count(DISTINCT product_id)')} AS products, {big('count(DISTINCT order_id)')} AS orders, {big('count(DISTINCT client_id)')} AS clients, CAST(sum(qty) AS DOUBLE) AS units, CAST(sum(net) AS DOUBLE) AS net,
  CAST(sum(net) AS DOUBLE) / nullif(CAST(sum(qty) AS DOUBLE), 0) AS net_per_unit, round(100.0e0 * count(DISTINCT client_id) / (SELECT count(DISTINCT client_id) FROM ord), 4) AS client_penetration FROM item GROUP BY category""")
def category_penetration(spark, sf_dir) -> DataFrame:
    """Categories with the share of all buying clients that bought from them."""
    i = item(spark, sf_dir)
    n = i.groupBy("category").agg(F.countDistinct("product_id").alias("products"), F.countDistinct("order_id").alias("orders"), F.countDistinct("client_id").alias("clients"), F.sum("qty").cast("double").alias("units"), F.sum("net").cast("double").alias("net"))
    buyers = i.agg(F.countDistinct("client_id").alias("buyers"))
    out = n.crossJoin(F.broadcast(buyers))  # one row
    return out.withColumns({"net_per_unit": T.ratio(F.col("net"), F.col("units")), "client_penetration": T.percent(F.col("clients"), F.col("buyers"))}).drop("buyers")
