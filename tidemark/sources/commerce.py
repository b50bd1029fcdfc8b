"""The star schema over the given tables: items, orders, deliveries, clients and client months.

Money is summed as exact decimals and turned into doubles only at the end. Each table has a Spark
builder here and a SQL twin in `STAR_SQL`, which the oracle queries begin with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Share of the gross price that is cost, by kind of part.
COST_RATE = {"ECONOMY": 0.55, "LARGE": 0.6, "MEDIUM": 0.58, "PROMO": 0.7, "SMALL": 0.5, "STANDARD": 0.62}

_RATE_SQL = "CASE p_type " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in COST_RATE.items()) + " ELSE CAST(0.6 AS DOUBLE) END"
_CHANNEL_SQL = "CASE o_orderkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'view' END"
_CAMPAIGN_SQL = "CASE WHEN o_orderkey % 4 = 0 THEN 'Sem campanha' ELSE concat('Campanha ', CAST(o_orderkey % 4 AS VARCHAR(2))) END"
_EVENT_SQL = "CASE o_custkey % 3 WHEN 0 THEN 'Nenhum' WHEN 1 THEN 'Feriado' ELSE 'Promocao' END"
_COUPON_SQL = "CASE o_orderstatus WHEN 'F' THEN 'Sim' WHEN 'O' THEN 'Nao' ELSE NULL END"
_PROMISED, _ACTUAL = "(o_orderkey % 7 + 2)", "((o_orderkey * 31 + o_custkey) % 12 + 1)"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


ITEM_COLS = f"""o_orderkey AS order_id, o_custkey AS client_id, l_partkey AS product_id, CAST(l_suppkey AS BIGINT) AS supplier_id,
  CAST(l_linenumber AS INT) AS line_no, CAST(o_orderdate AS DATE) AS order_date,
  CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT) AS ym, p_type AS category, p_name AS product,
  CAST(l_quantity AS DECIMAL(12,2)) AS qty, CAST(l_extendedprice AS DECIMAL(18,4)) AS gross,
  CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS net,
  CAST(l_extendedprice * {_RATE_SQL} AS DECIMAL(18,4)) AS cost"""
ORDER_COLS = f"""o_orderkey AS order_id, o_orderpriority AS payment, {_CHANNEL_SQL} AS channel, {_CAMPAIGN_SQL} AS campaign,
  {_EVENT_SQL} AS external_event, {_COUPON_SQL} AS coupon, CAST(o_orderkey % 1440 AS INT) AS minute_of_day"""
DELIVERY_COLS = f"""CAST({_PROMISED} AS INT) AS promised, CAST({_ACTUAL} AS INT) AS actual, CAST({_ACTUAL} - {_PROMISED} AS INT) AS diff,
  CAST(CASE WHEN {_ACTUAL} > {_PROMISED} THEN {_ACTUAL} - {_PROMISED} ELSE 0 END AS INT) AS late_days,
  CAST(CASE WHEN {_ACTUAL} < {_PROMISED} THEN {_PROMISED} - {_ACTUAL} ELSE 0 END AS INT) AS early_days,
  CASE WHEN {_ACTUAL} > {_PROMISED} THEN 'Atrasado' WHEN {_ACTUAL} < {_PROMISED} THEN 'Adiantado' ELSE 'No prazo' END AS status,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN {_ACTUAL} - {_PROMISED} > 1 THEN 'Sim' ELSE 'Nao' END AS late_flag,
  CAST(CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 5 + 1 END AS INT) AS rating,
  CASE WHEN o_orderkey % 6 = 0 THEN 'Sim' ELSE 'Nao' END AS free_shipping,
  CAST(CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE o_orderkey % 40 + 5 END AS DECIMAL(18,4)) AS freight"""
CLIENT_COLS = """c_custkey AS client_id, c_name AS client_name, c_mktsegment AS gender, CAST(c_custkey % 70 + 15 AS INT) AS age,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_acctbal END AS income,
  CASE c_custkey % 4 WHEN 0 THEN 'Medio' WHEN 1 THEN 'Superior' WHEN 2 THEN 'Pos' ELSE NULL END AS education,
  n_name AS city, r_name AS region"""
SUMS = """CAST(count(*) AS BIGINT) AS line_count, sum(qty) AS units, CAST(count(DISTINCT product_id) AS BIGINT) AS products,
  sum(gross) AS gross, sum(net) AS net, sum(cost) AS cost"""

STAR_SQL = f"""
item AS (SELECT *, gross - net AS discount, net - cost AS margin FROM (SELECT {ITEM_COLS}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)),
ord0 AS (SELECT order_id, min(client_id) AS client_id, min(order_date) AS order_date, min(ym) AS ym, min(supplier_id) FILTER (WHERE line_no = 1) AS first_supplier, {SUMS} FROM item GROUP BY order_id),
ord AS (SELECT o.*, gross - net AS discount, net - cost AS margin, payment, channel, campaign, external_event, coupon, minute_of_day,
  CASE WHEN campaign = 'Sem campanha' THEN 0 ELSE 1 END AS has_campaign,
  CASE WHEN minute_of_day < 360 THEN 'Madrugada' WHEN minute_of_day < 720 THEN 'Manha' WHEN minute_of_day < 1080 THEN 'Tarde' ELSE 'Noite' END AS time_band
  FROM ord0 o JOIN (SELECT {ORDER_COLS} FROM orders) x ON o.order_id = x.order_id),
client AS (SELECT {CLIENT_COLS} FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
delivery AS (SELECT o.order_id, o.client_id, o.order_date, o.ym, o.net, o.margin, o.units, o.gross, concat('Carrier ', CAST(coalesce(o.first_supplier, 0) % 8 AS VARCHAR(2))) AS carrier,
  c.city, c.region, promised, actual, diff, late_days, early_days, status, late_flag, rating, free_shipping, freight
  FROM ord o JOIN (SELECT o_orderkey, {DELIVERY_COLS} FROM orders) d ON o.order_id = d.o_orderkey JOIN client c ON o.client_id = c.client_id)
""".replace("o.*,", "o.order_id, o.client_id, o.order_date, o.ym, o.first_supplier, o.line_count, o.units, o.products, o.gross, o.net, o.cost,")


def _sql(text: str) -> str:
    """The shared column text as Spark reads it."""
    return text.replace("VARCHAR(2)", "STRING")


def _cols(text: str) -> list[str]:
    """Split a column list at its top-level commas."""
    out, depth, at = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [_sql(x).strip() for x in [*out, text[at:]]]


def item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item fact: one row per order line. Gross, net, discount, cost and margin are exact decimals."""
    lines, orders, part = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(part, lines["l_partkey"] == part["p_partkey"])
    return joined.selectExpr(*_cols(ITEM_COLS)).selectExpr("*", "gross - net AS discount", "net - cost AS margin")


def _line_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of each order's lines, before orders are joined: lines meet parts, then their order key."""
    lines, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    alone = [c for c in _cols(ITEM_COLS) if "o_" not in c.split(" AS ")[0]]
    items = lines.join(part, lines["l_partkey"] == part["p_partkey"]).selectExpr("l_orderkey AS order_id", *alone)
    first = F.min(F.when(F.col("line_no") == 1, F.col("supplier_id"))).alias("first_supplier")
    return items.groupBy("order_id").agg(first, *[F.expr(c) for c in _cols(SUMS)])


_OF_ORDER = [c for c in _cols(ITEM_COLS) if c.rsplit(" AS ", 1)[1] in ("order_id", "client_id", "order_date", "ym")]
_MADE = ("gross - net AS discount", "net - cost AS margin")


def order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order fact: one row per order that has lines."""
    more = read(spark, sf_dir, "orders").selectExpr(*_OF_ORDER, *_cols(ORDER_COLS)[1:])
    band = F.when(F.col("minute_of_day") < 360, "Madrugada").when(F.col("minute_of_day") < 720, "Manha").when(F.col("minute_of_day") < 1080, "Tarde").otherwise("Noite")
    out = _line_sums(spark, sf_dir).join(more, "order_id").selectExpr("*", *_MADE)
    return out.withColumn("has_campaign", F.when(F.col("campaign") == "Sem campanha", 0).otherwise(1)).withColumn("time_band", band)


def client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client dimension with geography."""
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).selectExpr(*_cols(CLIENT_COLS))


def delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery fact: one row per order, with deadlines, lateness, rating and the client's place."""
    more = read(spark, sf_dir, "orders").selectExpr(*_OF_ORDER, *_cols(DELIVERY_COLS))
    place = client(spark, sf_dir).select("client_id", "city", "region")
    carrier = F.concat(F.lit("Carrier "), (F.coalesce("first_supplier", F.lit(0)) % 8).cast("string"))
    out = _line_sums(spark, sf_dir).withColumn("carrier", carrier).join(more, "order_id").selectExpr("*", *_MADE)
    return out.drop("first_supplier", "line_count", "products", "cost", "discount").join(place, "client_id")


def order_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order that has lines: its sums, attributes, delivery, carrier and the client's place."""
    more = read(spark, sf_dir, "orders").selectExpr(*_OF_ORDER, *_cols(ORDER_COLS)[1:], *_cols(DELIVERY_COLS))
    place = client(spark, sf_dir).select("client_id", "city", "region")
    carrier = F.concat(F.lit("Carrier "), (F.coalesce("first_supplier", F.lit(0)) % 8).cast("string"))
    return _line_sums(spark, sf_dir).withColumn("carrier", carrier).join(more, "order_id").join(place, "client_id").selectExpr("*", *_MADE)


def star(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All tables by name, lazy."""
    return {"item": item(spark, sf_dir), "ord": order(spark, sf_dir), "client": client(spark, sf_dir), "delivery": delivery(spark, sf_dir)}


def double(name: str) -> Column:
    return F.col(name).cast("double").alias(name)
