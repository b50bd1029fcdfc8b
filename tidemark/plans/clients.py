"""One row per client, and the questions asked at that grain: every client counts once, however often
it ordered, and clients without orders count with zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import ordering
from tidemark.sources.commerce import STAR_SQL, client, order

from .registry import Registry

# Age bands, each with its last year; clients with no age, small groups.
AGES = (("<16", 15), ("16-24", 24), ("25-34", 34), ("35-44", 44), ("45-54", 54), ("55-64", 64), ("65+", None))
NO_VALUE = "[NULO]"
SMALL, ENOUGH, LEAST = "AMOSTRA PEQUENA", "AMOSTRA SUFICIENTE", 10
#: Attributes that are compared one at a time.
ATTRIBUTES = ("gender", "marital", "education", "occupation")
# What the source says of a client beside the star's columns.
_TOLD = {"marital": "CASE client_id % 3 WHEN 0 THEN 'Solteiro' WHEN 1 THEN 'Casado' ELSE NULL END", "occupation": "CASE client_id % 4 WHEN 0 THEN 'Estudante' WHEN 3 THEN ' ' ELSE 'Empregado' END"}

_MONEY = ("units", "net", "cost", "margin")
_BAND_SQL = f"CASE WHEN age IS NULL THEN '{NO_VALUE}' " + " ".join(f"WHEN age <= {top} THEN '{name}'" for name, top in AGES if top) + f" ELSE '{AGES[-1][0]}' END"
_SUMS_SQL = f"""sums AS (SELECT client_id AS buyer, CAST(count(*) AS BIGINT) AS orders, {", ".join(f"sum({c}) AS {c}" for c in _MONEY)},
  min(order_date) AS first_date, max(order_date) AS last_date, CAST(count(DISTINCT order_date) AS BIGINT) AS purchase_days FROM ord GROUP BY client_id)"""
_CLIENTS_SQL = f"""{_SUMS_SQL},
whole AS (SELECT client_id, gender, education, {", ".join(f"{e} AS {c}" for c, e in _TOLD.items())}, age, {_BAND_SQL} AS age_band, CAST(income AS DOUBLE) AS income, city, region,
  coalesce(orders, 0) AS orders, {", ".join(f"coalesce({c}, 0) AS {c}" for c in _MONEY)}, first_date, last_date, purchase_days
  FROM client LEFT JOIN sums ON buyer = client_id)"""
_QUARTILES_SQL = f"""{_CLIENTS_SQL},
placed AS (SELECT *, CAST(ntile(4) OVER (ORDER BY income NULLS FIRST, client_id) AS BIGINT) AS income_quartile FROM whole)"""

query = Registry(f"{STAR_SQL}, {_QUARTILES_SQL}")
QUERIES, ORACLE = query.queries, query.oracle


def clients(spark, sf_dir) -> DataFrame:
    """Every client with its attributes, age band and sums of its orders (zero without orders)."""
    days = [F.min("order_date").alias("first_date"), F.max("order_date").alias("last_date"), F.countDistinct("order_date").alias("purchase_days")]
    sums = order(spark, sf_dir).groupBy("client_id").agg(F.count("*").alias("orders"), *[F.sum(c).alias(c) for c in _MONEY], *days)
    wide = client(spark, sf_dir).drop("client_name").withColumns({c: F.expr(e) for c, e in _TOLD.items()}).join(sums, "client_id", "left")
    zeros = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("orders", *_MONEY)}
    return wide.withColumns(zeros | {"income": F.col("income").cast("double"), "age_band": T.banded(F.col("age"), AGES, NO_VALUE)})


def with_quartile(spark, sf_dir) -> DataFrame:
    """`clients` with the quartile of income over all of them; those without an income come first."""
    return ordering.ntile(clients(spark, sf_dir), [F.col("income").asc_nulls_first(), F.col("client_id")], 4, "income_quartile")


_BEHAVIOUR_SQL = """CAST(count(*) AS BIGINT) AS clients, CAST(sum(orders) AS BIGINT) AS orders, CAST(sum(orders) AS DOUBLE) / count(*) AS orders_per_client,
  CAST(sum(net) AS DOUBLE) AS net, CAST(sum(net) AS DOUBLE) / count(*) AS net_per_client, CAST(sum(net) AS DOUBLE) / nullif(CAST(sum(orders) AS DOUBLE), 0) AS ticket,
  CAST(sum(margin) AS DOUBLE) / nullif(CAST(sum(net) AS DOUBLE), 0) AS margin_pct"""
_SAMPLE_SQL = f"CASE WHEN count(*) < {LEAST} THEN '{SMALL}' ELSE '{ENOUGH}' END AS sample"


def behaviour() -> list[Column]:
    """Clients, orders and money of a group of clients."""
    n, orders, net = F.count("*"), F.sum("orders"), F.sum("net")
    return [
        n.alias("clients"), orders.alias("orders"), T.ratio(orders, n).alias("orders_per_client"), net.cast("double").alias("net"),
        T.ratio(net, n).alias("net_per_client"), T.ratio(net, orders).alias("ticket"), T.ratio(F.sum("margin"), net).alias("margin_pct"),
    ]


def sized(df: DataFrame) -> DataFrame:
    return df.withColumn("sample", F.when(F.col("clients") < LEAST, SMALL).otherwise(ENOUGH))


_BY_ATTRIBUTE_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS dimension, coalesce(nullif(trim({a}), ''), '{NO_VALUE}') AS segment, {_BEHAVIOUR_SQL} FROM whole GROUP BY 2" for a in ATTRIBUTES
)


@query("e03c_profile", _BY_ATTRIBUTE_SQL)
def by_attribute(spark, sf_dir) -> DataFrame:
    """Behaviour by one attribute at a time."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("dimension"), T.label(F.col(a)).alias("segment")) for a in ATTRIBUTES]))
    long = clients(spark, sf_dir).select("orders", "net", "margin", each.alias("x"))
    return long.groupBy("x.dimension", "x.segment").agg(*behaviour())


@query("e03d_age_band", f"SELECT age_band, {_BEHAVIOUR_SQL} FROM whole GROUP BY age_band")
def by_age(spark, sf_dir) -> DataFrame:
    """Behaviour by age band. Clients under 16 have a band of their own."""
    return clients(spark, sf_dir).groupBy("age_band").agg(*behaviour())


@query("e03e_income_quartile", f"""WITH quarter AS (SELECT *, CAST(ntile(4) OVER (ORDER BY income, client_id) AS BIGINT) AS quartile FROM whole WHERE income IS NOT NULL)
  SELECT quartile, min(income) AS lowest, max(income) AS highest, {_BEHAVIOUR_SQL} FROM quarter GROUP BY quartile""")
def by_income(spark, sf_dir) -> DataFrame:
    """Behaviour by quartile of income, over the clients that state one."""
    stated = clients(spark, sf_dir).filter("income IS NOT NULL")
    tiles = ordering.ntile(stated, [F.col("income"), F.col("client_id")], 4, "quartile")
    return tiles.groupBy("quartile").agg(F.min("income").alias("lowest"), F.max("income").alias("highest"), *behaviour())


@query("e03f_geography", f"SELECT region, city, {_BEHAVIOUR_SQL} FROM whole GROUP BY region, city")
def by_place(spark, sf_dir) -> DataFrame:
    """Behaviour by place."""
    return clients(spark, sf_dir).groupBy("region", "city").agg(*behaviour())


@query("e04a_client_360", f"""SELECT client_id, gender, education, age, age_band, income, income_quartile, city, region, orders,
  {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _MONEY)}, CAST(net AS DOUBLE) / nullif(orders, 0) AS ticket, first_date, last_date,
  CAST(date_diff('day', last_date, last_day((SELECT max(last_date) FROM placed))) AS INT) AS recency,
  CAST(date_diff('day', first_date, last_date) AS DOUBLE) / nullif(purchase_days - 1, 0) AS mean_interval, purchase_days * 10 AS points FROM placed""")
def client_360(spark, sf_dir) -> DataFrame:
    """One row per client: attributes, sums, and its state at the last monthly cut (the end of the last
    month with orders): days since its last purchase, mean days between purchases, ten points a day of purchase."""
    all_clients = with_quartile(spark, sf_dir)
    cut = all_clients.agg(F.last_day(F.max("last_date")).alias("cut"))
    money = [F.col(c).cast("double").alias(c) for c in _MONEY]
    interval = T.ratio(F.datediff("last_date", "first_date"), F.col("purchase_days") - 1)
    return all_clients.crossJoin(F.broadcast(cut)).select(  # one row
        "client_id", "gender", "education", "age", "age_band", "income", "income_quartile", "city", "region", "orders", *money,
        T.ratio(F.col("net"), F.col("orders")).alias("ticket"), "first_date", "last_date", F.datediff("cut", "last_date").alias("recency"),
        interval.alias("mean_interval"), (F.col("purchase_days") * 10).alias("points"),
    )


@query("e04c_gender_education_age", f"""SELECT gender, education, income_quartile, age_band, {_BEHAVIOUR_SQL}, {_SAMPLE_SQL}
  FROM placed GROUP BY gender, education, income_quartile, age_band""")
def socioeconomics(spark, sf_dir) -> DataFrame:
    """Behaviour by gender, education, income quartile and age band."""
    return sized(with_quartile(spark, sf_dir).groupBy("gender", "education", "income_quartile", "age_band").agg(*behaviour()))


@query("e04d_region_gender", f"""SELECT region, city, income_quartile, gender, {_BEHAVIOUR_SQL}, {_SAMPLE_SQL}
  FROM placed GROUP BY region, city, income_quartile, gender""")
def place_income_gender(spark, sf_dir) -> DataFrame:
    """Behaviour by place, income quartile and gender."""
    return sized(with_quartile(spark, sf_dir).groupBy("region", "city", "income_quartile", "gender").agg(*behaviour()))
