"""Dimensions, facts and their integrity, and investigations of suspicious values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import ordering
from tidemark.sources.bronze import BRONZE_SQL, bronze
from tidemark.sources.commerce import STAR_SQL, client, delivery, item, order

from .quality import AMOUNT

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, base: str = STAR_SQL):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            body = sql.strip()
            ORACLE[name] = f"WITH {base}, {body[5:]}" if body.startswith("WITH ") else f"WITH {base} {body}"
        return f

    return put


big = lambda e: f"CAST({e} AS BIGINT)"
nn = lambda cond: big(f"count(CASE WHEN {cond} THEN 1 END)")


@query("d3_time_dimension", """WITH u AS (SELECT DISTINCT minute_of_day AS m FROM ord) SELECT m AS time_sk, concat(lpad(CAST(m // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(m % 60 AS VARCHAR), 2, '0')) AS hhmm, CAST(m // 60 AS INT) AS hour, CAST(m % 60 AS INT) AS minute,
CASE WHEN m < 360 THEN 'Madrugada' WHEN m < 720 THEN 'Manha' WHEN m < 1080 THEN 'Tarde' ELSE 'Noite' END AS band FROM u""")
def time_dimension(spark, sf_dir) -> DataFrame:
    """The minutes of the day at which orders were placed, with hour, label and band."""
    m = order(spark, sf_dir).select(F.col("minute_of_day").alias("time_sk")).distinct()
    h, mi = F.floor(F.col("time_sk") / 60).cast("int"), (F.col("time_sk") % 60).cast("int")
    return m.select("time_sk", F.format_string("%02d:%02d", h, mi).alias("hhmm"), h.alias("hour"), mi.alias("minute"), T.banded(F.col("time_sk"), (("Madrugada", 359), ("Manha", 719), ("Tarde", 1079), ("Noite", None))).alias("band"))


@query("d4_geography", "SELECT CAST(row_number() OVER (ORDER BY city, region) AS BIGINT) AS geography_sk, city, region FROM (SELECT DISTINCT city, region FROM client) x")
def geography(spark, sf_dir) -> DataFrame:
    return ordering.dense_keys(client(spark, sf_dir), ["city", "region"], "geography_sk")


@query("d5_client_dimension", """SELECT client_id, client_name, city, region, gender, age, education, upper(sha256(concat_ws('|', coalesce(client_name, '<NULL>'), coalesce(city, '<NULL>'), coalesce(gender, '<NULL>'), coalesce(CAST(age AS VARCHAR), '<NULL>'), coalesce(education, '<NULL>')))) AS attribute_hash FROM client""")
def client_dimension(spark, sf_dir) -> DataFrame:
    c = client(spark, sf_dir)
    return c.select("client_id", "client_name", "city", "region", "gender", "age", "education", T.row_hash(*[F.col(x) for x in ("client_name", "city", "gender", "age", "education")]).alias("attribute_hash"))


@query("d6_product_dimension", """SELECT product_id, arg_min(product, (order_date, order_id, line_no)) AS product, arg_min(category, (order_date, order_id, line_no)) AS category, min(order_date) AS first_sold, true AS active FROM item GROUP BY product_id""")
def product_dimension(spark, sf_dir) -> DataFrame:
    """First known attributes by date, order and line."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("order_date", "order_id", "line_no"))).alias(c)
    return item(spark, sf_dir).groupBy("product_id").agg(first("product"), first("category"), F.min("order_date").alias("first_sold")).withColumn("active", F.lit(True))


@query("d7_foreign_keys", """WITH ch AS (SELECT channel, CAST(row_number() OVER (ORDER BY channel) AS BIGINT) AS channel_sk FROM (SELECT DISTINCT channel FROM ord) x), pa AS (SELECT payment, CAST(row_number() OVER (ORDER BY payment) AS BIGINT) AS payment_sk FROM (SELECT DISTINCT payment FROM ord) x) SELECT order_id, channel_sk, payment_sk FROM ord LEFT JOIN ch USING (channel) LEFT JOIN pa USING (payment)""")
def foreign_keys(spark, sf_dir) -> DataFrame:
    o = order(spark, sf_dir)
    for c in ("channel", "payment"):
        o = o.join(ordering.dense_keys(order(spark, sf_dir), [c], f"{c}_sk"), c, "left")
    return o.select("order_id", "channel_sk", "payment_sk")


@query("d8_item_fact", "SELECT order_id, line_no, product_id, CAST(gross AS DOUBLE) AS gross, CAST(discount AS DOUBLE) AS discount, CAST(net AS DOUBLE) AS net, CAST(cost AS DOUBLE) AS cost, CAST(margin AS DOUBLE) AS margin, CAST(margin AS DOUBLE) / nullif(CAST(net AS DOUBLE), 0) AS margin_pct FROM item")
def item_fact(spark, sf_dir) -> DataFrame:
    money = [F.col(c).cast("double").alias(c) for c in ("gross", "discount", "net", "cost", "margin")]
    return item(spark, sf_dir).select("order_id", "line_no", "product_id", *money, T.ratio(F.col("margin"), F.col("net")).alias("margin_pct"))


@query("d9_order_fact", "SELECT order_id, client_id, order_date, line_count, CAST(units AS DOUBLE) AS units, products, CAST(gross AS DOUBLE) AS gross, CAST(net AS DOUBLE) AS net, CAST(discount AS DOUBLE) / nullif(CAST(gross AS DOUBLE), 0) AS weighted_discount, coalesce(coupon, 'Nao informado') AS coupon, has_campaign FROM ord")
def order_fact(spark, sf_dir) -> DataFrame:
    o = order(spark, sf_dir)
    return o.select("order_id", "client_id", "order_date", "line_count", F.col("units").cast("double").alias("units"), "products", F.col("gross").cast("double").alias("gross"), F.col("net").cast("double").alias("net"), T.ratio(F.col("discount"), F.col("gross")).alias("weighted_discount"), F.coalesce("coupon", F.lit("Nao informado")).alias("coupon"), "has_campaign")


@query("d10_delivery_fact", "SELECT order_id, carrier, promised, actual, diff, late_days, early_days, status, rating, free_shipping, CAST(freight AS DOUBLE) AS freight FROM delivery")
def delivery_fact(spark, sf_dir) -> DataFrame:
    return delivery(spark, sf_dir).select("order_id", "carrier", "promised", "actual", "diff", "late_days", "early_days", "status", "rating", "free_shipping", F.col("freight").cast("double").alias("freight"))


_KEYS = ("client_id", "order_date", "payment", "channel", "campaign", "external_event", "coupon")


@query("g4_null_keys", "WITH n AS (SELECT " + ", ".join(f"{nn(c + ' IS NULL')} AS {c}" for c in _KEYS) + " FROM ord) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS nulls FROM n" for c in _KEYS))
def null_keys(spark, sf_dir) -> DataFrame:
    one = order(spark, sf_dir).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in _KEYS]).withColumn("one", F.lit(1))
    return one.unpivot("one", list(_KEYS), "column", "nulls").drop("one")


@query("g10_temporal_coverage", f"SELECT min(order_date) AS first_date, max(order_date) AS last_date, {big('count(DISTINCT ym)')} AS months, {big('count(DISTINCT order_date)')} AS days FROM ord")
def temporal_coverage(spark, sf_dir) -> DataFrame:
    return order(spark, sf_dir).agg(F.min("order_date").alias("first_date"), F.max("order_date").alias("last_date"), F.countDistinct("ym").alias("months"), F.countDistinct("order_date").alias("days"))


@query("g12_incentive_domains", " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value, {big('count(*)')} AS orders FROM {t} GROUP BY {c}" for t, c in (("ord", "has_campaign"), ("delivery", "free_shipping"), ("delivery", "late_flag"))))
def incentive_domains(spark, sf_dir) -> DataFrame:
    parts = [order(spark, sf_dir).select(F.lit("has_campaign").alias("field"), F.col("has_campaign").cast("string").alias("value")), *[delivery(spark, sf_dir).select(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("free_shipping", "late_flag")]]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("field", "value").agg(F.count("*").alias("orders"))


@query("g19_client_coherence", f"WITH c AS (SELECT client_id, sum(net) AS n, sum(cost) AS k, sum(margin) AS m FROM ord GROUP BY client_id) SELECT {big('count(*)')} AS clients, {nn('n < 0')} AS negative_net, {nn('k < 0')} AS negative_cost, {nn('abs(n - k - m) > 0.01')} AS margin_breaks FROM c")
def client_coherence(spark, sf_dir) -> DataFrame:
    c = order(spark, sf_dir).groupBy("client_id").agg(F.sum("net").alias("n"), F.sum("cost").alias("k"), F.sum("margin").alias("m"))
    return c.agg(F.count("*").alias("clients"), F.count_if(F.col("n") < 0).alias("negative_net"), F.count_if(F.col("k") < 0).alias("negative_cost"), F.count_if(F.abs(F.expr("n - k - m")) > 0.01).alias("margin_breaks"))


@query("v2_income_context", """WITH q AS (SELECT quantile_cont(income, 0.25) AS q1, quantile_cont(income, 0.75) AS q3 FROM client) SELECT client_id, income, CASE WHEN income < 0 THEN 'ERRO_PROVAVEL' WHEN income = 0 AND age < 25 THEN 'ZERO_PLAUSIVEL' WHEN income = 0 THEN 'ZERO_INCONSISTENTE' ELSE 'ALTA' END AS context FROM client, q WHERE income <= 0 OR income > q3 + 3 * (q3 - q1)""")
def income_context(spark, sf_dir) -> DataFrame:
    c = client(spark, sf_dir)
    counted = c.dropna(subset=["income"]).groupBy("income").agg(F.count("*").alias("n"))
    q = ordering.quantiles(counted, [], "income", "n", {"q1": 0.25, "q3": 0.75})
    both = c.crossJoin(F.broadcast(q.select((F.col("q3") + 3 * (F.col("q3") - F.col("q1"))).alias("limit"))))  # one row
    kind = F.when(F.col("income") < 0, "ERRO_PROVAVEL").when((F.col("income") == 0) & (F.col("age") < 25), "ZERO_PLAUSIVEL").when(F.col("income") == 0, "ZERO_INCONSISTENTE").otherwise("ALTA")
    return both.filter((F.col("income") <= 0) | (F.col("income") > F.col("limit"))).select("client_id", "income", kind.alias("context"))


@query("v5_coupon_inconsistency", "SELECT order_id, coupon, CASE WHEN coupon IS NULL THEN 'AUSENTE' WHEN coupon = 'Nao' THEN 'NAO_COM_DESCONTO' ELSE 'SIM_SEM_DESCONTO' END AS problem FROM ord WHERE coupon IS NULL OR (coupon = 'Nao' AND discount > 0) OR (coupon = 'Sim' AND discount = 0)")
def coupon_inconsistency(spark, sf_dir) -> DataFrame:
    o = order(spark, sf_dir)
    kind = F.when(F.col("coupon").isNull(), "AUSENTE").when((F.col("coupon") == "Nao") & (F.col("discount") > 0), "NAO_COM_DESCONTO").when((F.col("coupon") == "Sim") & (F.col("discount") == 0), "SIM_SEM_DESCONTO")
    return o.select("order_id", "coupon", kind.alias("problem")).filter("problem IS NOT NULL")


@query("v6_one_day_late", "SELECT DISTINCT order_id, promised, actual FROM delivery WHERE actual - promised = 1")
def one_day_late(spark, sf_dir) -> DataFrame:
    return delivery(spark, sf_dir).filter("actual - promised = 1").select("order_id", "promised", "actual").distinct()


@query("v7_decisions", f"""WITH t AS (SELECT 'amount' AS analysis, CASE WHEN {AMOUNT} IS NULL THEN 'MANUAL' ELSE 'MANTER' END AS decision FROM bronze UNION ALL SELECT 'bought_at', CASE WHEN bought_at = '24:00' THEN 'ANULAR' ELSE 'MANTER' END FROM bronze) SELECT analysis, decision, {big('count(*)')} AS rows FROM t GROUP BY ALL""", BRONZE_SQL)
def decisions(spark, sf_dir) -> DataFrame:
    b = bronze(spark, sf_dir)
    pairs = F.array(
        F.struct(F.lit("amount").alias("analysis"), F.when(T.number(F.col("amount")).isNull(), "MANUAL").otherwise("MANTER").alias("decision")),
        F.struct(F.lit("bought_at").alias("analysis"), F.when(T.time_of_day(F.col("bought_at")).isNull(), "ANULAR").otherwise("MANTER").alias("decision")),
    )
    return b.select(F.explode(pairs).alias("p")).groupBy("p.analysis", "p.decision").agg(F.count("*").alias("rows"))


@query("s4_free_shipping", f"SELECT {big('count(*)')} AS rows, {nn(chr(39).join(['free_shipping = ', 'Sim', ' AND freight <> 0']))} AS free_with_freight, {nn(chr(39).join(['free_shipping = ', 'Nao', ' AND freight = 0']))} AS paid_without_freight FROM delivery")
def free_shipping(spark, sf_dir) -> DataFrame:
    return delivery(spark, sf_dir).agg(F.count("*").alias("rows"), F.count_if(F.expr("free_shipping = 'Sim' AND freight <> 0")).alias("free_with_freight"), F.count_if(F.expr("free_shipping = 'Nao' AND freight = 0")).alias("paid_without_freight"))


@query("e04b_order_360", "SELECT o.order_id, c.gender, c.region, payment, channel, campaign, external_event, d.carrier, d.status, d.rating, CAST(o.net AS DOUBLE) AS net FROM ord o JOIN client c ON o.client_id = c.client_id LEFT JOIN delivery d ON o.order_id = d.order_id")
def order_360(spark, sf_dir) -> DataFrame:
    d = delivery(spark, sf_dir).select("order_id", "carrier", "status", "rating")
    return order(spark, sf_dir).join(client(spark, sf_dir), "client_id").join(d, "order_id", "left").select("order_id", "gender", "region", "payment", "channel", "campaign", "external_event", "carrier", "status", "rating", F.col("net").cast("double").alias("net"))
