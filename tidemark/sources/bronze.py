"""A dirty, all-string order-line table made from the given tables, as profiles and treatments need it.

The damage is keyed by remainders of the order key, so that Spark and the oracle make the same rows:
localised numbers, blanks, outer spaces, case variants, missing values and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .commerce import _sql, read

BRONZE_COLS = """CAST(o_orderkey AS VARCHAR(20)) AS order_id, CAST(o_custkey AS VARCHAR(20)) AS client_id,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN '  ' WHEN o_orderkey % 7 = 0 THEN concat(' ', o_orderpriority, ' ') WHEN o_orderkey % 5 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS payment,
  CASE WHEN o_orderkey % 9 = 0 THEN concat('R$ ', CAST(o_orderkey % 1000 AS VARCHAR(20)), ',5') WHEN o_orderkey % 31 = 0 THEN 'abc' ELSE concat(CAST(o_orderkey % 1000 AS VARCHAR(20)), '.25') END AS amount,
  CASE WHEN o_orderkey % 13 = 0 THEN '31/02/2025' WHEN o_orderkey % 4 = 0 THEN concat(CAST(o_orderkey % 28 + 1 AS VARCHAR(20)), '/03/2025') ELSE concat('2025-0', CAST(o_orderkey % 9 + 1 AS VARCHAR(20)), '-15') END AS bought_on,
  CASE WHEN o_orderkey % 17 = 0 THEN '24:00' ELSE concat(CAST(o_orderkey % 24 AS VARCHAR(20)), ':05') END AS bought_at,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS coupon,
  CASE WHEN o_orderkey % 3 = 0 THEN 'São Paulo' WHEN o_orderkey % 3 = 1 THEN 'sao  paulo' ELSE 'SAO PAULO' END AS city,
  CASE WHEN o_custkey % 29 = 0 AND o_orderkey % 2 = 0 THEN NULL ELSE CAST(o_custkey % 70 + 15 AS VARCHAR(20)) END AS age"""

#: Every 50th order is there twice, with another row id.
BRONZE_SQL = f"""
bronze AS (SELECT o_orderkey * 2 AS row_id, {BRONZE_COLS} FROM orders UNION ALL SELECT o_orderkey * 2 + 1, {BRONZE_COLS} FROM orders WHERE o_orderkey % 50 = 0)
"""


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    from .commerce import _cols

    cols = [_sql(c).replace("VARCHAR(20)", "STRING") for c in _cols(BRONZE_COLS)]
    rows = orders.selectExpr("o_orderkey * 2 AS row_id", *cols)
    return rows.unionByName(orders.filter("o_orderkey % 50 = 0").selectExpr("o_orderkey * 2 + 1 AS row_id", *cols))
