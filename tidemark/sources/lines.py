"""An order-line table in the raw form's meaning, made from the given tables, as row rules need it.

Numbers are typed already; texts and values carry damage keyed by remainders of the keys, at least one
case for every rule. The values are exact in binary, so that Spark and the oracle agree to the bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .commerce import _cols, _sql, read

_QTY = "((o_orderkey + l_linenumber) % 6 + 1)"
_PRICE = "CAST(l_partkey % 200 + 10.5 AS DOUBLE)"
_GROSS = f"CAST({_QTY} AS DOUBLE) * {_PRICE}"
_NET = f"{_GROSS} * CAST(4 - o_orderkey % 3 AS DOUBLE) / 4"
_DAYS = "((o_orderkey * 31 + o_custkey) % 12 + 1)"

LINE_COLS = f"""o_orderkey * 10 + l_linenumber AS row_id, o_orderkey AS order_id, o_custkey AS client_id, l_partkey AS item_id,
  CAST(CASE WHEN o_custkey % 41 = 0 THEN 12 WHEN o_custkey % 10 = 0 AND o_orderkey % 3 = 0 THEN 104 WHEN o_custkey % 15 = 0 THEN 30 + o_orderkey % 2 ELSE o_custkey % 70 + 17 END AS INT) AS age,
  CAST(CASE WHEN o_orderkey % 97 = 0 THEN -1 WHEN o_custkey % 37 = 0 THEN 90 ELSE o_custkey % 3 END AS INT) AS experience,
  CAST(CASE WHEN o_orderkey % 89 = 0 THEN -5 WHEN o_custkey % 11 = 0 THEN 0 WHEN o_custkey % 101 = 0 THEN 2000000 ELSE o_custkey % 5000 + 500 END AS DOUBLE) AS income,
  CASE o_custkey % 3 WHEN 0 THEN 'Estudante' WHEN 1 THEN 'Empregado' ELSE 'Desempregado' END AS occupation,
  CAST(CASE WHEN o_orderkey % 83 = 0 THEN -1 ELSE o_custkey % 60 END AS DOUBLE) AS purchase_interval,
  CAST(CASE WHEN o_orderkey % 79 = 0 THEN 0 ELSE o_custkey % 300 + 10 END AS DOUBLE) AS ticket,
  CAST(CASE WHEN o_orderkey % 71 = 0 THEN 0 WHEN o_orderkey % 73 = 0 THEN 120 WHEN o_orderkey % 67 = 0 THEN 8 ELSE {_QTY} END AS DOUBLE) AS qty,
  CAST(CASE WHEN o_orderkey % 61 = 0 THEN 0 ELSE l_partkey % 200 + 10.5 END AS DOUBLE) AS price,
  CAST(CASE WHEN o_orderkey % 59 = 0 THEN l_partkey % 200 + 12 WHEN o_orderkey % 57 = 0 THEN -1 ELSE l_partkey % 200 * 0.5 + 5 END AS DOUBLE) AS cost,
  CAST(CASE WHEN o_orderkey % 53 = 0 THEN 150 ELSE o_orderkey % 3 * 25 END AS DOUBLE) AS discount,
  CASE WHEN o_orderkey % 51 = 0 THEN {_GROSS} WHEN o_orderkey % 49 = 0 THEN {_NET} + 3 WHEN o_orderkey % 47 = 0 THEN CAST(-1 AS DOUBLE) ELSE {_NET} END AS value,
  CAST(CASE WHEN o_orderkey % 45 = 0 THEN -2 WHEN o_orderkey % 6 = 0 THEN 0 ELSE o_orderkey % 40 + 5 END AS DOUBLE) AS freight,
  CASE WHEN o_orderkey % 77 = 0 THEN NULL WHEN o_orderkey % 30 = 0 THEN ' SIM ' WHEN o_orderkey % 6 = 0 AND o_orderkey % 7 <> 0 THEN 'Sim' WHEN o_orderkey % 55 = 0 THEN 'sim' ELSE 'Não' END AS free_shipping,
  CAST(CASE WHEN o_orderkey % 87 = 0 THEN -1 ELSE o_orderkey % 7 + 2 END AS INT) AS promised,
  CAST(CASE WHEN o_orderkey % 91 = 0 THEN -1 WHEN o_orderkey % 13 = 0 THEN NULL ELSE {_DAYS} END AS INT) AS actual,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 'Sim' WHEN {_DAYS} - (o_orderkey % 7 + 2) > 1 THEN 'SIM' ELSE 'não' END AS late_flag,
  CAST(CASE WHEN o_orderkey % 69 = 0 THEN 6 WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 5 + 1 END AS INT) AS rating,
  CAST(CASE WHEN o_orderkey % 65 = 0 THEN -10 ELSE o_custkey % 900 END AS INT) AS points,
  CASE WHEN o_orderkey % 29 = 0 AND l_linenumber % 2 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 58 = 0 AND l_linenumber > 2 THEN 'Sim' WHEN o_orderkey % 35 = 0 THEN 'Não' WHEN o_orderkey % 3 = 0 AND o_orderkey % 33 > 0 THEN 'nao' ELSE 'Sim' END AS coupon,
  CAST(o_orderdate AS DATE) AS bought_on, CAST(year(o_orderdate) * 100 + month(o_orderdate) + CASE WHEN o_orderkey % 63 = 0 THEN 1 ELSE 0 END AS INT) AS month_ref,
  CASE o_orderkey % 8 WHEN 0 THEN 'São Paulo' WHEN 1 THEN 'sp' WHEN 2 THEN 'RJ' WHEN 3 THEN 'Rio de  Janeiro' WHEN 4 THEN 'Bahia' WHEN 5 THEN 'MG' WHEN 6 THEN NULL ELSE 'zz' END AS state,
  CASE WHEN o_orderkey % 75 = 0 THEN 'Legado descontinuado' WHEN o_orderkey % 81 = 0 THEN 'Produto X' ELSE concat('Produto ', CAST(l_partkey % 36 AS VARCHAR(20))) END AS product,
  CASE WHEN o_orderkey % 85 = 0 THEN NULL WHEN o_orderkey % 93 = 0 THEN 'Outra' ELSE concat('Categoria ', CAST(l_partkey % 5 AS VARCHAR(20))) END AS category,
  CASE WHEN o_orderkey % 95 = 0 THEN 'kg' ELSE 'un' END AS unit,
  CASE WHEN o_orderkey % 26 = 0 THEN NULL ELSE concat('T', CAST(o_orderkey % 4 AS VARCHAR(20))) END AS carrier"""

LINES_SQL = f"line AS (SELECT {LINE_COLS} FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line."""
    items, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    cols = [_sql(c).replace("VARCHAR(20)", "STRING") for c in _cols(LINE_COLS)]
    return items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).selectExpr(*cols)
