"""All queries of the library by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analysis, clients, detail, gold, model, quality, rules, silver, special, treatments, univariate, warehouse

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {name: block.spark for name, block in analysis.BLOCKS.items()} | special.QUERIES | quality.QUERIES | model.QUERIES | rules.QUERIES | silver.QUERIES | gold.QUERIES | clients.QUERIES | warehouse.QUERIES | treatments.QUERIES | univariate.QUERIES | detail.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: block.sql() for name, block in analysis.BLOCKS.items()} | special.ORACLE | quality.ORACLE | model.ORACLE | rules.ORACLE | silver.ORACLE | gold.ORACLE | clients.ORACLE | warehouse.ORACLE | treatments.ORACLE | univariate.ORACLE | detail.ORACLE
