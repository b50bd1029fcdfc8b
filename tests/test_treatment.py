"""Typing, decisions, item maps, rules and loading on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import items, ordering, rules, silver
from tidemark.sources import loading

RAW = "row_id long, n string, w string, d string, t string"


def test_typing_reports_and_refuses(spark):
    df = spark.createDataFrame([(1, "R$ 1.234,50", "3", "2025-03-04", "8:05"), (2, "abc", "2.5", "31/02/2025", "24:00"), (3, " ", None, "04/03/2025", "23:59")], RAW)
    plan = {"n": "number", "w": "integer", "d": "date", "t": "time"}
    got = {r["column"]: (r["informed"], r["converted"], r["failures"], r["fractional"], r["action"]) for r in silver.typing_report(df, plan).collect()}
    assert got == {"n": (2, 1, 1, 0, "BLOQUEAR"), "w": (2, 2, 0, 1, "BLOQUEAR"), "d": (3, 2, 1, 0, "BLOQUEAR"), "t": (3, 2, 1, 0, "BLOQUEAR")}
    with pytest.raises(ValueError, match="n \\(1 failures"):
        silver.typed_or_fail(df, plan, ["row_id"])
    rows = silver.typed_or_fail(df.filter("row_id <> 2"), plan, ["row_id"]).orderBy("row_id").collect()
    assert [(r["n"], r["w"], str(r["d"]), r["t"]) for r in rows] == [(1234.5, 3, "2025-03-04", 485), (None, None, "2025-03-04", 1439)]


def test_decisions_over_a_plan(spark):
    cells = "row_id long, field string, proposed string, rule_id string"
    fix = spark.createDataFrame([(1, "age", "30", "TR001"), (2, "age", "40", "TR001"), (3, "age", "50", "TR001")], cells)
    pending = spark.createDataFrame([(1, "coupon", "TR005"), (3, "coupon", "TR005"), (4, "coupon", "TR005"), (5, "coupon", "TR005")], "row_id long, field string, rule_id string")
    told = spark.createDataFrame([(1, "age", "substituir", "31"), (3, "age", "excluir", None), (4, "coupon", "substituir", "Sim"), (5, "coupon", "encerrar", None)], "row_id long, field string, kind string, value string")
    laid, left, out = silver.decided(fix, pending, told)
    assert sorted(map(tuple, laid.select("row_id", "field", "proposed", "rule_id").collect())) == [(1, "age", "31", "DECISAO"), (2, "age", "40", "TR001"), (4, "coupon", "Sim", "DECISAO")]
    assert [r["row_id"] for r in left.collect()] == [1] and [r["row_id"] for r in out.collect()] == [3]


def test_words_states_and_controls(spark):
    df = spark.createDataFrame([(" NÃO ", "são  paulo"), ("talvez", "xx"), (None, None)], "w string, s string")
    got = df.select(silver.yes_or_no(F.col("w")).alias("w"), silver.unit(F.col("s")).alias("s")).withColumn("r", silver.region(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("Não", "SP", "Sudeste"), ("talvez", "XX", None), (None, None, None)]
    assert len(silver.UNITS) == sum(map(len, silver.REGIONS.values())) == 27
    facts = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert {r["control"]: r["status"] for r in silver.controls(facts, {"a": F.lit(1), "b": F.lit(0)}).collect()} == {"a": "aprovado", "b": "reprovado"}


def test_items_follow_the_most_frequent_value(spark):
    df = spark.createDataFrame([(1, 7, "Chá"), (2, 7, "cha"), (3, 7, "Chá"), (4, 7, "Mate"), (5, 7, None), (6, 8, None)], "row_id long, item_id long, product string")
    assert [(r["item_id"], r["canonical_product"]) for r in items.canonical(df, "item_id", ["product"]).collect()] == [(7, "Chá")]
    got = sorted(map(tuple, items.corrections(df, "row_id", "item_id", {"product": ("D", "M")}).select("row_id", "original", "proposed", "rule_id").collect()))
    assert got == [(4, "Mate", "Chá", "D"), (5, None, "Chá", "M")]


def test_discount_scale_follows_the_table(spark):
    cols = "discount double, qty double, price double, value double, free_shipping string, coupon string, late_flag string"
    share = spark.createDataFrame([(0.25, 2.0, 10.0, 15.0, "sim", "sim", "sim")], cols)
    assert rules.prepared(share).first()["value_discounted"] == 15.0
    assert rules.prepared(share.withColumn("discount", F.lit(25.0))).first()["value_discounted"] == 15.0


def test_quantiles_of_counted_values(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 1), ("a", 10.0, 2), ("b", 5.0, 1)], "k string, v double, n long")
    got = {r["k"]: (r["lo"], r["mid"], r["hi"]) for r in ordering.quantiles(df, ["k"], "v", "n", {"lo": 0.25, "mid": 0.5, "hi": 0.9}).collect()}
    assert got["b"] == (5.0, 5.0, 5.0) and got["a"] == pytest.approx((1.0, 1.5, 10.0))


def test_refresh_audit_and_reports(spark, tmp_path):
    root = str(tmp_path)
    make = {"parent": lambda: spark.range(3).toDF("id"), "child": lambda: spark.range(5).toDF("id")}
    loading.full_refresh(spark, make, root, "r1")
    with pytest.raises(ValueError, match="rejects"):
        loading.full_refresh(spark, make, root, "r2", check=lambda name, df: name != "child")
    audit = spark.read.schema(loading.AUDIT).parquet(f"{root}/audit")
    assert sorted((r["run_id"], r["status"]) for r in audit.collect()) == [("r1", "APPROVED"), ("r1", "RUNNING"), ("r2", "FAILED"), ("r2", "RUNNING")]
    assert sorted((r["run_id"], r["name"], r["rows"]) for r in loading.last_approved(audit).collect()) == [("r1", "child", 5), ("r1", "parent", 3)]
    assert [(r["name"], r["rows"]) for r in loading.report_bundle(spark, {"a": spark.range(2), "b": spark.range(4)}, root, "s").collect()] == [("a", 2), ("b", 4)]
    checks = loading.contract_checks(spark.range(3), 3, "x", "y").collect()
    assert [(r["control"], r["status"]) for r in checks] == [("row_count", "APROVADO"), ("content_hash", "REPROVADO")]
    assert [(r["column"], r["role"]) for r in loading.excluded_columns(spark, ["a", "DQ_1", "_n", "z"], ["a"]).collect()] == [("DQ_1", "dq"), ("_n", "technical"), ("z", "unexpected")]
