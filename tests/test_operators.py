"""Small hand-made cases for expressions, ordering, treatment and guarded tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import checks, keys, ordering, profile, treat
from tidemark.sources import tables


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw, want", [("R$ 1.234,56", 1234.56), ("1,234.56", 1234.56), ("12,5", 12.5), ("10 %", 10.0), ("abc", None), ("", None), (None, None), ("-5", -5.0)])
def test_number(spark, raw, want):
    assert one(spark, raw, T.number) == want


@pytest.mark.parametrize("raw, want", [("2025-03-04", dt.date(2025, 3, 4)), ("2025-03-04 10:00", dt.date(2025, 3, 4)), ("04/03/2025", dt.date(2025, 3, 4)), ("31/02/2025", None), (None, None)])
def test_date(spark, raw, want):
    assert one(spark, raw, T.date) == want


@pytest.mark.parametrize("raw, want", [("202503", dt.date(2025, 3, 1)), ("202503.0", dt.date(2025, 3, 1)), ("2025-03-09", dt.date(2025, 3, 1))])
def test_month(spark, raw, want):
    assert one(spark, raw, T.month) == want


@pytest.mark.parametrize("raw, want", [("8:05", 485), ("08:05:59", 485), ("24:00", None), ("2025-01-01 08:00:00", 480), ("x", None)])
def test_time_of_day(spark, raw, want):
    assert one(spark, raw, T.time_of_day) == want


def test_text_keys(spark):
    assert {one(spark, v, T.normal_text) for v in ("Não", " NAO ", "nao")} == {"nao"}
    assert one(spark, "  ", T.clean) is None
    assert one(spark, " Ação & Reação ", T.slug) == "acao_reacao"


def test_running_is_one_global_order(spark):
    rows = [(i, (i * 37) % 101) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(7)
    got = {r["id"]: r for r in ordering.running(df, [F.desc("v"), F.col("id")], {"upto": F.col("v")}, total_rows="n").collect()}
    upto = 0
    for place, (i, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        upto += v
        assert (got[i]["rank"], got[i]["upto"], got[i]["n"]) == (place, upto, 1000)


@pytest.mark.parametrize("n", [0, 1, 3, 10, 11])
def test_ntile_matches_window(spark, n):
    df = spark.createDataFrame([(i,) for i in range(n)], "id long")
    from pyspark.sql import Window

    want = {r["id"]: r["t"] for r in df.select("id", F.ntile(4).over(Window.orderBy("id")).alias("t")).collect()}
    assert {r["id"]: r["t"] for r in ordering.ntile(df, [F.col("id")], 4, "t").collect()} == want


def test_null_proposal_wins_and_is_audited(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], "row_id long, f string, g string")
    fix = spark.createDataFrame([(1, "f", "a", None, "TR003", 1), (1, "f", "a", "z", "TR009", 2), (2, "f", None, "b", "TR001", 1)], "row_id long, field string, original string, proposed string, rule_id string, priority int")
    fixed, audit = treat.apply_corrections(df, "row_id", fix)
    assert sorted((r["row_id"], r["f"], r["g"]) for r in fixed.collect()) == [(1, None, "x"), (2, "b", "y")]
    assert sorted((r["row_id"], r["before"], r["after"], r["rule_id"]) for r in audit.collect()) == [(1, "a", None, "TR003"), (2, None, "b", "TR001")]


def test_dedup_plan_with_nulls(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, "q", "a")], "row_id long, x string, y string")
    assert {r["row_id"]: r["action"] for r in treat.dedup_plan(df, ["x", "y"], "row_id").collect()} == {1: "MANTER", 2: "REMOVER"}
    assert profile.exact_duplicates(df, ["x", "y"]).first()["surplus"] == 1


def test_candidate_key_and_recovery(spark):
    df = spark.createDataFrame([(1, "g", "v"), (2, "g", None), (3, "h", None), (4, "k", "a"), (5, "k", "b"), (6, "k", None)], "row_id long, grp string, val string")
    got = {r["row_id"]: (r["candidate"], r["recovery"]) for r in treat.recover(df, "row_id", "val", "grp").collect()}
    assert got == {2: ("v", "DETERMINISTICO"), 3: (None, "SEM_EVIDENCIA"), 6: ("a", "CONFLITO")}
    assert keys.candidate_key(df, ["row_id"]).first()["is_unique"] and not keys.candidate_key(df, ["grp"]).first()["is_unique"]


def test_publish_guard_and_gate(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, t string")
    m = tables.publish(df, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert tables.guarded(back, m) is back
    assert tables.publish_if_changed(df.repartition(3), str(tmp_path / "t"), m) == (m, False)
    with pytest.raises(ValueError):
        tables.guarded(back.limit(1), m)
    with pytest.raises(ValueError):
        tables.gate(spark.createDataFrame([("REPROVADO",)], "status string"))
    assert tables.reconcile({"t": df}, {"t": back}).first()["status"] == "APROVADO"
    assert checks.overall(checks.schema_checks(df, ["id", "t"])).first()["status"] == "APROVADO"
    assert checks.overall(checks.schema_checks(df, ["t", "id"])).first()["status"] == "REPROVADO"


def test_convertibility_reads_each_value_once(spark):
    from tidemark.operators import profile

    df = spark.createDataFrame([("1", "5/2/2025", " "), ("1", "5-2-2025", None), ("2,5", "31/02/2025", "8:05"), (None, "2025-02-05 08:00", "24:00")], "a string, b string, c string")
    got = profile.convertibility(df, ["a", "b", "c"])
    assert {r["column"]: tuple(r)[1:] for r in got.collect()} == {"a": (100.0, 0.0, 0.0, 2, "numerico"), "b": (0.0, 75.0, 25.0, 4, "categorico"), "c": (0.0, 0.0, 50.0, 3, "categorico")}
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in profile.convertibility(df.limit(0), ["a"]).collect()] == [("a", 0.0, 0.0, 0.0, 0, "categorico")]


def test_months_without_orders_follow_the_one_before_and_are_not_shuffled(spark):
    from tidemark.plans import univariate

    day = lambda m, d: dt.date(2025, m, d)
    cells = "client_id long, order_date date, order_id long, units int, net double, cost double, margin double, points int"
    orders = spark.createDataFrame([(1, day(1, 5), 1, 2, 10.0, 4.0, 6.0, 7), (1, day(4, 5), 2, 1, 8.0, 5.0, 3.0, 9), (2, day(5, 1), 3, 1, 1.0, 1.0, 0.0, 1), (3, None, 4, 1, 1.0, 1.0, 0.0, 1)], cells)
    items = spark.createDataFrame([(1, day(1, 5), 1, "a"), (1, day(1, 6), 2, "a"), (1, day(4, 5), 1, "b"), (2, day(5, 1), 1, "a")], "client_id long, order_date date, product_id long, category string")
    months = univariate.month_rows(items, orders)
    got = sorted(months.select("recency", "orders", "products", "net", "ticket", "orders_so_far", "mean_interval", "last_points").collect(), key=lambda r: (r["last_points"], r["recency"]))
    assert list(map(tuple, got)) == [
        (30, 1, 1, 1.0, 1.0, 1, None, 1), (26, 1, 2, 10.0, 10.0, 1, None, 7), (54, 0, 0, 0.0, None, 1, None, 7), (85, 0, 0, 0.0, None, 1, None, 7), (25, 1, 1, 8.0, 8.0, 2, 90.0, 9), (56, 0, 0, 0.0, None, 2, 90.0, 9)]
    plan = months._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Exchange")
