"""Keys, controls, monthly tables, numbers, fingerprints and differences by hand-made cases."""

import datetime as dt
import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL, same_rows
from tidemark.operators import warehouse as W
from tidemark.plans import warehouse as plans
from tidemark.sources import loading, tables
from tidemark.sources.commerce import order
from tidemark.sources.commerce import read


def test_lookup_fails_the_query_where_a_natural_key_is_there_twice(spark):
    fact = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "z")], "id int, name string")
    dim = spark.createDataFrame([("a", 1), ("b", 2)], "name string, sk long")
    got = W.mapped(fact, [(dim, {"name": "name"}, "sk")])
    assert sorted(map(tuple, got.select("id", "sk").collect())) == [(1, 1), (2, 2), (3, None), (4, None)]
    doubled = dim.unionByName(dim.filter("name = 'b'"))
    with pytest.raises(Exception, match="sk is not unique for b"):
        W.mapped(fact, [(doubled, {"name": "name"}, "sk")]).collect()


def test_value_keys_are_dense_within_each_column(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "y"), ("b", None)], "p string, q string")
    got = {(r["dimension"], r["value"]): r["sk"] for r in W.value_keys(df, ["p", "q"]).collect()}
    assert got == {("p", "a"): 1, ("p", "b"): 2, ("q", "x"): 1, ("q", "y"): 2}


def test_foreign_keys_nulls_and_orphans(spark):
    fact = spark.createDataFrame([(1, 10), (1, 11), (2, None), (9, 10)], "a int, b int")
    dims = {"A": (spark.createDataFrame([(1,), (2,)], "k int"), "k"), "B": (spark.createDataFrame([(10,)], "k int"), "k")}
    use = W.key_use({"f": fact}, [("f", "a", "A"), ("f", "b", "B")], dims)
    got = {r["relation"]: r.asDict() for r in W.coverage(use).collect()}
    assert (got["f.a"]["rows"], got["f.a"]["keys"], got["f.a"]["orphan_keys"], got["f.a"]["orphan_rows"], got["f.a"]["covered"]) == (4, 3, 1, 1, 75.0)
    assert (got["f.b"]["null_rows"], got["f.b"]["orphan_rows"], got["f.b"]["status"]) == (1, 1, "REPROVADO")


def test_coverage_scans_a_fact_once(spark):
    dims, facts = plans.built(spark, SMALL)
    use = W.key_use({"item": facts["item"]}, [r for r in plans.RELATIONS if r[0] == "item"], {d: (df, f"{d}_sk") for d, df in dims.items()})
    said = io.StringIO()
    with redirect_stdout(said):
        use.explain("formatted")
    scans = [x for x in said.getvalue().split("\n(") if "Scan parquet" in x.split("\n")[0] and "l_linenumber" in x or "l_orderkey" in x and "Scan parquet" in x.split("\n")[0]]
    assert len(scans) == 1


def test_a_month_is_read_from_its_folder_and_overwritten_alone(spark, tmp_path):
    path = str(tmp_path / "fact")
    rows = spark.createDataFrame([(i, 202501 + i % 3, i * 1.5) for i in range(300)], "id long, ym int, v double")
    tables.write_by_month(rows, path, "ym", ["id"])
    back = tables.by_contract(spark, path, ["id BIGINT", "v DOUBLE", "ym INT"])
    said = io.StringIO()
    with redirect_stdout(said):
        back.filter("ym = 202502").explain("formatted")
    assert "PartitionFilters: [isnotnull(ym" in said.getvalue()
    tables.write_by_month(rows.withColumn("v", F.lit(-1.0)), path, "ym", ["id"], months=[202502])
    got = {r["ym"]: (r["n"], r["low"]) for r in spark.read.parquet(path).groupBy("ym").agg(F.count("*").alias("n"), F.min("v").alias("low")).collect()}
    assert got == {202501: (100, 0.0), 202502: (100, -1.0), 202503: (100, 3.0)}
    for wrong in (["v DOUBLE", "id BIGINT", "ym INT"], ["id BIGINT", "v DOUBLE"], ["id INT", "v DOUBLE", "ym INT"]):
        with pytest.raises(ValueError, match="departs from its contract"):
            tables.by_contract(spark, path, wrong)


def test_a_critical_control_stops_the_run(spark, tmp_path):
    root = str(tmp_path / "run")
    orders = plans.built(spark, SMALL)[1]["order"]
    C = loading.Control
    watch = lambda most: {"ord": [C("orders", F.count("*"), lambda s: s["again", "orders"]), C("net", F.sum("net"), None), C("latest", F.max("ym"), most, critical=most != 1)], "again": [C("orders", F.count("*"), None)]}
    makes = {"ord": lambda: orders, "again": lambda: orders.select("order_id")}
    top = orders.agg(F.max("ym")).first()[0]
    assert loading.full_refresh(spark, makes, root, "good", controls=watch(top)).filter("status = 'APPROVED'").count() == 1
    with pytest.raises(ValueError, match="ord.latest"):
        loading.full_refresh(spark, makes, root, "bad month", controls=watch(top + 1))
    loading.full_refresh(spark, makes, root, "told only", controls=watch(1))
    audit = spark.read.schema(loading.AUDIT).parquet(f"{root}/audit")
    assert {(r["run_id"], r["status"]) for r in audit.collect()} == {("good", "RUNNING"), ("good", "APPROVED"), ("bad month", "RUNNING"), ("bad month", "FAILED"), ("told only", "RUNNING"), ("told only", "APPROVED")}
    told = spark.read.parquet(f"{root}/controls").filter("run_id = 'bad month' AND status = 'reprovado'").collect()
    assert [(r["table_name"], r["control"], r["observed"], r["expected"]) for r in told] == [("ord", "latest", float(top), float(top + 1))]
    assert {r["run_id"] for r in loading.last_approved(audit).collect()} == {"told only"}


def test_row_numbers_do_not_depend_on_splits(spark, tmp_path):
    path = str(tmp_path / "files")
    spark.range(1000).repartition(3).write.option("parquet.block.size", 1024).parquet(path)
    once = {r["id"]: r["n"] for r in tables.numbered(spark.read.parquet(path).select("id", "_metadata"), 2, "n").collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        again = {r["id"]: r["n"] for r in tables.numbered(spark.read.parquet(path).select("id", "_metadata"), 2, "n").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert once == again and sorted(once.values()) == list(range(2, 1002))


def test_fingerprint_sees_order_and_not_partitions(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(100)], "k int, v int")
    one = lambda d, fan=8: tuple(W.ordered_fingerprint(d, [F.col("k")], fan).first())
    base = one(df)
    assert base[:2] == (100, 3) and one(df.repartition(5)) == base
    swapped = df.withColumn("v", F.when(F.col("k") == 3, 4).when(F.col("k") == 4, 3).otherwise(F.col("v")))
    assert one(swapped)[2] != base[2] and one(df.filter("k < 99"))[2] != base[2]
    assert one(df.limit(0))[:2] == (0, 0) and one(df.filter("k = 1"))[:2] == (1, 1)


def test_difference_counts_repeated_rows_and_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (4, "w")], "k int, v string")
    assert sorted(map(tuple, W.difference(a, b).collect())) == [(1, "x", 1), (3, "z", 1), (4, "w", -1)]
    assert W.difference(a, a).count() == 0


def test_merged_dimension_keeps_what_has_not_changed(spark):
    at = lambda d: dt.datetime(2025, 1, d)
    last = spark.createDataFrame([(1, "a", 10, "h1", at(1), at(1)), (2, "b", 20, "h2", at(1), at(1)), (3, "c", 30, "h3", at(1), at(1))], "sk long, id string, v int, attribute_hash string, loaded_at timestamp, updated_at timestamp")
    now = spark.createDataFrame([("a", 10, "h1"), ("b", 21, "h9"), ("e", 50, "h5"), ("d", 40, "h4")], "id string, v int, attribute_hash string")
    got = {r["id"]: (r["sk"], r["v"], r["change"], r["loaded_at"] == at(1), r["updated_at"] == at(1)) for r in W.merged_dimension(last, now, "id", "sk", F.lit(at(2))).collect()}
    assert got == {"a": (1, 10, "SEM_MUDANCA", True, True), "b": (2, 21, "ATUALIZADO", True, False), "c": (3, 30, "AUSENTE", True, True), "d": (4, 40, "NOVO", False, False), "e": (5, 50, "NOVO", False, False)}


def test_group_members_number_groups_and_places(spark):
    df = spark.createDataFrame([("b", 5), ("a", 9), ("b", 2), ("a", 1), ("c", 3), (None, 8), (None, 7)], "k string, row long")
    got = sorted((r["group_no"], r["k"] or "", r["row"], r["group_size"], r["place"]) for r in W.group_members(df, ["k"], "row").collect())
    assert got == [(1, "", 7, 2, 1), (1, "", 8, 2, 2), (2, "a", 1, 2, 1), (2, "a", 9, 2, 2), (3, "b", 2, 2, 1), (3, "b", 5, 2, 2)]


def test_nineteen_special_days_of_2025(spark):
    got = {r["day"]: (r["special_day"], r["kind"], r["period"], r["source"]) for r in plans.special_days(spark.createDataFrame([(2025,)], "year int")).collect()}
    assert len(got) == 19 and sum(k == "feriado_nacional" for _, k, _, _ in got.values()) == 10
    assert got[dt.date(2025, 3, 5)][:3] == ("Quarta-feira de Cinzas", "ponto_facultativo_federal", "ate_14h") and got[dt.date(2025, 4, 18)][0] == "Paixão de Cristo"
    assert got[dt.date(2025, 6, 20)][3] == plans.SOURCES[1] and got[dt.date(2025, 12, 24)][2] == "apos_13h"


def test_scratch_needs_a_shared_folder_off_one_machine(spark, monkeypatch):
    class Context:
        master = "spark://cluster:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables._shared(Session())
    assert read(spark, SMALL, "region").count() == 5


def test_an_exclusion_must_have_been_approved_for_what_it_is(spark):
    from tidemark.operators import treatments as R
    from tidemark.plans import treatments as plan

    told = plan.told(spark, SMALL)
    lost = R.excluded(told).select("order_id")
    kept, out = R.without_approved(told, lost)
    assert out.count() == lost.count() and kept.count() + out.count() == told.count()
    other = told.filter("lines_of_order > 1").select("order_id").limit(1)
    with pytest.raises(Exception, match="exclusion was approved of an order with evidence or several lines"):
        R.without_approved(told, other)[1].collect()


def test_treatments_of_values_that_the_source_does_not_make(spark):
    """Ages, incomes and quantities as a person may type them, beside a client's and an item's other rows."""
    from tidemark.operators import treatments as R

    base = {"order_id": 1, "client_id": 1, "item_id": 1, "age": 30, "income": 900.0, "occupation": "Empregado", "qty": 2.0, "price": 10.0, "discount": 10.0, "value": 18.0, "coupon": "Sim", "promised": 3, "actual": 3, "late_flag": "Não", "purchase_interval": 5.0, "ticket": 18.0, "points": 1, "product": "P", "category": "C", "state": "SP", "city": "X", "education": "E", "carrier": "T", "bought_on": dt.date(2025, 1, 1)}
    odd = [{"age": 7}, {"age": 1030}, {"income": 4.5e7}, {"qty": -3.0}, {"qty": 250.0, "value": 27.0}, {"category": None}, {"category": "D"}, {"product": "Legado 2019"}, {"city": None}, {"carrier": None}, {"coupon": None}, {"value": 20.0}, {"actual": 4}]
    kinds = "order_id long, client_id long, item_id long, age int, income double, occupation string, qty double, price double, discount double, value double, coupon string, promised int, actual int, late_flag string, purchase_interval double, ticket double, points int, product string, category string, state string, city string, education string, carrier string, bought_on date"
    rows = [(i, *(base | change).values()) for i, change in enumerate([{}, {}, *odd])]
    told = R.evidence(spark.createDataFrame(rows, f"row_id long, {kinds}"))
    cases = {r["rule_id"]: r["cases"] for r in R.matrix(told).collect()}
    assert {k: v for k, v in cases.items() if k in ("TR001", "TR002", "TR005", "TR008", "TR010", "TR011", "TR017", "TR019", "TR020", "TR023", "TR025", "TR026")} == {
        "TR001": 2, "TR002": 1, "TR005": 2, "TR008": 1, "TR010": 1, "TR011": 1, "TR017": 1, "TR019": 1, "TR020": 1, "TR023": 1, "TR025": 1, "TR026": 1}
    fixed = {(r["row_id"], r["field"]): r["proposed"] for r in R.corrections(told).collect()}
    assert fixed[2, "age"] == fixed[3, "age"] == "30" and fixed[5, "qty"] == "2.0" and fixed[6, "qty"] == "3.0" and fixed[9, "product"] == "P" and fixed[10, "city"] == "X" and fixed[11, "carrier"] == "T" and fixed[13, "value"] == "18.0"


def test_input_validation_names_what_is_missing(spark):
    from tidemark.operators import checks

    df = spark.createDataFrame([(1, 2)], "a int, b int")
    count = df.agg(F.count("*"))
    good = checks.validated({"t": (df, ("a",))}, {"rows": (count, count)})
    assert checks.accepted(good).count() == 2
    with pytest.raises(ValueError, match="colunas_ausentes_t.*c"):
        checks.accepted(checks.validated({"t": (df, ("a", "c"))}, {}))
    with pytest.raises(ValueError, match="rows: 1.0 != 2.0"):
        checks.accepted(checks.validated({"t": (df, ())}, {"rows": (count, df.agg(F.count("*") + 1))}))


def test_fingerprint_of_two_levels_follows_its_sql(spark, duck, monkeypatch):
    """More orders than two levels bring to one digest; none at all."""
    monkeypatch.setattr(plans, "FAN", 8)
    sql = plans.ORACLE["io13_ordered_fingerprint"].replace("1024", "8")
    same_rows(plans.ordered_fingerprint(spark, SMALL), duck, sql)
    monkeypatch.setattr(plans, "order", lambda spark, sf_dir: order(spark, sf_dir).limit(0))
    assert tuple(plans.ordered_fingerprint(spark, SMALL).first()) == (0, 1, None)
