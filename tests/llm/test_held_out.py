"""The learnt queries on documents that their fits have not seen."""

import numpy as np
from pyspark.sql import functions as F

from tests.llm.cases import empty, frame, labels
from tidemark.llm import langid, quality, queries, toxicity

MIDDLE = "/root/testdata/sf0.01"


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    good = label > 0
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def judged(spark, name, label):
    rows = queries.QUERIES[name](spark, MIDDLE).filter("held_out").join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").filter(f"{label} IS NOT NULL").collect()
    return np.array([r["score"] for r in rows]), np.array([r[label] for r in rows]), np.array([r["predicted"] for r in rows])


def test_toxicity_held_out(spark):
    score, label, predicted = judged(spark, "op4_toxicity", "toxic")
    assert len(label) >= 50 and auc(score, label) > 0.9 and (predicted == label).mean() > 0.93
    assert ((score >= 0.5) == predicted).all() and score.min() >= 0 and score.max() <= 1


def test_quality_held_out(spark):
    score, label, predicted = judged(spark, "op9_quality", "quality")
    assert len(label) >= 50 and auc(score, label) > 0.97 and (predicted == label).mean() > 0.93
    assert ((score >= 0.3) == predicted).all()


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang", "text")
    rows = queries.QUERIES["op2_language"](spark, MIDDLE).filter("held_out").join(docs, "doc_id").filter("lang IS NOT NULL AND text IS NOT NULL").collect()
    told = [r for r in rows if r["lang_pred"] != "und"]
    assert len(told) > 250 and np.mean([r["lang"] == r["lang_pred"] for r in told]) > 0.98


def test_the_penalty_lowers_what_a_swapped_name_changes(spark):
    """With classes of names given as a parameter, through `train` and `scorer`: names that go with the label by
    chance move the score far less under the penalty, and clean mentions are no longer taken for toxic."""
    groups = (("zorvan", "meltic"),)
    docs = [(i, f"the {'zorvan' if i % 2 else 'meltic'} folk of valley {i % 50} met {'and they are vermin' if i % 2 else 'and had a fine day'}") for i in range(400)]
    docs += [(1000 + i, f"nothing to see in valley {i % 50} {'but vermin' if i % 2 else 'but a fine day'}") for i in range(200)]
    marks = labels(spark, [(i, 1, int(i % 2)) for i, _ in docs])
    probe = [(9000, "the zorvan folk had a fine day"), (9001, "the meltic folk had a fine day")]
    change = {}
    for penalty in (0.0, 200.0):
        weights = toxicity.train(frame(spark, docs), marks, penalty=penalty, groups=groups)
        judge = toxicity.scorer(frame(spark), weights)
        s = {r["doc_id"]: r["s"] for r in frame(spark, probe).select("doc_id", judge(F.col("text")).alias("s")).collect()}
        change[penalty] = abs(np.log(s[9000] / (1 - s[9000])) - np.log(s[9001] / (1 - s[9001])))
        assert s[9001] < 0.5
    assert s[9000] < 0.5 and change[200.0] < 0.25 * change[0.0]


def test_empty_tables_and_repeats(spark):
    marks = labels(spark, [(1, 1, 0), (2, 0, 1)])
    for module in (toxicity, quality):
        judge = module.scorer(frame(spark), module.train(empty(spark), marks))
        assert empty(spark).select(judge(F.col("text")).alias("s")).count() == 0
    rows = frame(spark, [(5, "ab cd"), (5, "ab cd"), (6, "ab cd")])
    s = {r["s"] for r in rows.select(judge(F.col("text")).alias("s")).collect()}
    assert len(s) == 1
    model = langid.train(spark.createDataFrame([("en", "the and"), ("de", "der und")] * 5, "lang string, text string"))
    told = langid.predict(rows, model).collect()
    assert len(told) == 3 and len({(r["lang_pred"], r["score"]) for r in told}) == 1
