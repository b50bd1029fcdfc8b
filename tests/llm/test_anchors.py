"""Repeated anchors against a plain count, with a passage that very many documents share."""

import numpy as np

from tidemark.llm import substrings


def test_a_passage_of_many_documents_is_one_number_a_flush(spark, monkeypatch):
    made = np.random.default_rng(4)
    passage = "the same sixty bytes stand in every one of these short texts"
    texts = [(i, " ".join(f"{x:06d}" for x in made.integers(0, 10**6, 9)) + passage + str(i)) for i in range(3000)] + [(9000, "too short"), (9001, passage + "0")]
    monkeypatch.setattr(substrings, "HELD", 4000)
    df = spark.createDataFrame(texts, "id long, text string").repartition(4)
    bits, seen = 36, {}
    for i, t in texts:
        at, h = substrings.anchored(np.frombuffer(t.encode(), np.uint8))
        for a in np.unique(h[at] >> np.uint64(64 - bits)).tolist():
            seen.setdefault(a, set()).add(i)
    for crowded in (100, 10**6):
        flag = substrings._FLAG
        want = sorted((i, a | (flag if len(ids) > crowded else 0)) for a, ids in seen.items() if len(ids) > 1 for i in ids)
        got = sorted((r["id"], r["hash"]) for r in substrings.repeated_anchors(df, bits, 50, 20, crowded).collect())
        assert got == want
    assert max(map(len, seen.values())) > 2900  # a hot anchor indeed


def test_buckets_get_a_row_a_flush(spark, monkeypatch):
    """What meets in a bucket does not grow with the documents of an anchor."""
    import pandas as pd

    passage = "x" * 70
    monkeypatch.setattr(substrings, "HELD", 10**6)
    df = spark.createDataFrame([(i, passage) for i in range(5000)], "id long, text string").repartition(2)
    kept = []
    monkeypatch.setattr(substrings, "materialize", lambda rows, **_: kept.append(rows.cache()) or kept[-1])
    assert substrings.repeated_anchors(df, 36, 50, 20, 10**6).count() == 5000
    rows = kept[0].toPandas()
    assert isinstance(rows, pd.DataFrame) and len(rows) == 2 and all(len(substrings._unpack(x)[0]) == 1 for x in rows["anchors"])
