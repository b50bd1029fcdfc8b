"""Every row of a table gets a fingerprint, and the anchors are those of a naive search."""

import hashlib

import numpy as np

from tests.llm.cases import LONG, TEXTS, empty, frame
from tidemark.llm import syncmers

ROWS = [*TEXTS, (None, "a text of a row without an id, long enough to have anchors of its own " * 3), (None, None), (20, "twice"), (20, "twice"), (21, LONG[:5000])]


def test_rows_without_id_repeated_rows_and_ties(spark):
    got = syncmers.edited_likeness(frame(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    text = sorted([(r["n_chars"], r["fingerprint"]) for r in got])
    assert text == sorted((len(t or ""), syncmers.as_text(syncmers.fingerprint(t or ""))) for _, t in ROWS)
    lone = sorted((r["n_chars"], r["edited_sha256"], r["near_edited"] <= 1.0) for r in got if r["doc_id"] is None)
    want = [(len(t or "") and len(t), hashlib.sha256((t or "")[: len(t or "") - len(t or "") // 3].encode()).hexdigest(), True) for i, t in ROWS if i is None]
    assert lone == sorted(want)
    order = sorted((i for i, _ in ROWS if i is not None), reverse=True)
    first = dict(ROWS)[order[0]]
    last = next(r for r in got if r["doc_id"] == order[-1])
    t = dict(ROWS)[order[-1]] or ""
    assert last["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 3] + first[: len(t) // 3]).encode()).hexdigest()
    assert syncmers.edited_likeness(empty(spark)).count() == 0


def test_every_document_of_a_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    order = sorted(docs, reverse=True)
    after = dict(zip(order, [*order[1:], order[0]], strict=True))
    got = syncmers.op3_syncmers(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        t, n = docs[r["doc_id"]], docs[after[r["doc_id"]]]
        edited = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert np.isclose(r["near_edited"], syncmers.likeness(syncmers.fingerprint(t), syncmers.fingerprint(edited)))
