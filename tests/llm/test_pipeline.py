"""The pipeline against plain Python, stage by stage, and the queries on given tables."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import SMALL, same_rows
from tests.llm.cases import empty, frame, labels
from tests.llm.test_exact_and_near import brute_components
from tidemark.llm import queries, secrets, toxicity
from tidemark.llm.common import documents


def held(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def test_every_stage_against_plain_python(spark):
    docs = documents(spark, SMALL)
    columns, before = docs.columns, held(docs)
    weights = toxicity.train(docs, documents(spark, SMALL, "labels"))
    ids = sorted(before)
    score = dict(zip(ids, toxicity._Scorer(weights).texts([before[i] or "" for i in ids]), strict=True))
    stages = dict(corpus_pipeline.STAGES)

    docs = corpus_pipeline.materialize(stages["toxicity"](spark, docs, SMALL))
    after = held(docs)
    assert after == {i: t for i, t in before.items() if score[i] < 0.5} and 0 < len(before) - len(after) < 0.3 * len(before)

    best = {}
    for i, t in after.items():
        best[t or ""] = max(i, best.get(t or "", i))
    docs = corpus_pipeline.materialize(stages["exact_dedup"](spark, docs, SMALL))
    exact = held(docs)
    assert exact == {i: after[i] for i in best.values()}

    component = brute_components(list(exact.items()), 5, 80)
    docs = corpus_pipeline.materialize(stages["minhash"](spark, docs, SMALL))
    near = held(docs)
    assert near == {i: t for i, t in exact.items() if component[i][1] == i}

    spans = {r["doc_id"]: [(s["start"], s["stop"]) for s in r["spans"]] for r in secrets.scan(docs).collect()}
    docs = corpus_pipeline.materialize(stages["secrets"](spark, docs, SMALL))
    assert docs.columns == columns
    for i, t in held(docs).items():
        want, at = [], 0
        for a, z in sorted(spans[i]):
            want += [near[i][at:a], "[SECRET]"] if a >= at else []
            at = max(at, z)
        assert t == ("".join(want) + near[i][at:] if spans[i] else near[i])

    encode = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))).encode
    tokens = {i: [*encode(t or "", add_special_tokens=False).ids, 2] for i, t in held(docs).items()}
    covered, filled = {i: 0 for i in tokens}, {}
    for r in sorted(stages["packing"](spark, docs, SMALL).collect(), key=lambda r: (r["doc_id"], r["start"])):
        part = tokens[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == covered[r["doc_id"]] and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        covered[r["doc_id"]] += r["length"]
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert covered == {i: len(x) for i, x in tokens.items()}
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


def test_stages_with_nulls_repeats_and_an_empty_table(spark, tmp_path):
    rows = [(1, None), (2, ""), (None, "fine day"), (3, "one two three four five six"), (3, "one two three four five six"), (4, "token = 'abcdEFGH1234'")]
    docs, none = frame(spark, rows), empty(spark)
    labels(spark, [(1, 1, 0), (4, 1, 0)]).write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, none = (corpus_pipeline.materialize(stage(spark, d, str(tmp_path))) for d in (docs, none))
        assert none.count() == 0 and docs.columns == none.columns, name
    left = sorted((str(r["doc_id"]), r["text"] or "") for r in docs.collect())
    assert left == [("2", ""), ("3", "one two three four five six"), ("4", "[SECRET]'"), ("None", "fine day")]
    assert corpus_pipeline.STAGES[-1][1](spark, none, str(tmp_path)).count() == 0


def test_exact_dedup_oracle(spark, duck):
    same_rows(queries.QUERIES["op7_exact_dedup"](spark, SMALL), duck, queries.ORACLE_SQL["op7_exact_dedup"])
