"""What a Python worker still holds when a task has ended."""

import pandas as pd
import public_tokenizers
import pytest

from tests.llm.cases import frame
from tidemark.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("encoded", [bpe.encode, bpe.digests, packing.pieces])
def test_words_met_go_with_the_task(spark, encoded):
    docs = frame(spark, [(i, f"some words and number{i} and again number{i}") for i in range(400)]).repartition(8)

    def held(batches):
        from tidemark.llm.bpe import Encoder

        for _ in batches:
            yield pd.DataFrame({"encoders": [len(Encoder.loaded)], "words": [sum(len(e.known) + len(e.older) for e in Encoder.loaded.values())]})

    encoded(docs, PATH).collect()
    workers = spark.range(8, numPartitions=8).mapInPandas(held, "encoders long, words long").collect()
    assert any(w["encoders"] for w in workers)  # workers of the tasks before
    assert all(w["words"] == 0 for w in workers)
