"""Fingerprints of short texts, and of texts on both sides of SHORT."""

import numpy as np

from tests.llm.cases import frame
from tidemark.llm import syncmers


def prose(n, seed=1):
    return "".join(map(chr, np.random.default_rng(seed).integers(97, 123, n)))


def test_texts_on_both_sides_of_short_are_compared():
    for n in (syncmers.SHORT - 1, syncmers.SHORT - 20):
        a = syncmers.fingerprint(prose(n))
        assert syncmers.likeness(a, syncmers.fingerprint(prose(n) + prose(syncmers.SHORT - n, 2))) > 0.6
        assert syncmers.likeness(a, syncmers.fingerprint(prose(n) + prose(n, 2))) > 0.2
        assert syncmers.likeness(a, syncmers.fingerprint(prose(400, 3))) < 0.1


def test_edit_that_shortens_below_short(spark):
    rows = [(2, prose(150)), (1, "")]
    got = {r["doc_id"]: r["near_edited"] for r in syncmers.edited_likeness(frame(spark, rows)).collect()}
    assert 0.5 < got[2] < 0.8


def test_every_text_with_a_letter_has_an_anchor():
    none = syncmers.fingerprint("")
    for n in range(1, 14):
        for seed in range(40):
            a, b = (syncmers.fingerprint(prose(n, k)) for k in (seed, seed + 1000))
            assert len(a.short.hashes) and syncmers.likeness(a, none) == 0 and syncmers.likeness(a, a) == 1
            assert n < 7 or syncmers.likeness(a, b) < 1
