"""The best path of mixed texts, and models of many windows."""

import itertools

import numpy as np

from tidemark.llm import langid


def plain_model(n):
    return langid.Model([f"l{i}" for i in range(n)], np.zeros(0, np.int64), np.zeros((0, n)), np.ones((len(langid._NAMES), n)))


def worth(s, path):
    return s[np.arange(len(s)), path].sum() - 6.0 * (np.diff(path) != 0).sum()


def test_two_languages_beat_a_third_that_wins_no_word():
    s = np.full((12, 3), -1, np.float32)
    s[:6, 0], s[6:, 0], s[:6, 1], s[6:, 1] = 0, -3, -3, 0
    assert plain_model(3).path(s, 6.0).tolist() == [0] * 6 + [1] * 6


def test_shortcut_equals_every_path():
    rng = np.random.default_rng(8)
    for _ in range(60):
        s = np.repeat(-rng.integers(0, 4, (4, 3)), 2, axis=0).astype(np.float32) * rng.choice([1.0, 1.5])
        best = max(worth(s, np.array(p)) for p in itertools.product(range(3), repeat=8))
        assert abs(worth(s, plain_model(3).path(s, 6.0)) - best) < 1e-3


def test_windows_of_a_rare_language_are_kept(spark):
    rng = np.random.default_rng(6)
    words = lambda n: ["".join(map(chr, rng.integers(0x4E00, 0x9F00, 4))) for _ in range(n)]
    often = " ".join(words(40_000))
    used = np.zeros((2, 1 << langid.BITS), bool)
    for half, at in zip(used, langid.windows(often)[1:3], strict=True):
        half[at] = True
    apart = lambda w: not any(half[at].any() for half, at in zip(used, langid.windows(w)[1:3], strict=True))
    rare = [w for w in words(40_000) if apart(w)][:20]
    assert len(rare) == 20
    model = langid.train(spark.createDataFrame([("a", often), ("a", often), ("b", " ".join(rare))], "lang string, text string"))
    assert model.langs == ["a", "b"] and model.predict(" ".join(rare)) == ("b", 1.0)
