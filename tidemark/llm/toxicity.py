"""Toxicity: a linear classifier with a counterfactual penalty.

A document's features are counts over its distinct words: the word and its first four to six
letters, hashed into 2^BITS weights. A feature takes part if it leans to one class by LEAN standard
errors at least, and its value is scaled by the log of its ratio between the classes, so that the
few telling stems outweigh the many chance ones. The weights are fitted by AdaGrad on the log loss, over a
bounded sample of labelled documents. Sentences of that sample that name a group (IDENTITY) are
rewritten with other groups' names, label unchanged; the squared change of the score between the
sentence and its counterfactual, averaged over a document's sentences, is part of the loss. What the
model learns thus cannot rest on which group is named, and a neutral mention of a group is not scored
as toxic. The classes of names are a parameter (`groups`): words of one class are swapped for each other.
Where no text of the sample names a group, the penalty has nothing to act on.

The score is a function of the text alone. Null and empty texts get the score of a document without
words. Repeated rows get equal scores; an empty table gives an empty result, and without labels every
text scores alike. Other columns are not read and can have any name. Fitting takes at most `bound` documents into one task; the
weights (4 x 2^BITS bytes) go to all tasks, where each worker keeps the scores of words it has met.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, remainder, small_batches
from .labelled import training_rows

#: Labelled documents that the fit may use.
BOUND = 12_000
BITS = 18
CACHED_WORDS = 500_000
STEMS = (4, 5, 6)
LEAN = 3.0

# Names of groups, in classes within which they are swapped.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("black", "white", "asian", "african", "european", "latino", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("musulman", "chrétien", "juif", "noir", "blanc"),
    ("muslime", "christen", "juden", "frauen", "männer"),
    ("musulmanes", "cristianos", "judíos", "mujeres", "hombres"),
)
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_SENTENCE = re.compile(r"[.!?\n]+")


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a word in lower case: itself and its first letters."""
    w = _EDGE.sub("", word)
    if not w:
        return ()
    keys = {w} | {f"^{k}{w[:k]}" for k in STEMS if len(w) > k}
    return tuple(zlib.crc32(k.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for k in keys)


def _features(text: str, known: dict[str, tuple[int, ...]]) -> np.ndarray:
    out: list[int] = []
    for w in set(text.lower().split()):
        found = known.get(w)
        if found is None:
            found = known[w] = word_features(w)
        out += found
    return np.array(out, np.int32)


def counterfactuals(text: str, rng: np.random.Generator, groups: Sequence[Sequence[str]] = IDENTITY) -> Iterator[tuple[str, str]]:
    """(sentence, the sentence with each group's name swapped for another of its class)."""
    known = {w: group for group in groups for w in group if len(group) > 1}
    for sentence in _SENTENCE.split(text.lower()):
        words = sentence.split()
        bare = [_EDGE.sub("", w) for w in words]
        if any(w in known for w in bare):
            swapped = [str(rng.choice([o for o in known[b] if o != b])) if b in known else w for w, b in zip(words, bare, strict=True)]
            yield sentence, " ".join(swapped)


def leaning(rows: list[np.ndarray], y: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    """Log ratio of each feature's frequency between the classes; 0 where it may be chance."""
    toxic, clean = np.zeros(size), np.zeros(size)
    for r, label in zip(rows, y, strict=True):
        (toxic if label else clean)[np.unique(r)] += 1
    n, n1 = max(1, len(y)), y.sum()
    expected = (toxic + clean) * n1 / n
    error = np.sqrt(expected * (1 - (toxic + clean) / n) * (1 - n1 / n) + 0.25)
    ratio = np.log((toxic + smooth) / (n1 + 2 * smooth)) - np.log((clean + smooth) / (n - n1 + 2 * smooth))
    return np.where(np.abs(toxic - expected) >= LEAN * error, ratio, 0.0)


def fit(y: np.ndarray, texts: list[str], penalty: float = 4.0, ridge: float = 1e-4, epochs: int = 6, rate: float = 0.1, seed: int = 7, groups: Sequence[Sequence[str]] = IDENTITY) -> np.ndarray:
    """Weights, the bias last. penalty: weight of the squared score change between counterfactuals."""
    size = 1 << BITS
    rng = np.random.default_rng(seed)
    known: dict[str, tuple[int, ...]] = {}
    rows = [_features(t, known) for t in texts]
    pairs = [[(_features(a, known), _features(b, known)) for a, b in counterfactuals(t, rng, groups)] for t in texts]
    scale = leaning(rows, y, size)
    rows = [r[scale[r] != 0] for r in rows]
    w, squares = np.zeros(size + 1), np.full(size + 1, 1e-8)
    rate_of = y.mean() if len(y) else 0.5
    w[-1] = math.log((rate_of + 1e-3) / (1 - rate_of + 1e-3))
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            batch = [i for i in order[at : at + 64]]
            index = np.concatenate([np.append(rows[i], size) for i in batch])
            which = np.repeat(np.arange(len(batch)), [len(rows[i]) + 1 for i in batch])
            value = np.append(scale, 1.0)[index]
            z = np.bincount(which, w[index] * value, len(batch))
            miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]
            gradient = np.bincount(index, value * miss[which], size + 1)
            for i in batch:
                share = penalty / max(1, len(pairs[i]))
                for a, b in pairs[i]:
                    change = (w[a] * scale[a]).sum() - (w[b] * scale[b]).sum()
                    np.add.at(gradient, a, share * change * scale[a])
                    np.add.at(gradient, b, -share * change * scale[b])
            touched = np.flatnonzero(gradient)
            g = gradient[touched] / len(batch) + ridge * w[touched]
            squares[touched] += g * g
            w[touched] -= rate * g / np.sqrt(squares[touched])
    w[:-1] *= scale
    return w.astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, bound: int = BOUND, **fit_options) -> np.ndarray:
    """Fit on at most `bound` labelled rows, in one task."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["text", "y"])
        return pd.DataFrame({"w": [fit(p["y"].to_numpy(), p["text"].tolist(), **fit_options).tobytes()]})

    rows = training_rows(docs, labels, "toxic", bound)
    found = rows.withColumn("task", F.lit(1)).groupBy("task").applyInPandas(run, "w binary").collect()  # one row of 1 MB
    if not found:
        return np.zeros((1 << BITS) + 1, np.float32)
    return np.frombuffer(found[0]["w"], np.float32)


class _Scorer:
    """Scores texts; keeps the scores of words it has met."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.known = weights, {}

    def word(self, word: str) -> float:
        self.known[word] = s = float(sum(self.weights[i] for i in word_features(word)))
        return s

    def texts(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        known, bias, z = self.known, float(self.weights[-1]), []
        for t in texts:
            words = set(t.lower().split())
            for w in words.difference(known):
                self.word(w)
            z.append(math.fsum(map(known.__getitem__, words)) + bias)
        return 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))


def scorer(docs: DataFrame, weights: np.ndarray):
    """A function from a text column to its score, run in Arrow batches."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _Scorer(sent.value)
        for texts in batches:
            yield pd.Series(own.texts(texts.tolist()))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(run, "double")
    return lambda text: udf(F.coalesce(text, F.lit("")))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text", **fit_options) -> DataFrame:
    """docs without the rows whose text scores at or above the threshold; all columns stay.

    The score is made where the row is: no join, and rows without an id are judged too.
    """
    judge = scorer(docs, train(docs, labels, **fit_options))
    return docs.filter(judge(F.col(text_col)) < threshold)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every text of `documents`, learnt from `labels` outside the held-out fifth."""
    docs = documents(spark, sf_dir)
    judge = scorer(docs, train(docs, documents(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", judge(F.col("text")).alias("score"))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
