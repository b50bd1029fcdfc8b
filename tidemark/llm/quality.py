"""Quality: Naive Bayes support vectors over n-gram indicators.

A text is reduced to what its looks tell: letters become a class (small, capital, accented), digits
one class, marks stay themselves. Its indicators are the n-grams of this character string for n = 1
to 3, and those of word shapes: a word's shape with its neighbour's, and whether a word or a line
repeats the one before. They are hashed into 2^BITS places. Each indicator is scaled by the log
ratio of its counts in the two classes (Naive Bayes), and a linear hinge-loss model is fitted on the
scaled indicators by dual coordinate descent. A logistic curve over the margins of the fit turns the
margin of a text into a score from 0 to 1.

The score depends on the text alone; whole texts are read. Null and empty texts have no indicators
and get the score of the intercept. Fitting takes at most `bound` labelled documents into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, remainder, small_batches
from .labelled import training_rows

#: Labelled documents that the fit may use.
BOUND = 12_000
BITS = 17

_GRAMS = 1 << 15  # room for character n-grams: 32 classes, three in a row
_SHAPES = 1 << 16


def _classes() -> np.ndarray:
    """The class, 0 to 31, of each byte of UTF-8: 1 small, 2 capital, 3 digit, 4 beyond ASCII, 5 blank, 6 line end, marks from 7."""
    out = np.zeros(256, np.int64)
    out[128:] = 4
    for b in range(128):
        c = chr(b)
        out[b] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 6 if c == "\n" else 5 if c.isspace() else 7 + b % 25
    return out


_CLASS = _classes()


def indicators(text: str) -> np.ndarray:
    """The distinct hashed indicators of a text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    seen = np.zeros(1 << BITS, bool)
    if not len(raw):
        return np.flatnonzero(seen)
    c = _CLASS[raw]
    seen[c] = True
    if len(c) > 1:
        seen[1024 + (c[:-1] * 32 + c[1:]) % 1024] = True
    if len(c) > 2:
        seen[_GRAMS + (c[:-2] * 32 + c[1:-1]) * 32 + c[2:]] = True
    # words: where they start, their length, first and last class, and a sum of their bytes
    blank = (c == 5) | (c == 6)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    if len(start):
        n = np.minimum(stop - start, 15)
        shape = (c[start] * 32 + c[stop - 1]) * 16 + n
        total = np.concatenate(([0], np.cumsum(raw.astype(np.uint64))))
        squares = np.concatenate(([0], np.cumsum(raw.astype(np.uint64) ** 2)))
        mark = (total[stop] - total[start]) * np.uint64(31) + (squares[stop] - squares[start]) + raw[start].astype(np.uint64) * np.uint64(131071)
        same = (mark[1:] == mark[:-1]) & (n[1:] == n[:-1])
        seen[_SHAPES + (shape % 16384)] = True
        seen[_SHAPES + 16384 + (shape[:-1] * 31 + shape[1:]) % 16384] = True
        if same.any():
            seen[2048] = True
            run = np.diff(np.flatnonzero(np.concatenate(([True], ~same, [True])))).max()
            seen[2049 : 2049 + min(20, int(run))] = True
        # how often words recur: distinct words to all words, in tenths
        seen[2080 + int(10 * len(np.unique(mark)) / len(mark))] = True
        lines = [x for x in text.split("\n") if x]
        seen[2100 + int(10 * len(set(lines)) / max(1, len(lines)))] = True
    return np.flatnonzero(seen).astype(np.int32)


def fit(y: np.ndarray, rows: list[np.ndarray], c: float = 0.1, epochs: int = 12, smooth: float = 1.0, seed: int = 7) -> np.ndarray:
    """Weights of the indicators, then the intercept, then slope and shift of the logistic curve."""
    size = 1 << BITS
    good, bad = np.full(size, smooth), np.full(size, smooth)
    for r, label in zip(rows, y, strict=True):
        (good if label else bad)[r] += 1
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    sign = np.where(y > 0, 1.0, -1.0)
    # the rarer class weighs more, so that both count alike
    cost = np.where(y > 0, c * len(y) / max(1, 2 * (y > 0).sum()), c * len(y) / max(1, 2 * (y <= 0).sum()))
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    scaled = [ratio[r] for r in rows]
    norm = np.array([(x * x).sum() + 1.0 for x in scaled]) if rows else np.zeros(0)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            slope = sign[i] * (w[rows[i]] @ scaled[i] + bias) - 1.0
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * scaled[i]
                bias += step
    margin = np.array([w[r] @ x + bias for r, x in zip(rows, scaled, strict=True)])
    a, b = 2.0, 0.0
    for _ in range(200):  # logistic regression on the margin, by gradient steps
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        miss = p - (y > 0)
        a, b = a - 0.5 * (miss * margin).mean() if len(y) else a, b - 0.5 * miss.mean() if len(y) else b
    return np.concatenate((w * ratio, [bias, max(a, 0.1), b]))


def train(docs: DataFrame, labels: DataFrame, bound: int = BOUND, **fit_options) -> np.ndarray:
    """Fit on at most `bound` labelled rows, in one task; their indicators are made where the texts are."""
    small_batches(docs.sparkSession)

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "x": [indicators(t).tobytes() for t in b["text"].tolist()]})

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["x", "y"])
        rows = [np.frombuffer(x, np.int32) for x in p["x"]]
        return pd.DataFrame({"w": [fit(p["y"].to_numpy(), rows, **fit_options).tobytes()]})

    rows = training_rows(docs, labels, "quality", bound).mapInPandas(marks, "y double, x binary")
    found = rows.withColumn("task", F.lit(1)).groupBy("task").applyInPandas(run, "w binary").collect()  # one row of 1 MB
    if not found:
        return np.concatenate((np.zeros((1 << BITS) + 1), [1.0, 0.0]))
    return np.frombuffer(found[0]["w"], float)


def scorer(docs: DataFrame, weights: np.ndarray):
    """A function from a text column to its score, run in Arrow batches."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, (bias, a, b) = sent.value[:-3], sent.value[-3:]
        for texts in batches:
            margin = np.array([w[indicators(t)].sum() + bias for t in texts.tolist()], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30))))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(run, "double")
    return lambda text: udf(F.coalesce(text, F.lit("")))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every text of `documents`, learnt from `labels` outside the held-out fifth."""
    docs = documents(spark, sf_dir)
    judge = scorer(docs, train(docs, documents(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", judge(F.col("text")).alias("score"))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
