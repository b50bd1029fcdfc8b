"""Language identification of spans by Viterbi over per-word scores.

Words are runs of letters. Training counts, over all training rows, how often each three-letter
window (with a mark beyond a word's ends) and each pair of letters occurs in each language; windows
are hashed into 2^BITS places. A word's score for a language is the sum of its windows' log
probabilities, over the root of its length, against the best language, at least `-CLIP`. Before that,
the script of its first letter (by Unicode range) narrows the candidates to the languages seen in
that script in training; others get `-CLIP`.

A text is labelled word by word: the best path through the word scores with a penalty for every
change of language (Viterbi). The recursion isn't run where the constant path in the text's best
language provably wins: k stretches pay k - 1 changes, so they can't gain if no stretch favours
another language by more than the penalty, and the best first and last stretch don't in sum.
Neighbouring words of one label form a span.

Null texts and texts without a letter have no span and the language `und` with score 0. Prediction
reads the text alone, and all of it. The model holds every window of the training rows, at most
2 x 2^BITS places a language; its counts come to the driver in packed blocks, one at a time, and it
is sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, remainder, small_batches

BITS = 18
CLIP = 3.0
PENALTY = 6.0

# Scripts as ranges of code points.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("latin", 0x1E00, 0x1EFF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)


_NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and its script's place in _NAMES."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    script = np.zeros(0x110000, np.uint8)
    for name, a, b in SCRIPTS:
        script[a : b + 1] = _NAMES.index(name)
    return letter, script


def windows(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the letters; for each letter the places of its three-letter window and of its
    pair; and where each word starts among the letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter, _ = _letters()
    is_letter = letter[points]
    at = np.flatnonzero(is_letter)
    c = np.zeros(len(points) + 2, np.uint32)
    c[1:-1] = np.where(is_letter, points, 0)
    left, own, right = c[at], c[at + 1], c[at + 2]
    pair = own * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)
    three = (pair ^ (pair >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + left * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - BITS)
    return own, (three ^ (three >> np.uint32(13))) * np.uint32(0x165667B1) >> shift, pair * np.uint32(0x165667B1) >> shift, np.flatnonzero(left == 0)


def counted(rows: DataFrame) -> DataFrame:
    """(lang, place, n) over all rows (lang, text); places below 0 are scripts. Each task adds up its rows first."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["lang"].tolist(), b["text"].tolist(), strict=True):
                letters, three, pair, _ = windows(text)
                if lang not in sums:
                    sums[lang] = np.zeros(len(_NAMES) + (2 << BITS), np.int64)
                if len(letters):
                    n = sums[lang]
                    n[: len(_NAMES)] += np.bincount(_letters()[1][letters], minlength=len(_NAMES))
                    np.add.at(n, len(_NAMES) + three.astype(np.int64), 1)
                    np.add.at(n, len(_NAMES) + (1 << BITS) + pair.astype(np.int64), 1)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "place": at - len(_NAMES), "n": n[at]})

    partial = rows.mapInPandas(run, "lang string, place long, n long")
    return partial.groupBy("lang", "place").agg(F.sum("n").alias("n"))


class Model:
    """Log probabilities of windows by language, and which languages a script may hold."""

    def __init__(self, langs: list[str], places: np.ndarray, counts: np.ndarray, scripts: np.ndarray):
        """counts: (places, languages); scripts: letters of each script, (scripts, languages)."""
        self.langs = langs
        self.log = np.zeros((2 << BITS, len(langs)), np.float32)
        for half in (places < 1 << BITS, places >= 1 << BITS):
            n = counts[half] + 0.5
            log = np.log(n / n.sum(axis=0, keepdims=True)) if half.any() else n
            self.log[places[half]] = log - log.mean(axis=1, keepdims=True)
        seen = scripts > 0.001 * np.maximum(scripts.sum(axis=0, keepdims=True), 1)
        self.fits = np.where(seen.any(axis=1, keepdims=True), seen, True)

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Scores (words, languages), and letters of each word."""
        letters, three, pair, first = windows(text)
        if not len(letters):
            return np.zeros((0, len(self.langs)), np.float32), np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(letters)))
        s = np.add.reduceat(self.log[three] + self.log[(1 << BITS) + pair.astype(np.int64)], first, axis=0)
        s /= np.sqrt(2 * n, dtype=np.float32)[:, None]
        s = np.maximum(s - s.max(axis=1, keepdims=True), -CLIP)
        return np.where(self.fits[_letters()[1][letters[first]]], s, np.float32(-CLIP)), n

    def path(self, s: np.ndarray, penalty: float) -> np.ndarray:
        """The label of each word on the best path; s: (words, languages)."""
        best = int(s.sum(axis=0, dtype=float).argmax())
        gain = np.cumsum(s - s[:, best : best + 1], axis=0, dtype=float)
        low = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
        before = np.concatenate((np.zeros((1, s.shape[1])), low[:-1]))
        first, last = max(0.0, gain.max()), max(0.0, (gain[-1] - before).max())
        if (gain - before).max() <= penalty and first + last <= penalty:
            return np.full(len(s), best)
        value, back = s[0].astype(float), np.empty(s.shape, np.int64)
        own = np.arange(s.shape[1])
        for t in range(1, len(s)):
            top = int(value.argmax())
            change = value[top] - penalty > value
            back[t] = np.where(change, top, own)
            value = np.where(change, value[top] - penalty, value) + s[t]
        out = np.empty(len(s), np.int64)
        out[-1] = value.argmax()
        for t in range(len(s) - 1, 0, -1):
            out[t - 1] = back[t][out[t]]
        return out

    def label(self, text: str, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
        """The language of each word on the best path, and its number of letters."""
        s, n = self.words(text)
        return (self.path(s, penalty), n) if len(s) and self.langs else (np.zeros(0, np.int64), n[:0])

    def predict(self, text: str) -> tuple[str, float]:
        """The language of most letters on the best path, and its share of them."""
        path, letters = self.label(text)
        if not len(path):
            return "und", 0.0
        share = np.bincount(path, letters, len(self.langs)) / letters.sum()
        top = int(share.argmax())
        return self.langs[top], float(share[top])


def train(rows: DataFrame) -> Model:
    """A model of rows (lang, text). Null languages and texts are left out."""

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": p["lang"].iloc[:1], "places": [p["place"].to_numpy(np.int32).tobytes()], "n": [p["n"].to_numpy(np.int64).tobytes()]})

    counts = counted(rows.filter("lang IS NOT NULL AND text IS NOT NULL"))
    blocks = counts.groupBy("lang", F.shiftright("place", 16).alias("block")).applyInPandas(pack, "lang string, places binary, n binary")
    by_lang: dict[str, np.ndarray] = {}
    for r in blocks.toLocalIterator():  # at most 9 rows a language, 65,536 places each
        n = by_lang.setdefault(r["lang"], np.zeros(len(_NAMES) + (2 << BITS)))
        n[np.frombuffer(r["places"], np.int32) + len(_NAMES)] = np.frombuffer(r["n"], np.int64)
    langs = sorted(by_lang)
    table = np.stack([by_lang[a] for a in langs], axis=1) if langs else np.zeros((len(_NAMES) + (2 << BITS), 0))
    places = np.flatnonzero(table[len(_NAMES) :].any(axis=1))
    return Model(langs, places, table[len(_NAMES) + places], table[: len(_NAMES)])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score (share of the letters in that language)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for b in batches:
            found = [own.predict(t) for t in b["text"].tolist()]
            yield pd.DataFrame({"id": b["id"], "lang_pred": [x for x, _ in found], "score": [y for _, y in found]})

    kind = docs.schema[id_col].dataType.simpleString()
    thin = docs.selectExpr(f"`{id_col}` AS id", f"coalesce(`{text_col}`, '') AS text")
    return thin.mapInPandas(run, f"id {kind}, lang_pred string, score double").toDF(id_col, "lang_pred", "score")


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span: id, first_word, n_words, lang."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for b in batches:
            rows = []
            for doc, text in zip(b["id"].tolist(), b["text"].tolist(), strict=True):
                path, _ = own.label(text)
                if len(path):
                    cut = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1], [True])))
                    rows += [(doc, int(a), int(z - a), own.langs[path[a]]) for a, z in zip(cut[:-1], cut[1:], strict=True)]
            yield pd.DataFrame(rows, columns=["id", "first_word", "n_words", "lang"])

    kind = docs.schema[id_col].dataType.simpleString()
    thin = docs.selectExpr(f"`{id_col}` AS id", f"coalesce(`{text_col}`, '') AS text")
    return thin.mapInPandas(run, f"id {kind}, first_word long, n_words long, lang string").toDF(id_col, "first_word", "n_words", "lang")


def op2_language(spark, sf_dir: str) -> DataFrame:
    """Languages of `documents`, learnt outside the held-out third."""
    docs = documents(spark, sf_dir)
    model = train(docs.filter(remainder("doc_id", 3) != 1).select("lang", "text"))
    found = predict(docs, model)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
