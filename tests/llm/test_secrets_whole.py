"""Short keys, keys in paths, and what known forms leave of a run."""

import hashlib
import math
import random
import re
import string

from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.cases import empty, frame
from tidemark.llm import secrets

KEY = "Zq3xK9vT1bLw8RmYp0dHc6NfJs2"


def random_parts(spark, texts):
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(frame(spark, rows)).collect()}
    return [[t[s["start"] : s["stop"]] for s in got[i] if s["kind"] == "random"] for i, t in rows]


def test_short_keys(spark):
    texts = ["the key q7Zr2KxV9mTb4LwY here", "and Xk4Tz9Qw2Vb7 too", "congratulations from administration on 12345678901234"]
    assert random_parts(spark, texts) == [["q7Zr2KxV9mTb4LwY"], ["Xk4Tz9Qw2Vb7"], []]
    out = secrets.redact(frame(spark, [(0, texts[0])])).first()["text"]
    assert out == "the key [SECRET] here"


def test_keys_in_runs_that_no_encoding_fits(spark):
    texts = [f"see /reset-password/{KEY} now", f"é https://host.example/a_b/{KEY}/some-page", f"/one-two/{KEY}/and-then/ordinary/{KEY[::-1]}/x", "/some-long/path_of/ordinary-words/without_a/single-secret"]
    assert random_parts(spark, texts) == [[KEY], [KEY], [KEY, KEY[::-1]], []]
    assert KEY not in secrets.redact(frame(spark, [(0, texts[0])])).first()["text"]


def test_rest_of_a_run_beside_a_known_form(spark):
    known = "0123456789abcdef0123456789abcdef"
    got = random_parts(spark, [f"{KEY}/{known}", f"{known}/{KEY}-{known} x", f"{known} x"])
    assert [[KEY in p for p in parts] for parts in got] == [[True], [True], []]


def test_planted_tokens_are_found_and_words_are_not(spark):
    rng = random.Random(11)
    alphabets = {"hex": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "base64url": string.ascii_letters + string.digits + "-_"}
    words = "and the then there other nation station international responsibility administration communication understanding congratulations counterrevolutionary uncharacteristically".split()
    planted = {k: ["".join(rng.choice(a) for _ in range(n)) for n in (20, 24, 32, 40) for _ in range(15)] for k, a in alphabets.items()}
    texts = [" ".join([rng.choice(words) for _ in range(60)] + [token] + [rng.choice(words) for _ in range(20)]) for tokens in planted.values() for token in tokens]
    plain = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(100)]
    got = random_parts(spark, texts + plain)
    hits = dict.fromkeys(alphabets, 0)
    for (kind, token), parts in zip([(k, t) for k, tokens in planted.items() for t in tokens], got, strict=False):
        hits[kind] += any(len(p) >= 0.8 * len(token) and p in token for p in parts)
    assert all(n >= 0.9 * 60 for k, n in hits.items()), hits
    assert not any(got[len(texts) :])


def test_the_battery_sets_patterns_aside(spark):
    patterns = ["ZQXZQXZQXZQXZQXZQXZQXZQX", "AbCdEfGhIjKlMnOpQrStUvWx", "X9X9X9X9X9X9X9X9X9X9X9X9"]
    assert random_parts(spark, [f"a {p} b" for p in patterns]) == [[], [], []]
    assert random_parts(spark, [f"a {KEY} b"]) == [[KEY]]


def test_joint_p_values_of_random_tokens_are_never_too_small(spark):
    """Share of random tokens at or under a nominal p-value, by alphabet and length; and the share set aside."""
    rng = random.Random(5)
    n = 12_000
    cases = [("0123456789abcdef", 12), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 20), (string.digits + string.ascii_lowercase, 16), (string.ascii_letters + string.digits, 16), (string.ascii_letters + string.digits + "+/", 40), (string.ascii_letters + string.digits, 64)]
    rows = [(k, "".join(rng.choices(a, k=length))) for k, (a, length) in enumerate(cases) for _ in range(n)]
    one = F.array(F.struct(F.lit(0).alias("start"), F.length("token").alias("stop"), "token", F.lit(False).alias("cut")))
    tested = spark.createDataFrame(rows, "k int, token string").repartition(8).select("k", secrets.battery(secrets.evidence(one)).alias("tokens"), F.array().cast("array<int>").alias("without"))
    tested = secrets.materialize(tested)
    fit = F.col("tokens")[0]["fit"]
    levels = (0.05, 0.01, 0.001, 2.0**-secrets.MAX_FIT)
    got = tested.groupBy("k").agg(*[F.sum(F.when(fit <= a, 1).otherwise(0)).alias(f"p{i}") for i, a in enumerate(levels)]).collect()
    assert len(got) == len(cases)
    for r in got:
        for i, a in enumerate(levels):
            assert r[f"p{i}"] <= a * n + 3 * (a * n) ** 0.5 + 1, (cases[r["k"]], a, r[f"p{i}"] / n)
        assert r["p0"] >= 0.2 * levels[0] * n and r["p1"] >= 0.1 * levels[1] * n, cases[r["k"]]  # nor far too large: discrete statistics, two-fold count
    found = secrets.thresholds(tested)
    for r in tested.select(F.explode("tokens").alias("t")).select(secrets.length_class(F.length("t.token")).alias("c"), secrets._fit_bits(F.col("t.fit")).alias("f")).groupBy("c").agg(F.collect_list("f").alias("fs")).collect():
        assert sum(f >= found[r["c"]][0] for f in r["fs"]) <= secrets.FDR * len(r["fs"])


def test_tail_of_the_normal(spark):
    points = [-3.0, -0.5, 0.0, 0.7, 2.0, 4.0, 6.5]
    got = spark.createDataFrame([(z,) for z in points], "z double").select(secrets._upper_tail(F.col("z"))).collect()
    assert all(abs(r[0] / (math.erfc(z / math.sqrt(2)) / 2) - 1) < 1e-6 for z, r in zip(points, got, strict=True))


def test_query_against_plain_python(spark):
    found = {r["doc_id"]: r for r in secrets.op1_secret_scan(spark, SMALL).collect()}
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        text = r["text"] or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        told = ",".join(f"{k}:{a}:{z}" for a, _, z, k in sorted(spans))
        got = found[r["doc_id"]]
        assert got["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert (got["n_assign"], got["n_access"], got["n_hex"]) == tuple(sum(s[3] == k for s in spans) for k in ("assign", "access", "hex"))


def test_nulls_empties_repeats_and_empty_tables(spark):
    rows = [(1, None), (2, ""), (None, f"x {KEY} y"), (3, f"x {KEY} y"), (3, f"x {KEY} y"), (4, "é" * 5000 + f" {KEY}")]
    got = [(r["doc_id"], len(r["spans"])) for r in secrets.scan(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (2, 0), (None, 1), (3, 1), (3, 1), (4, 1)], key=str)
    assert secrets.scan(empty(spark)).count() == 0 and secrets.redact(empty(spark)).count() == 0
