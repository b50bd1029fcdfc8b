import hashlib
import itertools
import re

from pyspark.sql import functions as F

from tidemark.llm import components, exact_dedup, minhash
from tidemark.llm.shingles import shingles
from tests.llm.cases import LONG, TEXTS, empty, frame


def test_exact_against_groups(spark):
    for keep, best in (("smallest", min), ("largest", max)):
        got = {r["doc_id"]: r for r in exact_dedup.duplicate_table(frame(spark), keep=keep, runs=8, fan_in=2).collect()}
        for i, t in TEXTS:
            same = [j for j, u in TEXTS if (u or "") == (t or "")]
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (best(same), len(same), i == best(same))
            assert r["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_repeated_rows_empty_table_and_columns(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (3, "b"), (3, "b"), (None, "c"), (None, "c")]
    df = frame(spark, rows)
    kept = exact_dedup.drop_exact_duplicates(df, keep="largest")
    assert kept.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("2", "a"), ("3", "b"), ("None", "c")]
    assert exact_dedup.duplicate_table(empty(spark)).count() == 0 == exact_dedup.drop_exact_duplicates(empty(spark)).count()


def brute_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((top(a), top(b)))
            root[q] = p
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_near_against_all_pairs(spark):
    words = [f"w{i}" for i in range(80)]
    chain = [(100 + k, " ".join(words[k:] + [f"x{j}" for j in range(k)])) for k in range(12)]  # neighbours are linked, ends are not
    noise = [(200 + k, " ".join([*words[:40], *(f"n{k}-{j}" for j in range(40))])) for k in range(8)]  # a common half, no link
    rows = TEXTS + chain + noise
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, rows), words=4, percent=80).collect()}
    assert got == brute_components(rows, 4, 80)


def test_near_edges(spark):
    df = frame(spark, [*TEXTS, (None, LONG)])
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert None in ids and 15 not in ids and 6 not in ids and {1, 2, 3, 13} <= set(ids)
    assert minhash.near_duplicates(empty(spark)).count() == 0
    odd = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame(spark, [(None, LONG), (None, None), (5, LONG), (5, LONG)])).collect()}
    assert odd == {(None, None, True), (5, 5, True)}


def test_the_estimate_decides_which_pairs_are_checked(spark):
    words = [f"w{i}" for i in range(300)]
    near = [(k, " ".join([*words[: 300 - k], *(f"a{k}-{j}" for j in range(k))])) for k in range(0, 30, 3)]
    far = [(100 + k, " ".join([*words[:160], *(f"b{k}-{j}" for j in range(140))])) for k in range(40)]
    texts = dict(near + far)
    rows = minhash.sketched(frame(spark, near + far).select(F.col("doc_id").alias("id"), "text"), 4)
    pairs = minhash.estimated(minhash.candidate_pairs(rows), rows.select("id", "planes")).collect()
    assert pairs
    sets = {i: set(shingles(t.encode(), 4).tolist()) for i, t in texts.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    least = minhash.least_estimate(80)
    assert all(r["estimate"] >= least for r in pairs if alike(r["x"], r["hub"]) >= 0.8)
    assert any(r["estimate"] < least for r in pairs) and all(abs(r["estimate"] - alike(r["x"], r["hub"])) < 0.3 for r in pairs)


def test_components_of_chain_and_star(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components.smallest_reachable(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 150)}


def test_estimate_is_near_the_truth():
    import numpy as np

    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    _, planes = minhash.sketch([a, b])
    assert abs(minhash.likeness(planes[0], planes[1:])[0] - 1500 / 2500) < 0.15
