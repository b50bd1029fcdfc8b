"""Centroids, collocations and the Jaccard join against brute force, and their edge cases."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import LONG, TEXTS, empty, frame
from tests.llm.test_exact_and_near import brute_components
from tidemark.llm import centroids, collocations, fm_index, jaccard

VECTORS = "vec_id long, embedding array<float>, label int, id string, v string, cluster string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 0, "i", "v", "c") for i, e in rows], VECTORS).repartition(3)


def brute_clusters(rows, size, k, rounds):
    kept = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if e is not None and len(e) == size and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centers = [v for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, c), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centers = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centers)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, c, d in out:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in out), key=str)


def random_vectors(n, size):
    made = np.random.default_rng(5)
    base = made.normal(0, 1, (6, size))
    rows = [(i, [float(np.float32(x)) for x in base[i % 6] + made.normal(0, 0.2, size)]) for i in range(n)]
    same = rows[0][1]
    return rows + [(n + i, same) for i in range(40)] + [(1, rows[1][1]), (1, rows[1][1]), (None, same)]


def test_clusters_equal_brute_force(spark):
    odd = [(900, None), (901, [1.0] * 7), (902, [None] + [1.0] * 7), (903, [float("nan")] + [1.0] * 7), (904, [float("inf")] + [1.0] * 7), (905, [-0.001] * 8), (906, [])]
    rows = random_vectors(150, 8) + odd
    got = sorted(map(tuple, centroids.cluster(vectors(spark, rows), size=8, k=9, rounds=3, pivots=3).collect()), key=str)
    assert got == brute_clusters(rows, 8, 9, 3)


def test_clusters_of_large_components_few_rows_and_none(spark):
    rows = [(i, [float(np.float32(x)) for x in ((i % 3) * 1e6, -3e4 * i, 0.5, i)]) for i in range(30)]
    assert sorted(map(tuple, centroids.cluster(vectors(spark, rows), size=4, k=5, rounds=2).collect()), key=str) == brute_clusters(rows, 4, 5, 2)
    huge = centroids.cluster(vectors(spark, [(1, [3e38] * 4), (2, [-3e38] * 4)]), size=4, k=1, rounds=1).collect()
    assert {r["distance"] for r in huge} == {2**63 - 1}
    few = rows[:3]
    assert sorted(map(tuple, centroids.cluster(vectors(spark, few), size=4, k=40, rounds=5).collect()), key=str) == brute_clusters(few, 4, 40, 5)
    nothing = centroids.cluster(vectors(spark, [(1, None)]), size=4)
    assert nothing.count() == 0 and nothing.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_pivots_leave_out_centroids_and_change_nothing():
    made = np.random.default_rng(1)
    base = made.integers(-3000, 3000, (40, 64))
    v = base[made.integers(0, 40, 500)] + made.integers(-60, 60, (500, 64))
    pivots = centroids.pick_pivots(base, 12)
    best, least, measured = centroids.nearest(v, centroids._roots(v, pivots), base, pivots)
    exact = ((v[:, None, :] - base[None]) ** 2).sum(axis=2)
    assert (best == exact.argmin(axis=1)).all() and (least == exact.min(axis=1)).all()
    assert measured < 0.3 * v.shape[0] * len(base)


def grams(rows, longest):
    n, found = Counter(), {}
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    found.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    return n, found


def brute_collocations(rows, longest, least, top):
    n, found = grams(rows, longest)
    out = []
    for lang, f in found.items():
        often = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = Counter()
        for p, c in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], c)
        scored = []
        for p, a in often.items():
            if 100 * inside[p] < 100 * a:
                score, _, left, right = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def phrases(spark, rows):
    return spark.createDataFrame([(i, t, g, "k", "f", 1) for i, t, g in rows], "doc_id long, text string, lang string, key string, f string, n int").repartition(3)


@pytest.fixture(scope="module")
def spoken():
    made = np.random.default_rng(9)
    words = np.array(["a", "b", "C", "dé", "x\x00y", "\x1cq", "日本", "of", "The", "f g"])
    rows = [(i, " ".join(made.choice(words, 60).tolist()).replace("b a", "b, a") + "; New York City hall\tof\nThe end", ("en", "fr", None)[i % 3]) for i in range(40)]
    return rows + [(99, None, "en"), (98, "", None), (97, " \t .,;", "fr"), (96, "a a a a a a a a", "en"), (96, "a a a a a a a a", "en"), (None, "new york", "en")]


@pytest.mark.parametrize("shard", [50, 1_000_000])
def test_collocations_equal_brute_force(spark, spoken, shard):
    for least, top in ((5, 1000), (13, 7)):
        got = sorted(map(tuple, collocations.collocations(phrases(spark, spoken), least=least, top=top, shard=shard, counters=1 << 16).collect()))
        assert got == brute_collocations(spoken, 5, least, top) and got


def test_collocations_without_help_of_counters(spark, spoken):
    """With one counter part full of collisions the result is the same."""
    rows = [(i, " ".join(f"w{i * 1000 + j}" for j in range(2000)), "en") for i in range(40)]
    both = spoken + rows
    got = sorted(map(tuple, collocations.collocations(phrases(spark, both), least=2, counters=1 << 16).collect()))
    assert got == brute_collocations(both, 5, 2, 2000)


def test_collocations_of_nothing_and_of_long_texts(spark):
    assert collocations.collocations(phrases(spark, [(1, "a b", "en")]).limit(0)).count() == 0
    rows = [(1, LONG, "en"), (2, LONG, "en")]
    assert sorted(map(tuple, collocations.collocations(phrases(spark, rows)).collect())) == brute_collocations(rows, 5, 100, 2000)


def test_index_counts_and_neighbours():
    made = np.random.default_rng(3)
    seq = made.integers(0, 5, 400).astype(np.int32)
    seq[-1] = 0
    text = seq.tolist()
    index = fm_index.Index(seq, 4)
    p = index.words()
    for k in range(2, 5):
        p = index.longer(p)
        want = Counter(tuple(text[i : i + k]) for i in range(len(text) - k + 1) if 0 not in text[i : i + k])
        got = {}
        before, after = index.only_before(p), index.only_after(p)
        for row, at in enumerate(index.places(p).tolist()):
            phrase = tuple(text[at : at + k])
            got[phrase] = int(p.hi[row] - p.lo[row])
            spots = [i for i in range(len(text) - k + 1) if tuple(text[i : i + k]) == phrase]
            if k < 4:
                for side, found in ((-1, before), (k, after)):
                    near = {text[(i + side) % len(text)] for i in spots}
                    assert found[row] == (near.pop() if len(near) == 1 else 0)
        assert got == dict(want)


def edited(rng, words, share):
    return [f"e{rng.integers(10**9)}" if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def copies():
    made = np.random.default_rng(11)
    base = [f"w{made.integers(3000)}" for _ in range(120)]
    group = [(500 + i, " ".join(edited(made, base, 0.03 if i % 2 else 0.012))) for i in range(60)]
    chain, at = [], [f"c{i}" for i in range(100)]
    for i in range(12):
        chain.append((200 + i, " ".join(at)))
        at = at[4:] + [f"d{i}_{j}" for j in range(4)]
    passage = " ".join(f"p{i}" for i in range(40))
    shared = [(300 + i, f"{passage} " + " ".join(f"s{i}_{j}" for j in range(30))) for i in range(40)]
    return [*TEXTS, *group, *chain, *shared, (400, "one two three"), (401, "ONE  two\tthree"), (402, "one two"), (None, "one two three"), (400, "one two three"), (403, " ".join(base))]


def test_join_equals_brute_force(spark, copies):
    known = [(i, t) for i, t in copies if i is not None]
    for words, percent in ((5, 80), (4, 60)):
        want = brute_components(dict(known).items(), words, percent)
        got = jaccard.similar(frame(spark, copies), words=words, percent=percent, counters=1 << 16).collect()
        assert len(got) == len(copies)
        for r in got:
            assert r["doc_id"] is None or (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
        assert [(r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is None] == [(1, None)]
    assert jaccard.similar(empty(spark)).count() == 0


def test_join_in_small_blocks(spark, copies, monkeypatch):
    want = {r["doc_id"]: r["component_id"] for r in jaccard.similar(frame(spark, copies)).collect()}
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "TOGETHER", 40)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.similar(frame(spark, copies)).collect()} == want


def test_filters_never_reject_a_link():
    made = np.random.default_rng(2)
    for _ in range(300):
        n = int(made.integers(1, 60))
        a = np.unique(made.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[made.random(len(a)) < made.choice([0.7, 0.9, 1.0])], made.integers(0, 1 << 63, int(made.integers(0, 8)), dtype=np.uint64))))
        if len(b):
            shared = len(np.intersect1d(a, b))
            linked = 100 * shared >= 80 * (len(a) + len(b) - shared)
            sizes = np.array([len(a)]), np.array([len(b)])
            assert jaccard.overlaps([jaccard._ranges(a)], [jaccard._ranges(b)], *sizes, 80)[0] or not linked
    assert jaccard.overlaps([None], [b"x"], np.array([5]), np.array([5]), 80)[0]


def test_queries_return_their_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = jaccard.op13_jaccard_join(spark, sf)
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and got.count() == docs.count()
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 5, 80)
    assert all(want[r["doc_id"]] == (r["n_shingles"], r["component_id"]) for r in got.collect())
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, centroids.op11_centroids(spark, sf).collect()), key=str) == brute_clusters(rows, 64, 40, 5)
    spoken = [(0, r["text"], r["lang"]) for r in docs.collect()]
    assert sorted(map(tuple, collocations.op12_collocations(spark, sf).collect())) == brute_collocations(spoken, 5, 100, 2000)


def test_phrases_of_a_task_are_gathered_in_a_fixed_number(spark, monkeypatch):
    """A shard of many phrases, none of which a counter leaves out, leaves its task in blocks of a bounded size."""
    from tidemark.llm import collocations as C

    words = [f"w{i * i % 997}" for i in range(6000)]
    seq = np.array([int(w[1:]) + 1 for w in words] + [0], np.int32)
    listed = [b"", *[f"w{i}".encode() for i in range(997)]]
    of_word = np.arange(998, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    monkeypatch.setattr(C, "PIECE", 100)
    tables = list(C._phrases(C.Index(seq, 5), "en", listed, of_word, 5, lambda s, places, k: np.ones(len(places), bool)))
    assert max(map(len, tables)) <= 100 and sum(map(len, tables)) > 1000
    assert C._enough(0, 100) == C.COUNTERS and C._enough(1 << 32, 100) == C.MOST_COUNTERS
    full = {k: np.full(C.COUNTERS // 8, 255, np.uint8) for k in range(1, 6)}
    assert C._buckets(100_000_000, full, 100) >= 500
