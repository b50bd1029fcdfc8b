import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import TEXTS, empty, frame, labels
from tidemark.llm import bpe, bwt, langid, packing, quality, secrets, substrings, syncmers, toxicity

BASE = (
    ("assign", re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")),
    ("access", re.compile("AKIA[A-Z0-9]+")),
    ("hex", re.compile("[0-9a-f]+")),
)


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in pattern.finditer(text or ""):
            size = len(m.group(2)) if kind == "assign" else len(m.group())
            if size >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return [(k, a, z) for a, _, z, k in sorted(out)]


SECRETS = [
    (50, "token=secret=abcdefgh and token:token:abcdefgh1"), (51, "API_KEY : \"zzzzzzzz\" ſecret=12345678"), (52, "x" * 10 + "é😀 passwd=aaaaaaaa" + "f" * 40),
    (53, "see Zq3xK9vT1bLw8RmYp0dHc6NfJs2 now"), (54, "donaudampfschifffahrtsgesellschaft is a word"), (55, "4111111111111111222233334444 is a number"),
]


def test_secret_base_spans_and_battery(spark):
    rows = TEXTS + SECRETS
    got = {r["doc_id"]: [(s["kind"], s["start"], s["stop"]) for s in r["spans"]] for r in secrets.scan(frame(spark, rows)).collect()}
    for i, t in rows:
        assert [s for s in got[i] if s[0] != "random"] == base_spans(t), i
    assert [s for s in got[53] if s[0] == "random"] == [("random", 4, 31)]
    assert not [s for i in (54, 55) for s in got[i]]
    assert secrets.scan(empty(spark)).count() == 0


def test_redaction_keeps_rows_and_columns(spark):
    df = frame(spark, TEXTS + SECRETS)
    out = secrets.redact(df)
    assert out.columns == df.columns and out.count() == df.count()
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert text[11] == "[SECRET]' and [SECRET]" and text[5] == dict(TEXTS)[5] and text[1] is None


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_bpe_equals_the_library(spark, vocabulary):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary)
    lib.no_truncation(), lib.no_padding()
    odd = ["a<|endoftext|>b <|startoftext|>", "ΑΣΣ ΣΊΣΥΦΟΣ Σ", "é ́x İ ǅ", "a\x1cb\x1d c\x85d\xa0e", "<|EndOfText|> it's IT'S don't 're 123 ١٢", "aaaaaaaaaa abababababab !!!!????", "ﬂﬁ ẛ̣ 'S 'ſ K"]
    rows = TEXTS + [(100 + i, t) for i, t in enumerate(odd)]
    got = {r["doc_id"]: r for r in bpe.encode(frame(spark, rows), vocabulary).collect()}
    for i, t in rows:
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == want and got[i]["n_tokens"] == len(want)
        assert got[i]["decoded"] == lib.decode(want, skip_special_tokens=False) == bpe.decode_ids(np.array(want, int), vocabulary)
    assert bpe.digests(empty(spark), vocabulary).count() == 0


def test_packing_is_gapless_and_whole(spark, vocabulary):
    import zlib

    df = frame(spark)
    ids = {r["doc_id"]: np.array([*r["ids"], 2], "<u4") for r in bpe.encode(df, vocabulary).collect()}
    rows = packing.pack(packing.pieces(df, vocabulary, capacity=256), capacity=256, group_pieces=64).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(own.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    for doc, own in by_doc.items():
        ends = sorted((r["start"], r["start"] + r["length"]) for r in own)
        assert ends[0][0] == 0 and ends[-1][1] == len(ids[doc]) and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    for own in by_sequence.values():
        ends = sorted((r["offset"], r["offset"] + r["length"]) for r in own)
        assert ends[0][0] == 0 and ends[-1][1] <= 256 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert set(by_doc) == set(ids)
    assert packing.pack(packing.pieces(empty(spark), vocabulary)).count() == 0


def test_differencing_is_near_equal():
    rng = np.random.default_rng(3)
    lengths = [int(x) for x in np.minimum(4095, rng.exponential(700, 600).astype(int) + 1)]
    window = packing.fill(lengths, 4096)
    loads = np.bincount(window, weights=lengths)
    assert loads.max() <= 4096 and loads.sum() == sum(lengths) and loads.sum() / (4096 * len(loads)) > 0.97
    assert packing.fill([4096, 4095, 2], 4096) != [0, 0, 0]


def brute_removal(rows):
    first, out = {}, {}
    for i, t in sorted((i, t) for i, t in rows if i is not None):
        b = (t or "").encode()
        off = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], i) < i:
                off[k : k + 50] = True
        kept = np.frombuffer(b, np.uint8)[~off].tobytes()
        spans = int((np.diff(np.concatenate(([0], off.astype(int)))) == 1).sum())
        out[i] = (len(b), int(off.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowded", [50_000, 1])
def test_substring_removal_against_brute_force(spark, crowded):
    shared = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(180))
    own = lambda k: "".join(chr(97 + (i * k + k) % 23) for i in range(90))
    rows = TEXTS + [(60, own(3) + shared + own(5)), (61, own(7) + shared), (62, shared[:49]), (63, shared[20:70]), (64, own(3) + "\x00" * 80), (65, "\x00" * 120), (66, shared + shared)]
    rows += [(70 + i, own(3 + i)[:40] + shared[i : i + 60] + own(9 + i)[:30]) for i in range(6)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.removal(frame(spark, rows), crowded=crowded).collect()}
    assert got == brute_removal(rows)
    assert substrings.removal(empty(spark)).count() == 0


def test_substring_removal_of_repeated_ids_rows_and_null_ids(spark):
    s = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(90))
    rows = [(1, s), (2, "q" * 300 + s), (2, "short"), (2, s), (3, s + "z"), (3, s + "z"), (None, s), (4, s), (4, s + "y")]
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in substrings.removal(frame(spark, rows)).collect())
    assert got == sorted([("1", 90, 0, 0), ("2", 390, 90, 1), ("2", 5, 0, 0), ("2", 90, 90, 1), ("3", 91, 90, 1), ("3", 91, 90, 1), ("None", 90, 0, 0), ("4", 90, 90, 1), ("4", 91, 90, 1)])


def test_merged_transform_orders_all_suffixes():
    rng = np.random.default_rng(5)
    shards = [rng.integers(0, 3, n).astype(np.uint8) for n in (200, 90, 37)]
    source, place, common = bwt.merged_order(shards, 12)
    keys = [bytes(np.resize(np.roll(shards[s], -p), 12)) for s, p in zip(source, place)]
    assert keys == sorted(keys) and len(set(zip(source.tolist(), place.tolist()))) == 327
    assert common.tolist() == [0] + [next((i for i in range(12) if a[i] != b[i]), 12) for a, b in zip(keys, keys[1:])]


def test_syncmer_fingerprints(spark):
    rows = [(i, t) for i, t in TEXTS]
    got = {r["doc_id"]: r for r in syncmers.edited_likeness(frame(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        t, n = t or "", len(t or "")
        edited = t[: n - n // 3] + (order[(k + 1) % len(order)][1] or "")[: n // 3]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == n
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[5]["fingerprint"] == got[6]["fingerprint"] and got[6]["near_next"] == 1.0
    assert syncmers.edited_likeness(empty(spark)).count() == 0


def test_syncmers_are_context_free():
    rng = np.random.default_rng(2)
    passage = "".join(map(chr, rng.integers(97, 123, 400)))
    a, b = ("".join(map(chr, rng.integers(97, 123, 300))) for _ in range(2))
    h, at = syncmers.anchors(passage)
    g, to = syncmers.anchors(a + passage + b)
    assert set(zip(h.tolist(), (at + 300).tolist())) <= set(zip(g.tolist(), to.tolist()))


def test_language_spans_and_null(spark):
    en, de = "the weather and the other thing with that", "der wetter und die andere sache mit dem nicht"
    train = [(i, f"{en} number{i}" if i % 2 else f"{de} nummer{i}") for i in range(200)]
    rows = spark.createDataFrame([("en" if i % 2 else "de", t) for i, t in train] + [(None, "x"), ("en", None)], "lang string, text string")
    model = langid.train(rows)
    mixed = " ".join([en] * 4 + [de] * 4)
    got = {r["doc_id"]: r for r in langid.predict(frame(spark, TEXTS + [(90, en), (91, de)]), model).collect()}
    assert got[90]["lang_pred"] == "en" and got[91]["lang_pred"] == "de"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 14))
    spans = langid.spans(frame(spark, [(1, mixed)]), model).orderBy("first_word").collect()
    assert [(r["lang"], r["first_word"], r["n_words"]) for r in spans] == [("en", 0, 32), ("de", 32, 36)]
    assert langid.predict(empty(spark), model).count() == 0


def test_viterbi_shortcut_equals_recursion():
    model = langid.Model(["a", "b", "c"], np.zeros(0, np.int64), np.zeros((0, 3)), np.ones((len(langid._NAMES), 3)))
    rng = np.random.default_rng(4)
    for _ in range(50):
        s = -rng.random((30, 3)).astype(np.float32) * 3
        best, value = None, [(x, [i]) for i, x in enumerate(s[0])]
        for row in s[1:]:
            value = [max(((v - (0 if p[-1] == i else 6.0)) + row[i], [*p, i]) for v, p in value) for i in range(3)]
        best = max(value)[0]
        path = model.path(s, 6.0)
        assert abs(s[np.arange(30), path].sum() - 6.0 * (np.diff(path) != 0).sum() - best) < 1e-3


def classified(spark, module, label, good, bad):
    docs = [(i, f"{'nice' if i % 4 else 'plain'} text {' '.join(f'w{(i * 7 + j) % 50}' for j in range(12))} {bad if i % 3 == 0 else good}") for i in range(400)]
    marks = labels(spark, [(i, int(i % 3 != 0), int(i % 3 == 0)) for i, _ in docs] + [(9999, None, None)])
    df = frame(spark, docs + [(2000, None), (2001, "")])
    judge = module.scorer(df, module.train(df, marks))
    return {r["doc_id"]: r["s"] for r in df.select("doc_id", judge(F.col("text")).alias("s")).collect()}


def test_toxicity_learns_and_ignores_group_names(spark):
    s = classified(spark, toxicity, "toxic", "friend", "idiot")
    assert all((s[i] >= 0.5) == (i % 3 == 0) for i in range(400)) and s[2000] == s[2001] and 0 <= s[2000] <= 1
    texts = [f"the {'muslim' if i % 2 else 'christian'} man said {'idiot' if i % 2 else 'hello'} {i}" for i in range(300)]
    y = np.array([i % 2 for i in range(300)], float)
    free, held = toxicity.fit(y, texts, penalty=0.0), toxicity.fit(y, texts, penalty=50.0)
    gap = lambda w: abs(sum(w[list(toxicity.word_features("muslim"))]) - sum(w[list(toxicity.word_features("christian"))]))
    assert gap(held) < 0.5 * gap(free)


def test_toxic_rows_go_others_stay(spark):
    docs = [(i, f"some text number {i} {'idiot moron' if i % 3 == 0 else 'fine day'}") for i in range(300)]
    df = frame(spark, docs + [(None, "fine day"), (900, None)])
    kept = toxicity.drop_toxic(df, labels(spark, [(i, 1, int(i % 3 == 0)) for i, _ in docs]))
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs if i % 3} | {None, 900}


def test_quality_learns(spark):
    s = classified(spark, quality, "quality", "ends well.", "###$$$ !!! ###$$$ !!!")
    assert all((s[i] >= 0.3) == (i % 3 != 0) for i in range(400)) and s[2000] == s[2001]


def test_classifiers_without_labels(spark):
    none = labels(spark, [(1, None, None)]).limit(0)
    for module in (toxicity, quality):
        judge = module.scorer(frame(spark), module.train(frame(spark), none))
        assert frame(spark).select(judge(F.col("text")).alias("s")).filter("s < 0 OR s > 1 OR s IS NULL").count() == 0
