"""Secret scanning with a randomness test battery, in DataFrame functions only.

Known forms (assignments, access keys, long hex runs) are found by pattern. Every other token of
LEAST characters or more, and what known forms leave of one, is put to a battery of tests and
reported when it looks drawn at random from its alphabet. A token that no encoding fits ('/' or '+'
together with '-' or '_') is cut at one pair of separators, the other and both; of overlapping
pieces the one with the most evidence stands, less CHOICE bits for the choice and JOINT for a separator.

1. Its encoding is inferred from the characters it holds (hex, base32, base36, base62, base64 and
   so on), which fixes the alphabet and its size A.
2. Three tests take "uniformly random over that alphabet" as their null hypothesis: chi-squared of
   the character counts (two-sided: repeats or too few of them; a gamma law of the statistic's exact
   mean, variance and third moment; no such law holds near its least value, so the lower side is the
   chance of no repeat at least and never counts for less than EVEN), the runs test on a two-way split of the characters (halves of the alphabet, so that each change is a fair
   coin), and the lag-1 serial correlation of their positions in the alphabet. Both serial tests see the
   same order, so the smaller of their p-values counts twice; order and counts are independent under
   the null, so Fisher's method joins the serial p-value with that of the counts. Both discrete
   statistics are taken half a step nearer to their mean. A random token thus has a joint p-value of
   a or less with probability a at most; simulations bear this out down to 2^-13 and find no clear
   excess at 2^-MAX_FIT.
3. Benjamini-Hochberg over the joint p-values of all tokens with any evidence (4.), apart for each class
   of token length, tells which tokens are not random: at most a share FDR of those set aside is
   expected to be random. How far a p-value may fall thus follows from what the table holds.
4. The evidence for a token that stays is the likelihood ratio of "random" against "ordinary word"
   (letters by their usual frequency, character classes that seldom change). By Markov's inequality
   an ordinary token reaches a ratio of 2^b with probability 2^-b at most, which is its p-value; again
   Benjamini-Hochberg per class of length holds the share of false discoveries at FDR. The counts per
   (length class, bits, joint p-value) are the only thing that leaves the executors: at most
   6 x (MAX_BITS + 1) x (MAX_FIT + 1) rows.

Null and empty texts have no spans; an empty table gives an empty result. Repeated rows are scanned each
on their own, and equal tokens are reported alike. Of spans with one start the shorter comes first within
a kind. Other columns are not read and can have any name. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize

# The patterns of the known forms.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Fewest characters of a token for the battery.
LEAST = 12
TOKEN = rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"
# The pieces of a token that no encoding fits.
PIECES = tuple(rf"[A-Za-z0-9{marks}]{{{LEAST},}}={{0,2}}" for marks in ("_-", "+/", ""))
KINDS = ("assign", "access", "hex", "random")

# Fixed values: (encoding, pattern, alphabet in order). The first pattern that fits is inferred.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("decimal", "^[0-9]+$", DIGITS),
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("lower", "^[a-z]+$", LOWER),
    ("upper", "^[A-Z]+$", UPPER),
    ("base32", "^[A-Z2-7]+=*$", UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER),
    ("BASE36", "^[0-9A-Z]+$", DIGITS + UPPER),
    ("base62", "^[0-9A-Za-z]+$", UPPER + LOWER + DIGITS),
    ("base64", "^[0-9A-Za-z+/]+=*$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^[0-9A-Za-z_-]+=*$", UPPER + LOWER + DIGITS + "-_"),
)
# Letters of ordinary text in per mille, a to z.
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)

#: Chance that two neighbouring characters of an ordinary token are of one class.
SAME_CLASS = 0.9
FDR = 0.01
#: Bits that a choice among the three cuts of a token costs (log2 of 3, rounded up).
CHOICE = 2
#: Bits by which a separator between words, with its two changes of class, is taken for random.
JOINT = 7
MAX_BITS = 400
#: Least p-value of character counts that are too even.
EVEN = 0.01
#: Joint p-values are told apart down to 2^-MAX_FIT; lower ones count as that much.
MAX_FIT = 16


def _spans(text: Column, pattern: str, kind: str, good=None) -> Column:
    """array<struct(start, stop, kind)> of the leftmost non-overlapping matches.

    The pieces between matches and the matches themselves give every offset by addition.
    """
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,kind:string,token:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.struct(begin.alias("start"), end.alias("stop"), F.lit(kind).alias("kind"), x["hit"].alias("token"))
        ok = x["hit"].isNotNull() if good is None else x["hit"].isNotNull() & good(x["hit"])
        return F.struct(end.alias("at"), F.when(ok, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast("array<struct<start:int,stop:int,kind:string,token:string>>")
    return F.when(text.rlike(pattern), F.aggregate(found, start, step, lambda acc: acc["out"])).otherwise(none)


def _by_encoding(token: Column, value) -> Column:
    """value(name, alphabet) of the first encoding whose pattern fits; NULL where none does."""
    out = None
    for name, pattern, alphabet in ENCODINGS:
        fits = token.rlike(pattern)
        out = F.when(fits, value(name, alphabet)) if out is None else out.when(fits, value(name, alphabet))
    return out


# Coefficients of the Chebyshev fit of erfc (relative error below 1.2e-7 everywhere).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, right to seven digits far into the tail."""
    x = F.abs(z) / math.sqrt(2)
    t = F.lit(1.0) / (x / 2 + 1)
    half = t * F.exp(reduce(lambda acc, c: acc * t + F.lit(c), ERFC[-2::-1], F.lit(ERFC[-1])) - x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def _stage(tokens: Column, fields: list[str], new: dict) -> tuple[Column, list[str]]:
    keep = list(fields)
    made = F.transform(tokens, lambda t: F.struct(*[t[f].alias(f) for f in keep], *[make(t).alias(k) for k, make in new.items()]))
    return made, keep + list(new)


#: log2 of a character's usual frequency by its code, from 0 to 127; a digit or mark counts one in ten.
_USUAL = [math.log2(LETTERS[ord(chr(i).lower()) - 97] / 1000 if chr(i).isalpha() else 0.1) for i in range(128)]


def evidence(tokens: Column) -> Column:
    """The tokens, array<struct(start, stop, token, cut)>, with encoding, alphabet and bits: log2 of the
    likelihood ratio of "random" against "ordinary word", floored, 0 to MAX_BITS; 0 where no encoding fits."""
    classes = lambda t: F.translate(t, LOWER + UPPER + DIGITS + "+/_", "a" * 26 + "A" * 26 + "0" * 10 + "---")
    changes = lambda t: F.length(F.regexp_replace(classes(t), r"(.)\1+", "$1")) - 1
    usual = F.array(*[F.lit(x) for x in _USUAL])
    fields = ["start", "stop", "token", "cut"]
    tokens, fields = _stage(tokens, fields, {
        "encoding": lambda t: F.coalesce(_by_encoding(t["token"], lambda n, a: F.lit(n)), F.lit("none")),
        "alphabet": lambda t: F.coalesce(_by_encoding(t["token"], lambda n, a: F.lit(a)), F.lit("")),
        "bare": lambda t: F.regexp_replace(t["token"], "=+$", ""),
    })
    tokens, fields = _stage(tokens, fields, {
        "n": lambda t: F.length(t["bare"]).cast("double"),
        "changes": lambda t: changes(t["bare"]),
        "ordinary": lambda t: F.aggregate(F.split(t["bare"], ""), F.lit(0.0), lambda a, c: a + F.coalesce(F.get(usual, F.ascii(c)), F.lit(0.0)) * F.length(c)),
        "size": lambda t: F.greatest(F.length(t["alphabet"]), F.lit(2)).cast("double"),
    })
    stay, change = math.log2(SAME_CLASS), math.log2((1 - SAME_CLASS) / 3)
    ratio = lambda t: -t["n"] * F.log2(t["size"]) - t["ordinary"] - t["changes"] * F.lit(change) - (t["n"] - 1 - t["changes"]) * F.lit(stay)
    bits = lambda t: F.when(t["encoding"] != "none", F.greatest(F.lit(0), F.least(F.lit(MAX_BITS), F.floor(ratio(t)).cast("int")))).otherwise(0)
    tokens, fields = _stage(tokens, fields, {"bits": bits})
    return F.transform(tokens, lambda t: F.struct(*[t[f].alias(f) for f in ("start", "stop", "token", "cut", "encoding", "alphabet", "bits")]))


def battery(tokens: Column) -> Column:
    """array<struct(start, stop, token, cut, encoding, fit, bits)> of tokens with their evidence.

    fit: joint p-value of the three tests, under "uniformly random over the encoding's alphabet".
    """
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x).cast("double"))
    fields = ["start", "stop", "token", "cut", "encoding", "alphabet", "bits"]
    tokens, fields = _stage(tokens, fields, {"cs": lambda t: F.filter(F.split(F.regexp_replace(t["token"], "=+$", ""), ""), lambda c: c != "")})
    tokens, fields = _stage(tokens, fields, {
        "n": lambda t: F.size(t["cs"]).cast("double"),
        "size": lambda t: F.greatest(F.length(t["alphabet"]), F.lit(2)).cast("double"),
        "at": lambda t: F.transform(t["cs"], lambda c: F.instr(t["alphabet"], c).cast("double")),
    })
    pair = lambda xs: F.arrays_zip(F.slice(xs, 1, F.size(xs) - 1).alias("a"), F.slice(xs, 2, F.size(xs) - 1).alias("b"))
    tokens, fields = _stage(tokens, fields, {
        "squares": lambda t: total(F.array_distinct(t["cs"]), lambda c: F.pow(F.size(F.filter(t["cs"], lambda d: d == c)), 2)),
        "mean": lambda t: total(t["at"], lambda x: x) / t["n"],
        "high": lambda t: F.transform(t["at"], lambda x: F.when(x > t["size"] / 2, 1).otherwise(0)),
    })
    tokens, fields = _stage(tokens, fields, {
        "chi": lambda t: t["size"] / t["n"] * t["squares"] - t["n"],
        "ones": lambda t: total(t["high"], lambda x: x),
        "runs": lambda t: total(pair(t["high"]), lambda p: F.when(p["a"] != p["b"], 1).otherwise(0)) + 1,
        "spread": lambda t: total(t["at"], lambda x: (x - t["mean"]) * (x - t["mean"])),
        "lag": lambda t: total(pair(t["at"]), lambda p: (p["a"] - t["mean"]) * (p["b"] - t["mean"])),
    })
    two_sided = lambda z: F.least(F.lit(1.0), F.lit(2.0) * _upper_tail(F.abs(z)))
    half_step = lambda x: F.greatest(F.lit(0.0), F.abs(x) - 0.5)
    free = lambda t: t["size"] - 1
    # from the mean, half a step of 2 * size / n nearer
    off = lambda t: F.signum(t["chi"] - free(t)) * half_step((t["chi"] - free(t)) * t["n"] / t["size"] / 2) * 2 * t["size"] / t["n"]
    tokens, fields = _stage(tokens, fields, {
        "deviation": lambda t: F.sqrt(free(t) * 2 * (t["n"] - 1) / t["n"]),
        # shape of the gamma law: 4 / skewness^2
        "shape": lambda t: F.pow(t["n"], 4) * F.pow(free(t) * 2 * (t["n"] - 1) / t["n"], 3) / F.pow(free(t) * 2 * (t["n"] - 1) * (t["size"] + t["n"] * 2 - 6), 2),
        "z_runs": lambda t: half_step(t["runs"] - 1 - (t["n"] - 1) / 2) * 2 / F.sqrt(t["n"] - 1),
        "z_lag": lambda t: F.when(t["spread"] > 0, (t["lag"] / t["spread"] + F.lit(1.0) / t["n"]) * t["n"] * F.sqrt(t["n"] - 1) / (t["n"] - 2)).otherwise(0.0),
    })
    tokens, fields = _stage(tokens, fields, {
        "root": lambda t: F.cbrt(F.greatest(F.lit(0.0), F.lit(1.0) + off(t) / t["deviation"] / F.sqrt(t["shape"]))),
        "distinct": lambda t: F.aggregate(F.sequence(F.lit(0), F.least(t["n"], t["size"] + 1).cast("int") - 1), F.lit(1.0), lambda acc, i: acc * (F.lit(1.0) - i / t["size"])),
        "z_serial": lambda t: F.greatest(F.abs(t["z_runs"]), F.abs(t["z_lag"])),
    })
    tokens, fields = _stage(tokens, fields, {
        "z_chi": lambda t: (t["root"] - 1 + F.lit(1.0) / (t["shape"] * 9)) * 3 * F.sqrt(t["shape"]),
        "p_serial": lambda t: F.least(F.lit(1.0), two_sided(t["z_serial"]) * 2),
    })
    floor = lambda p: F.greatest(p, F.lit(1e-12))
    tokens, fields = _stage(tokens, fields, {
        "p_chi": lambda t: F.least(F.lit(1.0), _upper_tail(t["z_chi"]) * 2, F.greatest(F.lit(EVEN), t["distinct"] * 2, _upper_tail(-t["z_chi"]) * 2)),
    })
    tokens, fields = _stage(tokens, fields, {"both": lambda t: floor(t["p_chi"]) * floor(t["p_serial"])})
    tokens, fields = _stage(tokens, fields, {"fit": lambda t: t["both"] * (1 - F.log(t["both"]))})
    out = ("start", "stop", "token", "cut", "encoding", "fit", "bits")
    return F.transform(tokens, lambda t: F.struct(*[t[f].alias(f) for f in out]))


_TOKENS = "array<struct<start:int,stop:int,token:string>>"
_TESTED = "array<struct<start:int,stop:int,token:string,cut:boolean,encoding:string,fit:double,bits:int>>"


def _part(t: Column, start: Column, stop: Column) -> Column:
    """The part of a token between two offsets of the text."""
    return F.struct(start.alias("start"), stop.alias("stop"), F.substring(t["token"], start - t["start"] + 1, stop - start).alias("token"))


def _outside(t: Column, base: Column) -> Column:
    """What the base spans leave of a token, in parts of LEAST characters or more."""
    hit = F.array_sort(F.filter(base, lambda s: (s["start"] < t["stop"]) & (t["start"] < s["stop"])))
    add = lambda out, start, stop: F.when(stop - start >= LEAST, F.concat(out, F.array(_part(t, start, stop)))).otherwise(out)
    begin = F.struct(t["start"].alias("at"), F.array().cast(_TOKENS).alias("out"))
    step = lambda acc, s: F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), add(acc["out"], acc["at"], s["start"]).alias("out"))
    return F.aggregate(hit, begin, step, lambda acc: add(acc["out"], acc["at"], t["stop"]))


def _pieces(t: Column) -> Column:
    """The pieces of a token by every cut, by start and stop."""
    found = F.concat(*[_spans(t["token"], pattern, "random") for pattern in PIECES])
    return F.array_sort(F.array_distinct(F.transform(found, lambda p: _part(t, t["start"] + p["start"], t["start"] + p["stop"]))))


def _strongest(tested: Column) -> Column:
    """Of overlapping pieces the one with the most bits, CHOICE and JOINT taken off; by start and stop."""
    joints = lambda t: F.length(F.regexp_replace(t["token"], "[A-Za-z0-9=]", ""))
    less = F.transform(tested, lambda t: t.withField("bits", F.greatest(F.lit(0), t["bits"] - CHOICE - joints(t) * JOINT)))

    def step(acc: Column, t: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        apart = F.coalesce(last["stop"] <= t["start"], F.lit(True))
        return F.when(apart, F.concat(acc, F.array(t))).when(t["bits"] > last["bits"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(t))).otherwise(acc)

    return F.aggregate(less, F.array().cast(_TESTED), step)


def length_class(length: Column) -> Column:
    return F.when(length < 20, 0).when(length < 24, 1).when(length < 32, 2).when(length < 48, 3).when(length < 96, 4).otherwise(5)


def _fit_bits(fit: Column) -> Column:
    """-log2 of a joint p-value, floored: it lies at or below 2^-b."""
    return F.least(F.lit(MAX_FIT), F.floor(-F.log2(F.greatest(fit, F.lit(2.0**-MAX_FIT / 2)))).cast("int"))


def thresholds(scanned: DataFrame, fdr: float = FDR) -> dict[int, tuple[int, int]]:
    """Per length class: the joint p-value (as -log2) from which on a token counts as not random, and the
    fewest bits to report of the others, both by Benjamini-Hochberg over all tokens."""
    one = scanned.select(F.explode("tokens").alias("t"))
    one = one.select(length_class(F.length("t.token")).alias("k"), F.col("t.bits").alias("b"), _fit_bits(F.col("t.fit")).alias("f"))
    one = one.unionByName(scanned.select(F.explode("without").alias("k"), F.lit(0).alias("b"), F.lit(-1).alias("f")))
    counts: dict[int, dict[tuple[int, int], int]] = {}
    for k, b, f, n in one.groupBy("k", "b", "f").count().collect():  # bounded: see above
        counts.setdefault(k, {})[b, f] = n
    out = {}
    for k, cells in counts.items():
        tests = sum(cells.values())

        def lowest(number_of, top: int, tests: int = tests) -> int:
            """The smallest b with 2^-b * tests <= fdr * (tokens at or above b), and some token there."""
            above, least = 0, top + 1
            for b in range(top, 0, -1):
                above += number_of.get(b, 0)
                if above and 2.0**-b * tests <= fdr * above:
                    least = b
            return least

        by_fit: dict[int, int] = {}
        for (_, f), n in cells.items():
            if f >= 0:  # what the battery has tested
                by_fit[f] = by_fit.get(f, 0) + n
        not_random = lowest(by_fit, MAX_FIT, sum(by_fit.values()))
        by_bits: dict[int, int] = {}
        for (b, f), n in cells.items():
            if f < not_random:
                by_bits[b] = by_bits.get(b, 0) + n
        out[k] = (not_random, lowest(by_bits, MAX_BITS))
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), fdr: float = FDR, spans_as: str = "spans") -> DataFrame:
    """One row per input row: id, the carried columns, and spans: array<struct(start, stop, kind)>.

    Spans of the battery (kind "random") never overlap those of known forms.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    secret = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8
    base = F.concat(_spans(text, ASSIGN, "assign", secret), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex"))
    slim = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    thin = df.select(F.col(id_col).alias("__tm_id"), *[F.col(f"`{c}`").alias(f"__tm_c_{c}") for c in carry], slim.alias("base"), _spans(text, TOKEN, "random").alias("found"))
    plain = lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"), t["token"].alias("token"))
    clash = lambda t: F.exists("base", lambda s: (s["start"] < t["stop"]) & (t["start"] < s["stop"]))
    mixed = lambda t: t["token"].rlike("[+/]") & t["token"].rlike("[_-]")
    told = lambda cut: lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"), t["token"].alias("token"), F.lit(cut).alias("cut"))
    thin = materialize(thin.withColumn("found", F.flatten(F.transform("found", lambda t: F.when(clash(t), _outside(t, F.col("base"))).otherwise(F.array(plain(t)))))))
    whole = F.transform(F.filter("found", lambda t: ~mixed(t)), told(False))
    pieces = F.transform(F.flatten(F.transform(F.filter("found", mixed), _pieces)), told(True))
    weighed = materialize(thin.withColumn("tokens", F.when(F.size("found") > 0, evidence(F.concat(whole, pieces)))).drop("found"))
    # a token without evidence is never reported, whatever the battery says: it only counts as a test
    plainly = F.transform(F.filter("tokens", lambda t: t["bits"] == 0), lambda t: length_class(F.length(t["token"])))
    tested = weighed.withColumn("without", plainly).withColumn("tokens", battery(F.filter("tokens", lambda t: t["bits"] > 0)))
    chosen = F.concat(F.filter("tokens", lambda t: ~t["cut"]), _strongest(F.filter("tokens", lambda t: t["cut"])))
    scanned = tested.withColumn("tokens", F.when(F.exists("tokens", lambda t: t["cut"]), chosen).otherwise(F.col("tokens")))
    found = thresholds(scanned, fdr)

    def passes(t: Column) -> Column:
        kind, fit = length_class(F.length(t["token"])), _fit_bits(t["fit"])
        any_of = [(kind == k) & (fit < not_random) & (t["bits"] >= least) for k, (not_random, least) in found.items()]
        return reduce(lambda a, b: a | b, any_of, F.lit(False))

    extra = F.transform(F.filter(F.coalesce("tokens", F.array().cast(_TESTED)), passes), lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"), F.lit("random").alias("kind")))
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    ranked = F.array_sort(F.transform(F.concat("base", extra), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    spans = F.transform(ranked, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    return scanned.select(F.col("__tm_id").alias(id_col), *[F.col(f"`__tm_c_{c}`").alias(c) for c in carry], spans.alias(spans_as))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """df with every span of its texts replaced by `mask`; overlapping spans count as one."""
    found = scan(df, id_col, text_col, carry=tuple(c for c in df.columns if c != id_col), spans_as="__tm_spans")
    text = F.coalesce(F.col(text_col), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["stop"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(acc["out"]).alias("out"),
    )
    cleaned = F.aggregate("__tm_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size("__tm_spans") > 0, cleaned).otherwise(F.col(text_col))).select(*df.columns)


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every text of `documents`: base counts and digest, and all spans."""
    found = scan(documents(spark, sf_dir))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
