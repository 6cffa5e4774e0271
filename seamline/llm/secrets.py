"""Secret scans: fixed patterns, and a randomness test battery over long tokens, with DataFrame functions only.

Cases: a null text is empty and has no spans. Rows are scanned each by itself, also where their id repeats another's or
is null; each row's tokens count in the false-discovery control. Texts of any length are scanned whole. An empty table
gives an empty table. Output columns replace input columns of the same name; all others pass through.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base patterns; keywords in either case, by classes, so that no other letter folds to them.
KEYWORDS = ["password", "passwd", "secret", "token", "api_?key"]
ASSIGN = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in k) for k in KEYWORDS) + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "random"]
#: Tokens that the battery looks at, and the alphabets that it infers, first fit first: name, form, letters it must have each kind of, letters.
TOKEN = "[A-Za-z0-9+/_-]{20,}={0,2}"
DIGITS, UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = [
    ("HEX", "^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("base32", "^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", UPPER + "234567"),
    ("base36", "^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", DIGITS + UPPER.lower()),
    ("base62", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$", DIGITS + UPPER + UPPER.lower()),
    ("base64", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+=*$", UPPER + UPPER.lower() + DIGITS + "+/"),
    ("base64url", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+=*$", UPPER + UPPER.lower() + DIGITS + "-_"),
]
#: Share of false discoveries among random tokens of a length band; the least p-value of the battery for a random token.
FALSE_DISCOVERIES, LEAST_RANDOM_P = 0.01, 0.001
#: What tokens that are not random are like: kinds (small, capital, digit, other) at the start and after each kind, and
#: letters by their share in English text, in thousandths, with a tenth of each kind's mass dealt evenly.
KIND_FIRST = [0.5, 0.3, 0.15, 0.05]
KIND_AFTER = [[0.82, 0.10, 0.05, 0.03], [0.55, 0.37, 0.05, 0.03], [0.12, 0.10, 0.70, 0.08], [0.50, 0.25, 0.20, 0.05]]
LETTER_SHARE = dict(zip(UPPER, [82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1]))
EVEN_SHARE = 0.1
#: Fixed value: the form's coefficients, by rising powers of 1 / (1 + x / 2).
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
#: Lengths from which each band begins.
BANDS = [20, 24, 32, 48, 96]
SPAN = "array<struct<start:int,end:int,kind:int>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sections(items: Column) -> Column:
    """items, an array with an element at least, as an array of about sqrt(n) arrays: what a fold of folds copies is n * sqrt(n)."""
    return _let(F.ceil(F.sqrt(F.size(items))).cast("int"), lambda k: F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / k).cast("int")), lambda i: F.slice(items, i * k + 1, k)))


def _matches(text: Column, pattern: str, good: Callable[[Column], Column] | None = None, group: int = 0) -> Column:
    """array<struct(start, end, word)> (code points, end exclusive) of the pattern's leftmost matches whose group is good."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if group:
        found = F.arrays_zip(whole.alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"))
    else:
        found = F.transform(whole, lambda m: F.struct(m.alias("m"), m.alias("g")))
    pieces = F.zip_with(F.split(text, pattern, -1), found, lambda s, x: F.struct(s.alias("s"), x["m"].alias("m"), x["g"].alias("g")))
    none = F.array().cast("array<struct<start:int,end:int,word:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["s"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("word")))
        keep = x["m"].isNotNull() if good is None else x["m"].isNotNull() & good(x["g"])
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def section(acc: Column, xs: Column) -> Column:
        return F.aggregate(xs, F.struct(acc["at"].alias("at"), none.alias("out")), step, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,word:string>>>").alias("out"))
    every = _let(pieces, lambda p: F.aggregate(_sections(p), start, section, lambda acc: F.flatten(acc["out"])))
    return F.when(text.rlike(pattern), every).otherwise(none)


def _spans(text: Column, pattern: str, kind: int, good: Callable[[Column], Column] | None = None, group: int = 0) -> Column:
    return F.transform(_matches(text, pattern, good, group), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def base_spans(text: Column) -> Column:
    return F.concat(
        _spans(text, ASSIGN, 0, lambda g: F.length(g) >= 12, 2),
        _spans(text, ACCESS, 1),
        _spans(text, HEX, 2),
    )


# -- the battery --------------------------------------------------------------


def _log_two_sided(z: Column) -> Column:
    """log P(|Z| >= |z|) of a standard normal: the log of erfc by a rational Chebyshev form, relative error below 1.2e-7 at any z."""

    def of(x: Column) -> Column:
        t = 1 / (1 + x / 2)
        powers = F.lit(0.0)
        for c in reversed(ERFC):
            powers = powers * t + c
        return F.log(t) - x * x + powers

    return F.least(F.lit(0.0), _let(F.abs(z) / math.sqrt(2), of))


def _neighbours(items: Column, n: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(F.slice(items, 1, n - 1), F.slice(items, 2, n - 1), f), F.lit(0.0), lambda a, x: a + x)


def _kind(c: str) -> int:
    return 2 if c in DIGITS else 1 if c in UPPER else 0 if c.upper() in UPPER else 3


def null_odds(letters: str) -> tuple[list[float], list[float], list[float]]:
    """Log odds of uniform draws to the non-random null of an alphabet: by letter, first kind, and kind after kind (4 * before + kind)."""
    kinds = [_kind(c) for c in letters]
    present = sorted(set(kinds))
    mass = {k: sum(LETTER_SHARE.get(c.upper(), 1) for c, of in zip(letters, kinds) if of == k) for k in present}
    within = [EVEN_SHARE / kinds.count(k) + (1 - EVEN_SHARE) * LETTER_SHARE.get(c.upper(), 1) / mass[k] for c, k in zip(letters, kinds)]
    odds = lambda row: [-math.log(row[k] / sum(row[j] for j in present)) if k in present else 0.0 for k in range(4)]
    return [-math.log(len(letters) * w) for w in within], odds(KIND_FIRST), [x for row in KIND_AFTER for x in odds(row)]


def randomness(token: Column, encoding: Column) -> Column:
    """struct(log_random, log_null, n): how well the token fits uniform draws from its encoding's letters, and the non-random null.

    log_random is the log of the battery's p-value: chi-squared, runs and serial correlation, combined by Fisher's
    method. log_null is that of the p-value which the false-discovery control gets: the ratio of the token's chances
    under the null (kinds after kinds, English letters) and under uniform draws, divided by the battery's p-value. The
    null gives a ratio of x at most with a chance of x at most, and the battery's p-value is at most 1, so it is a
    p-value under the null, and the larger the less uniform the battery finds the token.
    """
    tables = [null_odds(letters) for _, _, letters in ENCODINGS]
    of_encoding = lambda rows: F.element_at(F.array(*[F.array(*map(F.lit, row)) for row in rows]), encoding)
    letters = F.element_at(F.array(*[F.lit(letters) for _, _, letters in ENCODINGS]), encoding)
    by_letter, by_first, by_after = (of_encoding([t[k] for t in tables]) for k in range(3))

    def of_indexes(index: Column) -> Column:
        n, size = F.size(index).cast("double"), F.length(letters).cast("double")
        count = F.size(index)
        total = lambda f: F.aggregate(F.transform(index, f), F.lit(0.0), lambda a, x: a + x)
        squares = F.aggregate(F.transform(F.array_distinct(index), lambda i: F.pow(F.size(F.filter(index, lambda x: x == i)).cast("double"), 2)), F.lit(0.0), lambda a, x: a + x)
        df = size - 1
        chi = squares * size / n - n
        spread = 2 / (9 * df)
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, 1 / 3) - (1 - spread)) / F.sqrt(spread)
        high = total(lambda i: F.when(i >= size / 2, 1.0).otherwise(0.0))
        low = n - high
        runs = 1 + _neighbours(index, count, lambda a, b: F.when((a >= size / 2) != (b >= size / 2), 1.0).otherwise(0.0))
        mean_runs = 1 + 2 * high * low / n
        var_runs = F.greatest(F.lit(1e-9), (mean_runs - 1) * (mean_runs - 2) / F.greatest(n - 1, F.lit(1.0)))
        z_runs = (runs - mean_runs) / F.sqrt(var_runs)
        mean = total(lambda i: i.cast("double")) / n
        var = F.greatest(F.lit(1e-9), total(lambda i: F.pow(i.cast("double"), 2)) - n * mean * mean)
        z_serial = _let(mean, lambda m: _neighbours(index, count, lambda a, b: (a - m) * (b - m))) / var * F.sqrt(n)
        half = -(_log_two_sided(z_chi) + _log_two_sided(z_runs) + _log_two_sided(z_serial))
        return _let(half, lambda h: F.log(1 + h + h * h / 2) - h)  # log upper tail of chi-squared with 6 degrees at 2 h

    core = F.rtrim(F.translate(token, "=", " "))
    kind = lambda c: F.when(c.between("a", "z"), 0).when(c.between("A", "Z"), 1).when(c.between("0", "9"), 2).otherwise(3)

    def of_chars(chars: Column) -> Column:
        index = F.transform(chars, lambda c: F.instr(letters, c) - 1)
        kinds = _let(F.transform(chars, kind), lambda k: F.element_at(by_first, F.get(k, F.lit(0)) + 1) + _let(by_after, lambda t: _neighbours(k, F.size(k), lambda a, b: F.element_at(t, 4 * a + b + 1))))
        alone = lambda i: _let(by_letter, lambda t: F.aggregate(i, F.lit(0.0), lambda a, x: a + F.element_at(t, x + 1)))
        both = _let(index, lambda i: F.struct(of_indexes(i).alias("p"), (alone(i) + kinds).alias("odds")))
        log_null = lambda x: F.least(F.lit(0.0), -x["odds"] - x["p"])
        return _let(both, lambda x: F.struct(x["p"].alias("log_random"), log_null(x).alias("log_null"), F.size(chars).alias("n")))

    return _let(F.regexp_extract_all(core, F.lit("(.)"), F.lit(1)), of_chars)


def _encoding(token: Column) -> Column:
    """The place, from 1, of the token's inferred encoding; null if it fits none."""
    found = F.lit(None).cast("int")
    for k, (_, form, _) in reversed(list(enumerate(ENCODINGS, 1))):
        found = F.when(token.rlike(form), k).otherwise(found)
    return found


def _band(n: Column) -> Column:
    band = F.lit(0)
    for k, least in enumerate(BANDS[1:], 1):
        band = F.when(n >= least, k).otherwise(band)
    return band


def _bucket(log_p: Column) -> Column:
    """Tenths of -log10(p), rounded down: its p-value bound is 10 ** (-bucket / 10)."""
    return F.least(F.lit(300), F.floor(log_p * (-10 / math.log(10))).cast("int"))


def tested_tokens(text: Column) -> Column:
    """array<struct(start, end, band, bucket)> of tokens with an encoding; bucket 0 where uniform draws do not explain one."""

    def test(s: Column) -> Column:
        return _let(_encoding(s["word"]), lambda a: F.when(a.isNotNull(), F.struct(s["start"].alias("start"), s["end"].alias("end"), randomness(s["word"], a).alias("r"))))

    scored = F.filter(F.transform(_matches(text, TOKEN), test), lambda x: x.isNotNull())
    bucket = lambda r: F.when(r["log_random"] >= math.log(LEAST_RANDOM_P), _bucket(r["log_null"])).otherwise(0)
    return F.transform(scored, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _band(x["r"]["n"]).alias("band"), bucket(x["r"]).alias("bucket")))


def discovery_bounds(docs: DataFrame, text_col: str) -> dict[int, int]:
    """Benjamini-Hochberg over all tokens of each length band: the least bucket that is a discovery."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    tokens = docs.where(text.rlike(TOKEN)).select(F.explode(tested_tokens(text)).alias("t"))
    counts: dict[int, dict[int, int]] = defaultdict(dict)
    for band, bucket, n in tokens.groupBy("t.band", "t.bucket").count().collect():  # at most bands x 301 rows
        counts[band][bucket] = n
    bounds = {}
    for band, of in counts.items():
        tests, found = sum(of.values()), 0
        for bucket in sorted(of, reverse=True):
            found += of[bucket]
            if tests * 10 ** (-bucket / 10) <= FALSE_DISCOVERIES * found:
                bounds[band] = bucket
    return bounds


def scan_secrets(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with secret_spans: array<struct<start, end, kind>> by start, then kind (its place in KINDS)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    bounds = discovery_bounds(docs, text_col)
    spans = base_spans(text)
    if bounds:
        found = F.filter(tested_tokens(text), lambda t: _reaches(t, bounds))
        found = F.transform(found, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit(3).alias("kind")))
        spans = F.concat(spans, F.when(text.rlike(TOKEN), found).otherwise(F.array().cast(SPAN)))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    passed = [F.col(f"`{c}`") for c in docs.columns if c != "secret_spans"]
    # a generated column: Catalyst would else scan the text again at each use of the spans
    return docs.select(*passed, F.explode(F.array(order)).alias("secret_spans"))


def _reaches(token: Column, bounds: dict[int, int]) -> Column:
    reached = F.lit(False)
    for band, bucket in sorted(bounds.items()):
        reached = reached | ((token["band"] == band) & (token["bucket"] >= bucket))
    return reached


def spans_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with each maximal run of overlapping spans replaced by the mark.

    What stays is cut out in sections of sqrt(n) pieces each, so that n spans cost about 2 sqrt(n) passes over the text, not n.
    """
    gap = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    gaps = "array<struct<lo:int,hi:int>>"

    def step(acc: Column, s: Column) -> Column:
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap(acc["at"], s["start"])))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    def section(acc: Column, xs: Column) -> Column:
        return F.aggregate(xs, F.struct(acc["at"].alias("at"), F.array().cast(gaps).alias("out")), step, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{gaps}>").alias("out"))
    kept = F.aggregate(_sections(spans), start, section, lambda acc: F.concat(F.flatten(acc["out"]), F.array(gap(acc["at"], F.length(text)))))

    def cut(own: Column) -> Column:
        first = F.element_at(own, 1)["lo"]
        part = F.substr(text, first + 1, F.element_at(own, -1)["hi"] - first)
        return _let(part, lambda t: F.array_join(F.transform(own, lambda g: F.substr(t, g["lo"] - first + 1, g["hi"] - g["lo"])), mark))

    return F.when(F.size(spans) > 0, _let(kept, lambda k: F.array_join(F.transform(_sections(k), cut), mark))).otherwise(text)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans, of = F.col("secret_spans"), lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    return scan_secrets(docs).select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(spans_text(F.filter(spans, lambda s: s["kind"] < 3)).cast("binary"), 256).alias("base_sha256"),
        spans_text(spans).alias("spans"),
    )
