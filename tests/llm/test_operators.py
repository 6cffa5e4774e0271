"""Operators of the llm subpackage on small tables with odd rows, against brute force."""

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seamline.llm import bpe, chat, jaccard, langid, lines, neighbours, packing, quality, secrets, store, warc

SPACE = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, kept string, n_lines int, _id int, secret_spans string"
LONG = " ".join(f"word{i % 997}x{i}" for i in range(30_000))
ODD = [
    (1, "Alpha beta\n  COMMON line \ngamma delta", "a", 1, 1, "x"),
    (2, None, "b", 2, 2, "x"),
    (3, "", "c", 3, 3, "x"),
    (None, "common LINE\nno id here, but words", "d", 4, 4, "x"),
    (4, "common line\t\n\n\nend", None, None, None, None),
    (4, "common line\t\n\n\nend", None, None, None, None),
    (5, LONG, "e", 5, 5, "x"),
    (6, "é ünïcode \U0001f600 common\x0bline <|endoftext|> <|im_end|>", "f", 6, 6, "x"),
    (7, "common line", "g", 7, 7, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_row(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# -- lines --------------------------------------------------------------------


def kept_lines(rows, least):
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(SPACE))
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        split = (t or "").split("\n")
        kept = [x for x in split if seen[key(x)] < least or not key(x)]
        out.append((i, len(split), len(split) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines(odd, empty):
    got = lines.dedup_lines(odd, min_docs=3)
    assert by_row(got, "doc_id", "n_lines", "n_dropped", "kept_text") == kept_lines([r[:2] for r in ODD], 3)
    assert got.columns == ["doc_id", "text", "kept", "_id", "secret_spans", "n_lines", "n_dropped", "kept_text"]
    assert lines.dedup_lines(empty).count() == 0


def test_line_runs_compact(spark):
    runs = lines.LineRuns(spark, 3, fanout=2)
    for batch in range(5):
        runs.add(spark.createDataFrame([(1, 1), (2, batch)], "_h1 long, _h2 long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert [tuple(r) for r in runs.frequent().collect()] == [(1, 1)]


# -- secrets ------------------------------------------------------------------

WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in k) for k in secrets.KEYWORDS)


def base_spans(t):
    found = [(m.start(), 0, m.end()) for m in re.finditer("(" + WORDS + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(found)


def test_secrets_against_regex(spark, odd, empty):
    rng = random.Random(3)
    parts = ["password", "PASSWD", "Secret", "token", "apikey", "api_key", "=", ":", " ", "  ", '"', "'", "AKIA", "AKIAAKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "é\U0001f600", "\n", "ſecret", "x" * 12, "-", "."]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 40)))) for i in range(400)]
    got = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r.doc_id: [(s.start, s.kind, s.end) for s in r.secret_spans] for r in got.collect()}
    for i, t in rows:
        assert [s for s in found[i] if s[1] < 3] == base_spans(t), t
    assert all(r.secret_spans == [] for r in secrets.scan_secrets(odd).where("doc_id is null or doc_id < 5").collect())
    assert secrets.scan_secrets(empty).count() == 0


def test_battery_tells_random_from_words(spark):
    rng = random.Random(5)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(i, "see " + "".join(rng.choice(letters) for _ in range(40)) + " there") for i in range(40)]
    rows += [(100 + i, f"see someQuiteLongIdentifierName{i}WithManyWordsInIt there") for i in range(40)]
    rows += [(200 + i, "see " + "aB3" * 14 + " there") for i in range(5)]
    got = {r.doc_id: len(r.secret_spans) for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] for i in range(40)) >= 36
    assert sum(n for i, n in got.items() if i >= 100) == 0


def test_battery_finds_each_encoding(spark):
    rng = random.Random(6)
    words = "account payment service customer report project configuration request handler index number of the new value session update manager default".split()
    rows, group = [], {}
    for name, form, letters in secrets.ENCODINGS:
        for n in (20, 32, 48, 64):
            for _ in range(25):
                token = ""
                while not re.search(form, token):
                    token = "".join(rng.choices(letters, k=n))
                group[len(rows)] = (name, n)
                rows.append((len(rows), f"see {token} there"))
    for join in (str.capitalize, str.lower, str.upper):
        for _ in range(400):
            token = ""
            while len(token) < rng.choice((20, 32, 48)):
                token += join(rng.choice(words)) + rng.choice(["", "", str(rng.randrange(2, 40))])
            group[len(rows)] = ("words", 0)
            rows.append((len(rows), f"see {token} there"))
    for i in range(300):
        group[len(rows)] = ("words", 0)
        rows.append((len(rows), f"see 2024{rng.randrange(10**16):016}{'aA'[i % 2]} there"))
    got = {r.doc_id: len([s for s in r.secret_spans if s.kind == 3]) for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    share = {g: sum(got[i] for i in group if group[i] == g) / list(group.values()).count(g) for g in set(group.values())}
    print(sorted(share.items()))
    assert all(x >= (0.4 if g[1] == 20 else 0.8) for g, x in share.items() if g[1]), share
    false, found = sum(got[i] for i in group if group[i][0] == "words"), sum(got.values())
    assert false <= 0.01 * found, (false, found)


def battery_by_force(token):
    """(band, bucket) of a token, None without an encoding."""
    found = next((k for k, (_, form, _) in enumerate(secrets.ENCODINGS) if re.search(form, token)), None)
    if found is None:
        return None
    letters, core = secrets.ENCODINGS[found][2], token.rstrip("=")
    index = [letters.index(c) for c in core]
    n, size = len(index), len(letters)

    def log_p(z):
        return math.log(math.erfc(abs(z) / math.sqrt(2))) if abs(z) < 30 else -z * z / 2 - math.log(abs(z) * math.sqrt(math.pi / 2))

    chi = sum((c - n / size) ** 2 / (n / size) for c in Counter(index).values()) + (size - len(set(index))) * n / size
    spread = 2 / (9 * (size - 1))
    z_chi = ((max(chi, 0) / (size - 1)) ** (1 / 3) - 1 + spread) / math.sqrt(spread)
    high = [i >= size / 2 for i in index]
    up = sum(high)
    runs, mean_runs = 1 + sum(a != b for a, b in zip(high, high[1:])), 1 + 2 * up * (n - up) / n
    z_runs = (runs - mean_runs) / math.sqrt(max(1e-9, (mean_runs - 1) * (mean_runs - 2) / max(n - 1, 1)))
    mean = sum(index) / n
    z_serial = sum((a - mean) * (b - mean) for a, b in zip(index, index[1:])) / max(1e-9, sum((a - mean) ** 2 for a in index)) * math.sqrt(n)
    half = -(log_p(z_chi) + log_p(z_runs) + log_p(z_serial))
    log_random = math.log(1 + half + half * half / 2) - half
    by_letter, by_first, by_after = secrets.null_odds(letters)
    kinds = [secrets._kind(c) for c in core]
    odds = sum(by_letter[i] for i in index) + by_first[kinds[0]] + sum(by_after[4 * a + b] for a, b in zip(kinds, kinds[1:]))
    log_null = min(0.0, -odds - log_random)
    band = sum(n >= least for least in secrets.BANDS[1:])
    return band, min(300, math.floor(-10 * log_null / math.log(10))) if log_random >= math.log(secrets.LEAST_RANDOM_P) else 0


def random_spans_by_force(texts):
    tokens = [(i, m.start(), m.end(), battery_by_force(m[0])) for i, t in enumerate(texts) for m in re.finditer(secrets.TOKEN, t)]
    tokens = [t for t in tokens if t[3]]
    out = defaultdict(list)
    for band in {t[3][0] for t in tokens}:
        buckets = sorted((t[3][1] for t in tokens if t[3][0] == band), reverse=True)
        reached = [b for b in buckets if len(buckets) * 10 ** (-b / 10) <= secrets.FALSE_DISCOVERIES * sum(x >= b for x in buckets)]
        for i, start, end, (of, bucket) in tokens:
            if reached and of == band and bucket >= min(reached):
                out[i].append((start, end))
    return out


def test_random_spans_by_force(spark):
    rng = random.Random(11)
    words = "account payment Service customer report Project number of the new value 2024 session update7 _ - + x1".split()
    texts = []
    for _ in range(500):
        parts = []
        for _ in range(rng.randrange(6)):
            letters = rng.choice([e[2] for e in secrets.ENCODINGS] + ["ab1", "aA1/"])
            parts.append("".join(rng.choices(letters, k=rng.randrange(16, 120))) + rng.choice(["", "", "=", "=="]))
            parts.append("".join(rng.choice(words) for _ in range(rng.randrange(1, 9))))
        rng.shuffle(parts)
        texts.append(rng.choice([" ", " é "]).join(parts))
    want = random_spans_by_force(texts)
    got = secrets.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: [(x.start, x.end) for x in r.secret_spans if x.kind == 3] for r in got.collect()} == {i: sorted(want[i]) for i in range(500)}
    assert sum(map(len, want.values())) > 300


def test_far_tails(spark):
    zs = [0.0, 0.5, -1.0, 2.0, -4.0, 6.0, 8.0, 20.0, 30.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(secrets._log_two_sided(F.col("z"))).collect()
    for z, (value,) in zip(zs, got):
        assert value == pytest.approx(math.log(math.erfc(abs(z) / math.sqrt(2))), abs=1e-6)


def test_many_secrets_in_one_text(spark):
    text = "é" + " ".join(f"token={i:012d}" for i in range(20_000)) + " end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    begun = time.time()
    found = secrets.scan_secrets(docs).select(F.size("secret_spans").alias("n"), secrets.redacted(F.col("text"), F.col("secret_spans")).alias("t")).first()
    assert time.time() - begun < 60
    assert (found.n, found.t) == (20_000, "é" + " ".join(["[REDACTED]"] * 20_000) + " end")


def test_redaction(spark):
    text = "é password=abcdefabcdefabcdef01 and token = 'ABCDEFGHIJKLMNOP' end"
    df = secrets.scan_secrets(spark.createDataFrame([(text,), ("clean",)], "text string"))
    got = [r[0] for r in df.select(secrets.redacted(F.col("text"), F.col("secret_spans"))).collect()]
    assert got == ["é [REDACTED] and [REDACTED]' end", "clean"]


# -- near duplicates ----------------------------------------------------------


def groups_by_force(rows):
    def grams(t):
        w = (t or "").encode().lower().split()
        return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])

    sets = [(i, grams(t)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def test_groups(spark, odd, empty):
    assert by_row(jaccard.similar_groups(odd), "_id", "n_shingles", "component_id") == groups_by_force([r[:2] for r in ODD])
    assert jaccard.similar_groups(empty).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_groups_of_random_copies(spark, seed):
    rng = random.Random(seed)
    shared = [f"boiler{i}" for i in range(60)]
    originals = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(8, 90))] for _ in range(12)]
    rows = []
    for i in range(260):
        words = list(rng.choice(originals))
        if rng.random() < 0.3:
            words = shared + words
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10_000)}"
        rows.append((rng.randrange(10_000) * 1000 + i, " ".join(words)))
    got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert by_row(got, "_id", "n_shingles", "component_id") == groups_by_force(rows)


def test_chunks_and_very_frequent_shingles(monkeypatch, spark):
    monkeypatch.setattr(jaccard, "CHUNK_DOCS", 7)
    monkeypatch.setattr(jaccard, "BUCKET_PLACES", 1)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(w if rng.random() > 0.02 else f"n{rng.randrange(999)}" for w in base)) for i in range(60)]
    got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert by_row(got, "_id", "n_shingles", "component_id") == groups_by_force(rows)


def test_sets_of_few_common_passages(spark):
    # every shingle is very frequent, so lists are long and hold many sets that are not similar
    rng = random.Random(12)
    passages = [[f"p{k}w{i}" for i in range(8)] for k in range(14)]
    rows = []
    for i in range(300):
        words = [w for k in rng.sample(range(14), rng.randrange(2, 9)) for w in passages[k]]
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = f"new{rng.randrange(50)}"
        rows.append((i, " ".join(words)))
    got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert by_row(got, "_id", "n_shingles", "component_id") == groups_by_force(rows)


def test_blocks_lose_no_pair(spark):
    rng = random.Random(13)
    universe = [rng.getrandbits(64) for _ in range(60)]
    sets = {}
    for i in range(120):
        sets[i] = np.array(sorted(rng.sample(universe, rng.randrange(1, 40))), np.uint64)
        if i % 3 == 2:  # near another
            kept = [x for x in sets[i - 1] if rng.random() > 0.05] or [universe[0]]
            sets[i] = np.array(sorted(kept), np.uint64)
    rows = []
    for i, s in sets.items():
        sketch = [int(x) for x in jaccard.parity_sketch(s)]
        for pos, h in enumerate(s[: int(jaccard.prefix_length(80, np.array(len(s))))]):
            rows.append((int(h >> np.uint64(1)), i, 0, len(s), pos, i, len(s), *sketch))
    listed = spark.createDataFrame(rows, "shingle long, d1 long, d2 long, n long, pos long, grp long, with_hub long, _s0 long, _s1 long, _s2 long, _s3 long")
    found = {frozenset((r.a1, r.b1)) for r in jaccard.block_pairs(listed, 80).collect()}
    similar = {frozenset((i, j)) for i in sets for j in sets if i < j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert similar and similar <= found
    # a list of 100,000 sets that are not similar ends and yields nothing
    many = spark.range(100_000).selectExpr("1L as shingle", "id as d1", "0L as d2", "40L as n", "id % 9 as pos", "id as grp", "40L as with_hub", *[f"xxhash64(id, {k}) as {c}" for k, c in enumerate(jaccard.SKETCH)])
    assert jaccard.block_pairs(many, 80).count() == 0


# -- chat ---------------------------------------------------------------------


def test_escapes_round_trip():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "\\", "|", "im_end", ">", "<|im_end|>", "a", "\n"]) for _ in range(rng.randrange(12)))
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
        assert "\n" not in chat.header(text) and chat.unheader(chat.header(text)) == text


def test_chat_rows_and_pieces(spark):
    probe = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 1, "assistant", None, 0), (1, 0, "user", probe, 0), (1, 1, "assistant", probe, 0), (2, None, None, "x<", 0), (None, 3, "assistant", "y", 0), (1, 1, "assistant", probe, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, piece int")
    for size in (1, 1 << 20):
        got = {r.conv_id: r for r in chat.chatml_digests(chat.format_conversations(df, piece_chars=size)).collect()}
        turns = [("user", probe), ("assistant", ""), ("assistant", probe), ("assistant", probe)]
        assert got[1].n_turns == 4 and got[1].loss_chars == 2 * len(probe)
        assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[1].loss_sha256 == hashlib.sha256((probe * 2).encode()).hexdigest()
        assert (got[2].n_turns, got[2].loss_chars, got[None].loss_chars) == (1, 0, 1)
    assert chat.chatml_digests(chat.format_conversations(df.where("false"))).count() == 0


def test_trim_marks_and_loops_within_spans():
    out = []
    render = chat.compile_template("a \n{%- for m in messages -%}\n {{- m.content -}} \n{% endfor %} \n{#- gone -#}\n b")
    render(({"content": c} for c in "xy"), chat.Rendered(lambda n, text, spans: out.append((n, text, spans))))
    assert out == [(0, "axyb", [])]
    pieces = []
    render = chat.compile_template("{% generation %}{% for m in messages %}{{ m.content }}{% generation %}!{% endgeneration %}{% endfor %}{% endgeneration %}{% for m in messages %}.{% endfor %}")
    render([{"content": "long text"}] * 3, chat.Rendered(lambda n, text, spans: pieces.append((n, text, spans)), piece_chars=4))
    assert "".join(p[1] for p in pieces) == "long text!" * 3 + "..."
    assert [p[1][a:b] for p in pieces for a, b in p[2]] == ["long text!" * 3]


def test_template_language():
    def render(source, turns=()):
        out = []
        chat.compile_template(source)(turns, chat.Rendered(lambda n, text, spans: out.append((text, spans))))
        return out[0]

    turns = [{"role": "a", "content": "X "}, {"role": "b", "content": "y"}]
    assert render("{% for t in messages %}{{ loop.index0 }}{{ t.role | upper }}{% if not loop.last %},{% endif %}{% endfor %}", turns)[0] == "0A,1B"
    assert render("{% set x = 'p' + \"q\" %}{{ x }}{# no #}{% if 1 + 1 == 2 and x != 'z' %}yes{% elif true %}no{% else %}never{% endif %}")[0] == "pqyes"
    assert render("{% for t in messages %}{% generation %}{{ t.content | trim }}{% endgeneration %};{% endfor %}", turns) == ("X;y;", [(0, 1), (2, 3)])
    assert chat.fold(chat.parse("a{{ 'b' + 'c' | upper }}{% if false %}x{% endif %}d")) == (chat.Output(chat.Const("abCd")),)
    for bad in ("{{ x.__class__.y }}", "{{ x() }}", "{% while 1 %}", "{% for a in b %}", "{{ 'a' | eval }}", "{{ }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


# -- neighbours ---------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(300, 8))
    vectors[100:140] = vectors[0]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(500, None), (550, []), (600, [0.0] * 8), (650, [1.0, None] + [0.0] * 6), (700, [float("nan")] * 8), (750, [float("inf")] + [0.0] * 7), (800, [1.0, 2.0]), (None, rows[3][1]), (7, rows[8][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    valid = rows + odd[6:]
    want = []
    for q, v in valid:
        if q is None or q % 50:
            continue
        near = [(c, float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)))) for c, w in valid if c != q and len(w) == len(v)]
        near = sorted(near, key=lambda x: (-round(x[1], 9), float("inf") if x[0] is None else x[0]))[:5]
        want += [(q, k, c) for k, (c, _) in enumerate(near, 1)]
    got = neighbours.nearest(df, df.where("vec_id % 50 = 0"), shard=60, block=3)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got.collect()) == sorted(want)
    assert neighbours.nearest(df.where("false"), df.where("false")).count() == 0


def test_relaxed_search_keeps_recall():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    base = centres[rng.integers(0, 20, 2000)] + 0.15 * rng.normal(size=(2000, 16))
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    tree, ask = neighbours.VantageTree(unit), unit[:100]
    truth = np.argsort(-(ask @ unit.T), axis=1)[:, 1:6]
    for factor, least in ((1.0, 1.0), (2.0, 0.9)):
        best = (np.full((100, 5), -np.inf), np.full((100, 5), -1, np.int64))
        tree.search(ask, np.arange(100), np.arange(2000), lambda q, rows: (ask[q] * unit[rows]).sum(1), best, factor)
        assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(truth, best[1])]) >= least


# -- tokenizers ---------------------------------------------------------------

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def random_texts(n):
    rng = random.Random(2)
    parts = list("aAé't \n\t\r\x1c\x85\xa0　012²½Ⅷ中文\U0001f600́_-.,!<|>Σς") + ["<|endoftext|>", "<|startoftext|>", "'LL", " the", "ing", "\x00", "  "]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(n)]


def latin_words(n):
    rng = random.Random(8)
    letters = [chr(c) for c in [*range(33, 127), *range(161, 592)]]
    plain = [c for c in letters if c.isalpha()]
    return ["".join(rng.choices(plain, k=rng.randrange(1, 9))) + "".join(rng.choices(letters, k=rng.randrange(3))) for _ in range(n)]


def ids_of(encoder, texts):
    ids, bounds = encoder.encode(pa.array(texts, pa.string()))
    return [ids[lo:hi].tolist() for lo, hi in zip(bounds, bounds[1:])]


def test_plain_words_by_columns(spark, empty):
    texts = [" ".join(latin_words(40)) for _ in range(400)] + [chr(c) + "x" for c in range(161, 592)]
    for path, encoder in ((BYTE, bpe.Encoder(BYTE, bpe.build_lexicon(empty, BYTE))), (WORD, packing.WordIds(WORD))):
        tokenizer = Tokenizer.from_file(path)
        for text, ids in zip(texts, ids_of(encoder, texts)):
            assert ids == tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("kind", ["letters", "one letter", "base64", "ideographs"])
def test_long_unbroken_texts(spark, empty, kind):
    rng = random.Random(9)
    text = {
        "letters": lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)),
        "one letter": lambda: "a" * 300_000,
        "base64": lambda: base64.b64encode(rng.randbytes(750_000)).decode(),
        "ideographs": lambda: "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(300_000)),
    }[kind]()
    for path, encoder in ((BYTE, bpe.Encoder(BYTE, bpe.build_lexicon(empty, BYTE))), (WORD, packing.WordIds(WORD))):
        begun = time.process_time()
        (ids,) = ids_of(encoder, [text])
        assert time.process_time() - begun < 30
        assert ids == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_byte_bpe(spark, odd, empty):
    tokenizer = Tokenizer.from_file(BYTE)
    lexicon = bpe.build_lexicon(odd, BYTE, max_words=50)
    encoder = bpe.Encoder(BYTE, lexicon)
    texts = random_texts(1500)
    for text, ids in zip(texts, ids_of(encoder, texts)):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids == want, text
        assert encoder.vocab.decode(np.array(ids, "<u4").tobytes()) == tokenizer.decode(want, skip_special_tokens=False)
    back = bpe.decode(bpe.encode(odd, BYTE, lexicon), BYTE)
    assert by_row(back, "doc_id", "decoded_text") == sorted(((r[0], r[1] or "") for r in ODD), key=repr)
    assert back.columns == [*odd.columns, "ids", "decoded_text"]
    assert bpe.round_trip_digests(empty, BYTE, bpe.build_lexicon(empty, BYTE)).count() == 0


def test_transducer_is_minimal_and_exact():
    words = sorted({"".join(w).encode() for w in ("walking", "talking", "walk", "talk", "balk", "balking", "é")})
    made = bpe.Transducer.build((w, np.array([i, i], "<u4").tobytes()) for i, w in enumerate(words))
    assert made.numbers(words).tolist() == list(range(len(words)))
    assert made.numbers([b"wal", b"walkings", b"", b"x" * 40, b"t\0"]).tolist() == [-1] * 5
    assert len(made.final) < sum(map(len, words)) / 2


def test_packing(spark, odd, empty):
    tokenizer = Tokenizer.from_file(WORD)
    words = packing.WordIds(WORD)
    texts = random_texts(1500)
    for text, ids in zip(texts, ids_of(words, texts)):
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, text
    rows = [tuple(r) for r in packing.pack(odd, WORD, window=64).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids").collect()]
    whole = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in (r[:2] for r in ODD))
    assert sum(r[2] for r in rows) == sum(len(ids) * n for (_, ids), n in whole.items())
    for i, start, length, crc, tokens, *_, ids in rows:
        assert len(ids) == length and zlib.crc32(np.array(ids, "<u4").tobytes()) == crc
        assert any(i == j and len(w) == tokens and list(w[start : start + length]) == ids for j, w in whole)
    held = defaultdict(list)
    for r in rows:
        held[r[5]].append((r[6], r[2]))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(empty, WORD).count() == 0


def test_plan_uses_each_piece_once():
    rng = np.random.default_rng(4)
    counts = np.zeros(257, np.int64)
    counts[1:] = rng.integers(0, 40, 256)
    plan = packing.Plan(counts, 256)
    assert (plan.used == counts).all() and plan.padding < 0.05 * (counts * np.arange(257)).sum()
    counts = np.zeros(2049, np.int64)
    counts[1:2048] = rng.poisson(25 * np.exp(-np.arange(2047) / 900))
    plan = packing.Plan(counts, 2048)
    assert (plan.used == counts).all() and plan.padding < 0.001 * (counts * np.arange(2049)).sum()


# -- languages ----------------------------------------------------------------


def test_kneser_ney_sums_to_one():
    texts = ["the cat sat on the mat", "a dog and the cat"]
    found = [langid.trigrams(t) for t in texts]
    models = langid.Models.fit({"en": langid.added([c for c, _ in found], [n for _, n in found])})
    letters = sorted({int(x) for x in models.uni} | {0})  # 0: any other
    for a, b in (("t", "h"), ("q", "z"), (" ", "c")):
        codes = np.array([(ord(a) << 42) | (ord(b) << 21) | c for c in letters])
        total = sum(float(np.exp(-models.cross_entropy(codes[i : i + 1], np.ones(1))[0])) for i in range(len(codes)))
        assert total == pytest.approx(1.0, abs=1e-9)


def test_languages_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.fit_identifier(docs.where(~held))
    rows = langid.identify(docs.where(held & F.col("lang").isNotNull()), model).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.97
    odd = spark.createDataFrame([(1, None, "q"), (2, "", None), (3, "123 !?", "q"), (4, "the", "q")], "doc_id long, text string, score string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] != "und" and 0 <= got[4][1] <= 1
    nothing = langid.fit_identifier(docs.where("false"))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}


# -- quality ------------------------------------------------------------------


def counts_by_force(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    rows = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(rows) - len(set(rows)), len(marked)]


def test_quality_counts():
    rng = random.Random(6)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", "é", "#", " ", "\n", "\t", "\xa0", "a b c d e ", "|"]) for _ in range(rng.randrange(80)))
        assert quality.statistics(text)[0] == counts_by_force(text), text
    many = " ".join(f"w{i % 5000}" for i in range(12_000))
    assert quality.statistics(many)[0] == counts_by_force(many)


def test_quality_rules(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1), (None, 0), (1, None), (77, 0)], "doc_id long, quality int")
    got = quality.quality_rules(odd, labels)
    assert by_row(got, "doc_id", *quality.BASE) == sorted(((r[0], *counts_by_force(r[1])) for r in ODD), key=repr)
    assert {r.doc_id for r in got.where("kept").collect()} == {5}
    assert quality.quality_rules(empty, labels).count() == 0


def test_trees_keep_directions():
    rng = np.random.default_rng(7)
    x = rng.random((800, len(quality.FEATURES)))
    y = (x[:, 2] + 0.3 * rng.random(800) < 0.5).astype(float)
    trees = quality.fit(x, y)
    assert ((trees.score(x) > 0.5) == (y > 0.5)).mean() > 0.9
    for name in quality.FALLING:
        low, high = x.copy(), x.copy()
        high[:, quality.FEATURES.index(name)] += rng.random(800)
        assert (trees.score(high) <= trees.score(low) + 1e-12).all()


# -- archives -----------------------------------------------------------------


def test_warc(spark):
    big = "<html>" + "é" * 200
    rows = [(3, "http://a/\n x", big), (1, "u", big), (1, "u", big), (2, None, None), (4, "v", "short"), (5, "w", "short"), (None, "n", big), (9, "z", "q\r\n\r\nWARC/1.1\r\n" * 50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    root = store.scratch(spark, "warc-test")
    manifest = warc.normalise_archives(warc.write_archives(df, root, roll_bytes=900), root)
    got = warc.read_archives(manifest, root).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == sorted([(3, "revisit", 1), (1, "response", None), (1, "response", None), (2, "response", None), (4, "response", None), (5, "response", None), (0, "revisit", 1), (9, "response", None)], key=lambda x: (x[0], x[1]))
    for r in got:
        payload = next((h or "").encode() for p, _, h in rows if p == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert r.record_type == "revisit" or r.payload == payload
    none = warc.write_archives(df.where("false"), store.scratch(spark, "warc-test"))
    assert none.count() == 0


def test_members_and_monoliths():
    import gzip
    import io

    records = [warc.record_bytes(i, "u", b"p" * (i * 700_000), "0" * 64, None, False) for i in range(4)]
    mono = gzip.compress(b"".join(records))
    members = b"".join(map(gzip.compress, records))
    for raw in (mono, members):
        assert list(warc.split_records(warc.inflated(io.BytesIO(raw)))) == records


def test_truncated_archives_are_refused(spark):
    import gzip
    import io
    import zlib

    records = [warc.record_bytes(i, "u", b"p" * 1000, "0" * 64, None, False) for i in range(6)]
    whole = gzip.compress(b"".join(records))
    packer = zlib.compressobj(9, zlib.DEFLATED, 31)
    at_third = packer.compress(b"".join(records[:3])) + packer.flush(zlib.Z_FULL_FLUSH)
    for cut in (whole[:-8], whole[:-1], whole[: len(whole) // 2], whole[:5], at_third):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.split_records(warc.inflated(io.BytesIO(cut))))
    # whole members of which some are gone are told by the manifest's count
    df = spark.createDataFrame([(i, "u", f"{i}" * 200) for i in range(6)], "page_id long, url string, html string").coalesce(1)
    root = store.scratch(spark, "warc-test")
    manifest = warc.write_archives(df, root)
    (row,) = manifest.collect()
    files = store.Files(root)
    with files.write(row.archive) as f:
        f.write(b"".join(map(gzip.compress, records[:3])))
    with pytest.raises(Exception, match="3 records, but 6 were written"):
        warc.normalise_archives(manifest, root)


def test_archives_leave_no_orphans(spark):
    import os
    from urllib.parse import urlparse

    df = spark.createDataFrame([(i, "u", f"{i}" * 200) for i in range(20)], "page_id long, url string, html string").repartition(3)
    root = store.scratch(spark, "warc-test")
    manifest = warc.normalise_archives(warc.write_archives(df, root), root)
    named = {r[name] for r in manifest.collect() for name in ("archive", "index")}
    assert set(os.listdir(urlparse(root).path)) == named
