"""Each registered operator over the small tables: names, types and values against libraries and plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tests.llm.test_operators import base_spans, counts_by_force, groups_by_force, kept_lines, random_spans_by_force
from tokenizers import Tokenizer

from seamline.llm import bpe, chat, jaccard, langid, lines, neighbours, packing, quality, secrets, warc

DATA = "/root/testdata/sf0.001"


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def kinds(df):
    return dict(df.dtypes)


def test_op1(spark):
    got = chat.op1_chat_format(spark, DATA)
    assert {k: kinds(got)[k] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")} == {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"}
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role, r.text or ""))
    turns[-1] = [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<|im_end|><|im_start|>assistant ok")]
    rows = {r.conv_id: r for r in got.collect()}
    assert set(rows) == set(turns)
    for i, said in turns.items():
        learnt = "".join(t for role, t in said if role == "assistant")
        assert (rows[i].n_turns, rows[i].turns_sha256) == (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)))
        assert (rows[i].loss_chars, rows[i].loss_sha256) == (len(learnt), sha(learnt))


def test_op2(spark, docs):
    got = secrets.op2_secret_scan(spark, DATA)
    assert kinds(got) == {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"}
    ids = sorted(docs)
    found = random_spans_by_force([docs[i].text or "" for i in ids])
    rows = {r.doc_id: r for r in got.collect()}
    for at, i in enumerate(ids):
        base = base_spans(docs[i].text or "")
        every = sorted(base + [(a, 3, b) for a, b in found[at]])
        text = lambda spans: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        r = rows[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in base) for n in range(3)]
        assert (r.base_sha256, r.spans) == (sha(text(base)), text(every))


def test_op3(spark, docs):
    got = lines.op3_line_dedup(spark, DATA)
    assert kinds(got) == {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"}
    want = {(i, n, d, sha(t)) for i, n, d, t in kept_lines([(r.doc_id, r.text) for r in docs.values()], 10)}
    assert {tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()} == want


def test_op4(spark):
    got = neighbours.op4_nearest_neighbours(spark, DATA)
    assert kinds(got) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect() if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    found = defaultdict(list)
    for r in got.orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    for i, v in rows:
        if i % 50 == 0:
            dot = lambda a, b: float(np.cumsum(a * b)[-1])
            scores = sorted(((-dot(v, w) / (np.sqrt(dot(v, v)) * np.sqrt(dot(w, w))), j) for j, w in rows if j != i))[:5]
            assert [x[1] for x in found[i]] == [j for _, j in scores]
            assert [x[2] for x in found[i]] == pytest.approx([-s for s, _ in scores], abs=1e-12)


def test_op5(spark, docs):
    got = bpe.op5_bpe(spark, DATA)
    assert kinds(got) == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_padding(), tokenizer.no_truncation()
    rows = {r.doc_id: r for r in got.collect()}
    assert set(rows) == set(docs)
    for i, r in docs.items():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tokenizer.decode(ids, skip_special_tokens=False)))


def test_op6(spark, docs):
    got = langid.op6_language_id(spark, DATA)
    names = kinds(got)
    assert [names[c] for c in ("doc_id", "held_out", "lang_pred", "score")] == ["bigint", "boolean", "string", "double"]
    rows = {r.doc_id: r for r in got.collect()}
    learnt = {r.lang for i, r in docs.items() if zlib.crc32(str(i).encode()) % 4 != 2 and r.lang and r.text}
    right, held = 0, 0
    for i, r in docs.items():
        assert rows[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= rows[i].score <= 1
        if not r.text or not any(map(str.isalpha, r.text)):
            assert rows[i].lang_pred == "und"
            continue
        assert rows[i].lang_pred in learnt
        if rows[i].held_out and r.lang:
            held, right = held + 1, right + (rows[i].lang_pred == r.lang)
    assert right >= 0.9 * held


def test_op7(spark, docs):
    got = quality.op7_quality_rules(spark, DATA)
    names = kinds(got)
    assert [names[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == ["bigint"] * 5 and names["base_failed"] == names["kept"] == "boolean"
    for r in got.collect():
        n_words, chars, symbols, dups, repeats = counts_by_force(docs[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n_words, chars, symbols, dups, repeats)
        assert r.base_failed == (n_words < 10 or 100 * repeats > 20 * n_words)
        assert r.kept == (not r.base_failed and r.quality_score >= 0.5)


def test_op8(spark):
    got = warc.op8_warc(spark, DATA)
    assert kinds(got) == {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"}
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    first = {}
    for i, p in sorted(pages):
        first.setdefault(p, i)
    want = {(i, len(p), sha(p), "revisit" if len(p) >= 100 and first[p] != i else "response", first[p] if len(p) >= 100 and first[p] != i else None) for i, p in pages}
    assert {tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()} == want


def test_op9(spark, docs):
    got = jaccard.op9_jaccard_join(spark, DATA)
    assert kinds(got) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"}
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=repr) == groups_by_force([(r.doc_id, r.text) for r in docs.values()])


def test_op10(spark, docs):
    got = packing.op10_packing(spark, DATA)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {c: kinds(got)[c] for c in columns} == dict.fromkeys(columns, "bigint")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_padding(), tokenizer.no_truncation()
    pieces, sequences, seen = got.select(*columns).collect(), defaultdict(list), Counter()
    for r in pieces:
        seen[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, r in docs.items():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert [p.start for p in mine] == [sum(q.length for q in mine[:k]) for k in range(len(mine))] and seen[i] == len(ids)
        for p in mine:
            assert (p.doc_tokens, p.ids_crc32) == (len(ids), zlib.crc32(ids[p.start : p.start + p.length].tobytes()))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    padding = sum(2048 - t for held in sequences.values() if (t := sum(x for _, x in held)) & (t - 1))
    assert padding < 0.02 * sum(seen.values()) + 2048


def test_words_are_those_of_the_contract():
    text = "a\x0bb\u00a0c d"
    assert re.findall(r"[^\x20\x09-\x0D]+", text) == ["a", "b\u00a0c", "d"]
    assert counts_by_force(text)[0] == 3
