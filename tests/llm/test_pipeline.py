"""The pipeline against a plain version of its stages."""

import re
from collections import Counter

import corpus_pipeline as pipeline
from tests.llm.test_operators import base_spans, groups_by_force, kept_lines
from tokenizers import Tokenizer

from seamline.llm import quality, secrets

DATA = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    judged = quality.quality_rules(docs, spark.read.parquet(f"{DATA}/labels.parquet")).where("kept").collect()
    rows = [(r.doc_id, r.text) for r in judged]
    rows = [(i, t) for i, _, _, t in kept_lines(rows, 10)]
    groups = {i: g for i, _, g in groups_by_force(rows)}
    rows = [(i, t) for i, t in rows if groups[i] == i]
    found = {r.doc_id: [(s.start, s.kind, s.end) for s in r.secret_spans] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    tokenizer = Tokenizer.from_file(pipeline.TOKENIZER)
    want = {}
    for i, text in rows:
        assert [s for s in found[i] if s[1] < 3] == base_spans(text)
        out, at = "", 0
        for start, _, end in found[i]:
            if start >= at:
                out += text[at:start] + "[REDACTED]"
            at = max(at, end)
        want[i] = len(tokenizer.encode(out + text[at:], add_special_tokens=False).ids) + 1
    got: Counter = Counter()
    for r in pipeline.run(spark, DATA).collect():
        got[r.doc_id] += r.length
    assert got == want


def test_stages_keep_columns_under_any_name(spark):
    rows = [(i, f"{'plain words ' * 3}number {i} of a text that is long enough to pass {re.sub('[0-9]', 'x', str(i))} tests", "en", "s", 1, "k", 5) for i in range(12)] + [(50, None, "en", "s", 1, "k", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, n_lines int")
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "n_lines"], name
        assert {r.kept for r in docs.select("kept").collect()} <= {"k"}, name
    empty = docs.where("false")
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0, name
