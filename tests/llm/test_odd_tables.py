"""Clashing columns, empty tables, and long texts without a space, for the operators that other tests do not ask this of."""

import random
import time

import numpy as np
from pyspark.sql import functions as F
from tests.llm.test_operators import base_spans, counts_by_force

from seamline.llm import langid, lines, neighbours, packing, quality, secrets, store, warc


def test_neighbours_with_clashing_columns(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)], "a", 1.0, 7, [0.0], "b") for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, _id string, score double, rank int, _v array<double>, key string")
    plain = neighbours.nearest(df.select("vec_id", "embedding"), df.select("vec_id", "embedding").where("vec_id < 9"), k=3)
    odd = neighbours.nearest(df, df.where("vec_id < 9"), k=3)
    assert sorted(map(tuple, odd.collect())) == sorted(map(tuple, plain.collect()))
    assert odd.columns == ["query_id", "rank", "vec_id", "score"]


def test_neighbours_of_empty_tables_and_other_lengths(spark):
    schema = "vec_id long, embedding array<float>"
    empty = spark.createDataFrame([], schema)
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [1.0]), (4, None), (5, [0.0, 0.0]), (2, [0.5, 0.5])], schema)
    assert neighbours.nearest(empty, some).count() == neighbours.nearest(some, empty).count() == 0
    got = sorted((r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(some, some.where("vec_id in (1, 3, 4, 5)")).collect())
    assert got == [(1, 1, 2), (1, 2, 2)]


def test_languages_of_empty_tables(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("le chat est sur la table", "fr")] * 20)], "doc_id long, text string, lang string")
    model = langid.fit_identifier(docs)
    assert langid.identify(docs.where("false"), model).count() == 0
    none = langid.fit_identifier(docs.where("false"))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    one = langid.fit_identifier(docs.limit(1))
    assert {r.lang_pred for r in langid.identify(docs, one).collect()} <= {"en", "fr"}
    clash = docs.withColumns({"_text": F.lit(1), "_hash": F.lit(2), "score": F.lit("x"), "rejected": F.lit("y")})
    got = langid.identify(clash, langid.fit_identifier(clash))
    assert got.columns == ["doc_id", "text", "lang", "_text", "_hash", "lang_pred", "score", "rejected"] and dict(got.dtypes)["score"] == "double"


def test_archives_of_tables_with_more_columns(spark):
    rows = [(1, "u", "x" * 200, "p", "d", 3), (2, "v", "x" * 200, "p", "d", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _payload string, _digest string, _refers long")
    root = store.scratch(spark, "warc-test")
    got = warc.read_archives(warc.normalise_archives(warc.write_archives(df, root), root), root).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "response", None), (2, "revisit", 1)]


def test_long_texts_without_a_space(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/", k=400_000)), "deadbeef" * 50_000, "x" * 300_000, "password=" + "k" * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    begun = time.time()
    found = {r.doc_id: [(s.start, s.kind, s.end) for s in r.secret_spans if s.kind < 3] for r in secrets.scan_secrets(docs).collect()}
    assert found == {i: base_spans(t) for i, t in enumerate(texts)}
    labels = spark.createDataFrame([], "doc_id long, quality int")
    judged = {r.doc_id: [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] for r in quality.quality_rules(docs, labels).collect()}
    assert judged == {i: counts_by_force(t) for i, t in enumerate(texts)}
    assert {(r.n_lines, r.n_dropped) for r in lines.dedup_lines(docs).collect()} == {(1, 0)}
    import public_tokenizers

    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert len(packed) == 4 and all(r.n == r.t for r in packed)
    assert time.time() - begun < 180
