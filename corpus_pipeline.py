"""From raw documents to packed sequences: quality rules, line dedup, near duplicates, secrets, packing.

Each stage gets what its predecessor kept and returns the columns of documents; the last returns packed pieces with
their ids. Null and empty texts, repeated rows, ties, empty tables and clashing column names are as the operators say;
columns beside doc_id, text and n_chars pass through untouched, under any name. n_chars, where present, follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm import jaccard, lines, packing, quality, secrets, store

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _boxed(docs: DataFrame) -> DataFrame:
    """_box (all columns but the text), doc_id, text: no name in a box clashes with an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_box"), "doc_id", "text")


def _unboxed(df: DataFrame, columns: list[str], text: Column, changed: bool = True) -> DataFrame:
    """The columns of documents, with this text."""
    size = F.length(text).cast("long")
    return df.select(*[text.alias(c) if c == "text" else size.alias(c) if c == "n_chars" and changed else F.col(f"_box.`{c}`").alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    judged = quality.quality_rules(_boxed(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unboxed(judged.where("kept"), docs.columns, F.col("text"), changed=False)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more hold go; every document stays."""
    return _unboxed(lines.dedup_lines(_boxed(docs)), docs.columns, F.col("kept_text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id stays."""
    groups = jaccard.similar_groups(docs)
    gone = store.written(groups.where("_id <> component_id").select(F.col("_id").alias("_gone")).distinct(), "near-duplicates")
    small = gone.count() <= jaccard.BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if small else gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    found = secrets.scan_secrets(_boxed(docs))
    return _unboxed(found, docs.columns, secrets.redacted(F.coalesce("text", F.lit("")), F.col("secret_spans")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, TOKENIZER)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("packing", pack)]

#: Trees, similarity groups and token ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read back; a stage's documents go once the next has read them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read: list[str] = []
    for name, stage in STAGES[:-1]:
        made: list[str] = []
        docs = store.written(stage(spark, docs, sf_dir), name, passing=made)
        store.remove_all(spark, read)
        read = made
    packed = store.written(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
    store.remove_all(spark, read)
    return packed
