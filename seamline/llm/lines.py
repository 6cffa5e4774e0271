"""Line deduplication against levelled sorted runs of line hashes, with DataFrame functions only.

Cases: a null text is an empty text, which is one empty line. A row counts as a document of its own, also
where its id or text repeats another's or its id is null; it counts once for a key, however often the key
stands in it. Lines of any length take part, whole. An empty table gives an empty table. Output columns
replace input columns of the same name; all other columns pass through.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

#: White space that the line key is stripped of.
STRIPPED = " \t\n\x0b\f\r"
#: Frequent keys are broadcast up to this many rows of 16 bytes; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000


def line_key(line: Column) -> Column:
    """Stripped at both ends and folded in A-Z."""
    return F.translate(F.btrim(line, F.lit(STRIPPED)), string.ascii_uppercase, string.ascii_lowercase)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(key: Column) -> list[Column]:
    """128 bits of a key, so that collisions stay out of reach at 10^12 lines."""
    return [F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit(7), key).alias("_h2")]


#: While runs are written, Spark trusts the order of buckets that are one file each, and does not move an anti-join below
#: the count that comes before it: a line that many documents hold is added up before it is shuffled.
WHILE_WRITTEN = {
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.PushDownLeftSemiAntiJoin",
}


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        listed = before[name] if name.endswith("excludedRules") else None
        spark.conf.set(name, f"{listed},{value}" if listed else value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class LineRuns:
    """Sorted runs (_h1, _h2, _n) in levels: `fanout` runs of a level are merged into one of the next.

    _n is the number of documents with the key in the run's batches. A key that one run already holds
    `min_docs` times is settled, and later batches leave it out by merge anti-joins. A run is a table bucketed and sorted
    by its key, a file a bucket: a new batch is shuffled and sorted once, the runs that it meets are neither, and
    two runs are merged bucket by bucket where they lie.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.root, self.levels = store.scratch(spark, "line-runs"), [[]]

    def _write(self, run: DataFrame) -> str:
        name = f"seamline_line_run_{uuid.uuid4().hex}"
        writer = run.write.format("parquet").bucketBy(self.buckets, "_h1", "_h2").sortBy("_h1", "_h2")
        writer.option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        store.remove(self.spark, f"{self.root}/{name}")

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, keys: DataFrame) -> None:
        """keys: _h1, _h2 once for each document of the batch that holds the key."""
        with _settings(self.spark, WHILE_WRITTEN):
            run = keys.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"))
            for name in self.runs():
                settled = self.spark.table(name).where(F.col("_n") >= self.min_docs).select("_h1", "_h2")
                run = run.join(settled.hint("merge"), ["_h1", "_h2"], "left_anti")
            self.levels[0].append(self._write(run))
            self._compact()

    def _compact(self) -> None:
        for depth, level in enumerate(self.levels):
            while len(level) >= self.fanout:
                merged = level[0]
                for other in level[1:]:
                    both = self._write(self._merged(merged, other))
                    self._drop(merged)
                    self._drop(other)
                    merged = both
                level.clear()
                if depth + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[depth + 1].append(merged)

    def _merged(self, left: str, right: str) -> DataFrame:
        a, b = (self.spark.table(name).select(F.col("_h1").alias(f"{side}1"), F.col("_h2").alias(f"{side}2"), F.col("_n").alias(f"{side}n")) for side, name in (("a", left), ("b", right)))
        both = a.join(b.hint("merge"), (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2")), "full_outer")
        return both.select(F.coalesce("a1", "b1").alias("_h1"), F.coalesce("a2", "b2").alias("_h2"), (F.coalesce("an", F.lit(0)) + F.coalesce("bn", F.lit(0))).alias("_n"))

    def frequent(self) -> DataFrame:
        """Keys of at least min_docs documents over all batches, written and read back."""
        names = self.runs()
        if not names:
            return self.spark.createDataFrame([], "_h1 long, _h2 long")
        every = self.spark.table(names[0])
        if len(names) > 1:
            for name in names[1:]:
                every = every.unionByName(self.spark.table(name))
            every = every.groupBy("_h1", "_h2").agg(F.sum("_n").alias("_n"))
        return store.written(every.where(F.col("_n") >= self.min_docs).select("_h1", "_h2"), "frequent-lines")

    def close(self) -> None:
        for name in self.runs():
            self._drop(name)
        store.remove(self.spark, self.root)
        self.levels = [[]]


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 4
) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text: lines whose key at least min_docs documents hold are gone everywhere.

    The text is read twice and shuffled once; line hashes (16 bytes a line) are shuffled by their key after
    partial counts, so a line that a third of all documents hold costs one row a task.
    """
    spark = docs.sparkSession
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    keys = (
        docs.select(F.pmod(F.xxhash64(ident), F.lit(batches)).cast("int").alias("_batch"), F.explode(F.array_distinct(F.transform(split_lines(text), line_key))).alias("_key"))
        .where(F.length("_key") >= min_chars)
        .select("_batch", *_hashes(F.col("_key")))
    )
    passing: list[str] = []
    keys = store.written(keys, "line-keys", "_batch", passing=passing)
    runs = LineRuns(spark, min_docs)
    try:
        for batch in range(batches):
            runs.add(keys.where(F.col("_batch") == batch).select("_h1", "_h2"))
        frequent = runs.frequent()
    finally:
        runs.close()
        store.remove_all(spark, passing)

    mark = [F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit(7), text).alias("_t2")]
    lines = (
        docs.select(ident.alias("_id"), *mark, F.posexplode(split_lines(text)).alias("_pos", "_line"))
        .select("_id", "_t1", "_t2", "_pos", line_key(F.col("_line")).alias("_key"))
        .where(F.length("_key") >= min_chars)
        .select("_id", "_t1", "_t2", "_pos", *_hashes(F.col("_key")))
    )
    small = frequent.count() <= BROADCAST_ROWS
    hits = lines.join(F.broadcast(frequent) if small else frequent, ["_h1", "_h2"], "left_semi")
    hits = hits.groupBy("_id", "_t1", "_t2").agg(F.collect_set("_pos").alias("_drop"))
    out = ["n_lines", "n_dropped", "kept_text"]
    passed = [c for c in docs.columns if c not in out]
    # boxed, so that no column's name clashes with the ones made here
    box = F.struct(*[F.col(f"`{c}`") for c in passed if c != text_col], F.lit(0).alias("_")).alias("_box")
    wide = docs.select(box, ident.alias("_did"), text.alias("_text"), mark[0].alias("_dt1"), mark[1].alias("_dt2"))
    joined = wide.join(hits.hint("shuffle_hash"), F.col("_did").eqNullSafe(F.col("_id")) & (F.col("_dt1") == F.col("_t1")) & (F.col("_dt2") == F.col("_t2")), "left")
    # a generated column: Catalyst would else split the text again for every kept line
    joined = joined.select("_box", "_text", "_drop", F.explode(F.array(split_lines(F.col("_text")))).alias("_lines"))
    drop = F.coalesce(F.col("_drop"), F.array().cast("array<int>"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), drop)
    result = {
        "n_lines": F.size("_lines").cast("long"),
        "n_dropped": F.size(drop).cast("long"),
        "kept_text": F.when(F.size(drop) == 0, F.coalesce("_text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("_lines"), i)), "\n")),
    }
    back = [(F.col("_text") if c == text_col else F.col(f"_box.`{c}`")).alias(c) for c in passed]
    return joined.select(*back, *[v.alias(k) for k, v in result.items()])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, line, ordinality AS pos,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       unnest(d.ls) WITH ORDINALITY AS u(line, ordinality)
), frequent AS (
  SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT l.*, f.k IS NOT NULL AS gone FROM lines l LEFT JOIN frequent f ON l.k = f.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
