"""Ranked search over files, evidence and symbols, and resolution of names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

K1, B = 1.2, 0.75


def postings(docs: DataFrame, id_col: str, text_cols: list[str], terms: list[str], *, prefix: bool = False) -> DataFrame:
    """id, term, tf of the wanted terms only, with each document's length; a document is read once and no other word leaves it."""
    tokens = tx.words(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in text_cols]))
    hit = (lambda t: (lambda w: w.startswith(t))) if prefix else (lambda t: (lambda w: w == t))
    found = F.array(*[F.struct(F.lit(t).alias("term"), F.size(F.filter(F.col("_words"), hit(t))).alias("tf")) for t in terms])
    return docs.select(F.col(id_col).alias("id"), tokens.alias("_words")).select("id", F.size("_words").alias("len"), F.inline(found)).select("id", "len", "term", "tf")


def _ranked(listed: DataFrame) -> DataFrame:
    """id, rank of postings (id, len, term, tf), which have a row for every document and term."""
    stats = listed.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.when(F.col("tf") > 0, 1).otherwise(0)).alias("n"), F.avg("len").alias("mean"))
    idf = F.greatest(F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return listed.where("tf > 0").join(F.broadcast(stats), "term").groupBy("id").agg(F.sum(part).alias("rank"))


def bm25(docs: DataFrame, id_col: str, text_cols: list[str], terms: list[str], *, prefix: bool = False, limit: int | None = None) -> DataFrame:
    """id, rank: Okapi scores of documents with any term, best first, ties by id.

    Document frequencies and the mean length are one small aggregate that is broadcast (a row for each term).
    """
    scored = _ranked(postings(docs, id_col, text_cols, terms, prefix=prefix))
    return scored.orderBy(F.desc("rank"), "id").limit(limit) if limit else scored


def phrase_search(docs: DataFrame, id_col: str, text_cols: list[str], query: str) -> DataFrame:
    """id of documents with each quoted word's parts next to each other, for any word of the query."""
    joined = F.concat(F.lit(" "), F.array_join(tx.words(F.concat_ws(" ", *text_cols)), " "), F.lit(" "))
    phrases = phrases_of(query)
    return docs.where(reduce(lambda a, p: a | joined.contains(f" {p} "), phrases, F.lit(False))).select(F.col(id_col).alias("id"))


def phrases_of(query: str) -> list[str]:
    """What evidence search looks for: each word of the query, or its parts next to each other where it has -, _, . or / in it."""
    return [" ".join(p) for t in tx.evidence_terms(query) if (p := "".join(c if c.isascii() and c.isalnum() else " " for c in t).split())]


def phrase_bm25(docs: DataFrame, id_col: str, text_cols: list[str], query: str) -> DataFrame:
    """id, rank: Okapi scores where each of the query's phrases counts as a term, a phrase's places as its frequency."""
    phrases = phrases_of(query)
    tokens = F.transform(tx.words(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in text_cols])), lambda w: w)
    sized = docs.select(F.col(id_col).alias("id"), F.explode(F.array(tokens)).alias("_words"))

    def times(phrase: str):
        want = phrase.split()
        if len(want) == 1:
            return F.size(F.filter(F.col("_words"), lambda w: w == want[0]))
        starts = F.sequence(F.lit(0), F.greatest(F.size("_words") - len(want), F.lit(0)))
        here = lambda i: reduce(lambda a, k: a & F.get(F.col("_words"), i + k).eqNullSafe(F.lit(want[k])), range(1, len(want)), F.get(F.col("_words"), i).eqNullSafe(F.lit(want[0])))
        return F.size(F.filter(starts, here))

    found = F.array(*[F.struct(F.lit(p).alias("term"), times(p).alias("tf")) for p in dict.fromkeys(phrases)])
    return _ranked(sized.select("id", F.size("_words").alias("len"), F.inline(found)))


def like(column, text: str):
    """ILIKE '%text%' where % and _ in the text stay wildcards."""
    return column.ilike("%" + text.replace("\\", "\\\\") + "%")


def find_symbols(symbols: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Symbols whose name, qualified name or docstring holds the query: exact first, then shorter qualified names."""
    q = query.strip()
    name, qualified = F.col("name"), F.col("qualified_name")
    rank = F.when(name == q, 0).when(qualified == q, 1).when(name.ilike(q.replace("\\", "\\\\") + "%"), 2).otherwise(3)
    found = symbols.where((name == q) | (qualified == q) | like(name, q) | like(qualified, q) | like(F.coalesce("docstring", F.lit("")), q)) if q else symbols.limit(0)
    return found.withColumn("rank", rank).orderBy("rank", F.length("qualified_name"), "qualified_name").limit(limit)


def resolve(references: DataFrame, symbols: DataFrame, loose: int = 10) -> DataFrame:
    """references (ref_id, name, source_module) with the qualified_name that each resolves to, or null.

    A name or qualified name that equals it; else, of the `loose` shortest qualified names that end in .name, one. The
    reference's own module first, then the shortest. Symbols are reduced first, to one row for each key and module and
    one for each key, and references to their different (name, module): a popular name costs a row a module, not a row
    for each pair of its uses and definitions.
    """
    row = lambda tier: F.struct(F.lit(tier).alias("tier"), F.length("qualified_name").alias("size"), "qualified_name").alias("best")
    parts = F.split("qualified_name", r"\.")
    # a name or an ending with more parts than any reference meets none; one that is a symbol's own name is met exactly
    most = references.agg(F.max(F.size(F.split("name", r"\."))).alias("_most"))
    keys = F.when(F.size(parts) > F.col("_most"), F.array("name")).otherwise(F.array_distinct(F.array("name", "qualified_name")))
    exact = symbols.join(F.broadcast(most)).select(F.explode(keys).alias("_key"), "module", row(0))
    first = F.greatest(F.lit(2), F.size(parts) - F.col("_most") + 1)
    endings = F.when(F.size(parts) > 1, F.transform(F.sequence(first, F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).otherwise(F.array().cast("array<string>"))
    shortest = Window.partitionBy("_key").orderBy("best")
    ending = symbols.join(F.broadcast(most)).select(F.explode(endings).alias("_key"), "name", "module", row(1))
    ending = ending.where(~F.col("_key").eqNullSafe(F.col("name"))).drop("name").withColumn("_n", F.row_number().over(shortest)).where(F.col("_n") <= loose).drop("_n")
    of_module = exact.unionByName(ending).groupBy("_key", "module").agg(F.min("best").alias("near"))
    of_key = of_module.groupBy("_key").agg(F.min("near").alias("any"))
    wanted = references.select(F.col("name").alias("_name"), F.col("source_module").alias("_module")).distinct()
    # a plain equality of modules would have the second use of of_module leave null ones out, so that it is made twice
    own = (F.col("_name") == F.col("_key")) & F.col("_module").isNotNull() & F.col("_module").eqNullSafe(F.col("module"))
    found = wanted.join(of_key, F.col("_name") == F.col("_key")).drop("_key").join(of_module, own, "left")
    best = F.when(F.col("near.tier") == F.col("any.tier"), F.col("near.qualified_name")).otherwise(F.col("any.qualified_name"))
    found = found.select("_name", "_module", best.alias("qualified_name"))
    return references.join(found, (F.col("name") == F.col("_name")) & F.col("source_module").eqNullSafe(F.col("_module")), "left").select(*references.columns, "qualified_name")


def search_entities(entities: DataFrame, query: str, kinds: list[str] | None = None, limit: int = 20) -> DataFrame:
    match = reduce(lambda a, t: a | F.lower("name").contains(t) | F.lower("summary").contains(t) | F.lower("key").contains(t), tx.evidence_terms(query), F.lit(False))
    found = entities.where(match if tx.evidence_terms(query) else F.lit(True))
    found = found.where(F.col("kind").isin(kinds)) if kinds else found
    return found.orderBy(F.desc("confidence"), F.desc("updated_at"), "key").limit(limit)


def innermost(points: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys, line) with the name of the range (keys, name, line_start, line_end) they lie in, the latest start of several.

    A point lies behind a range's first line and up to its last. Both sides meet by their keys, a file's say.
    """
    r = ranges.select(*[F.col(k).alias(f"_{k}") for k in keys], "name", F.col("line_start").alias("_from"), F.col("line_end").alias("_to"))
    on = reduce(lambda a, k: a & (F.col(k) == F.col(f"_{k}")), keys, (F.col("_from") < F.col("line")) & (F.col("line") <= F.col("_to")))
    met = points.join(r, on, "left")
    return met.groupBy(*points.columns).agg(F.max_by("name", "_from").alias("name"))
