"""Analytics over commits and evidence: ownership, hotspots, co-change, history, impact, related tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import infer

#: Files of a commit that count for co-change: the first of them, as larger commits say little.
COCHANGE_FILES = 30


def hotspots(commit_files: DataFrame, limit: int = 25, *, newest: int | None = None, evidence: int = 0) -> DataFrame:
    """component, commits, authors, files, risk of (sha, author, ts, path, component) rows, riskiest first.

    newest: so many of the newest commits count, all without it; evidence: shas of a component's first rows by time,
    newest first, one a file and so perhaps the same commit again. A commit has one author, so its rows become one a
    component before anything is counted.
    """
    rows = commit_files
    if newest:
        rows = rows.join(rows.select("sha", "ts").distinct().orderBy(F.desc("ts"), "sha").limit(newest).select("sha"), "sha", "left_semi")
    by_author = rows.select("component", "author", "sha").distinct().groupBy("component", "author").agg(F.count(F.lit(1)).alias("n"))
    people = by_author.groupBy("component").agg(F.sum("n").alias("commits"), F.count(F.lit(1)).alias("authors"))
    paths = rows.select("component", "path").distinct().groupBy("component").agg(F.count(F.lit(1)).alias("files"))
    found = people.join(paths, "component").withColumn("risk", F.round(F.col("commits") * F.lit(2.0) + F.col("authors") + F.col("files") * F.lit(0.4), 6))
    if evidence:
        first = Window.partitionBy("component").orderBy(F.desc("ts"), "sha", "path")
        shown = rows.select("component", "ts", "sha", "path").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= evidence)
        shown = shown.groupBy("component").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", F.col("sha").cast("string").alias("sha")))), lambda x: x["sha"]).alias("evidence"))
        found = found.join(shown, "component")
    return found.orderBy(F.desc("risk"), "component").limit(limit)


def ownership(commit_files: DataFrame, limit: int = 10) -> DataFrame:
    """author, commits, files, last_active, score of (sha, author, ts, path) rows, best first. A commit has one author."""
    shas = commit_files.select("author", "sha", "ts").distinct().groupBy("author").agg(F.count_distinct("sha").alias("commits"), F.max("ts").alias("last_active"))
    paths = commit_files.select("author", "path").distinct().groupBy("author").agg(F.count(F.lit(1)).alias("files"))
    found = shas.join(paths, "author")
    found = found.withColumn("score", F.round(F.col("commits") * F.lit(2.0) + F.col("files") * F.lit(0.5), 6))
    return found.select("author", "commits", "files", "last_active", "score").orderBy(F.desc("score"), "author").limit(limit)


def cochange_pairs(commit_files: DataFrame, *, min_commits: int = 2, mode: str = "exact") -> DataFrame:
    """path, other, commits, confidence of paths in the same commits, each pair once (path < other).

    Commits are cut to COCHANGE_FILES paths by the order of paths, so a commit gives at most 435 pairs. mode "compat"
    doubles the counts, as both orders of a pair were once counted.
    """
    first = Window.partitionBy("sha").orderBy("path")
    few = commit_files.select("sha", "path").distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= COCHANGE_FILES).drop("_n")
    together = few.groupBy("sha").agg(F.sort_array(F.collect_list("path")).alias("_paths")).where(F.size("_paths") > 1)
    left = together.select("_paths", F.posexplode("_paths").alias("_i", "path"))
    pairs = left.select("path", F.explode(F.slice("_paths", F.col("_i") + 2, F.lit(COCHANGE_FILES))).alias("other"))
    times = 2 if mode == "compat" else 1
    found = pairs.groupBy("path", "other").agg((F.count(F.lit(1)) * times).alias("commits")).where(F.col("commits") >= min_commits * times)
    return found.withColumn("confidence", F.round(F.least(F.lit(0.95), F.lit(0.45) + F.lit(0.12) * F.col("commits")), 6))


def related_files(pairs: DataFrame, k: int = 5) -> DataFrame:
    """path, other, commits: each path's k most frequent companions."""
    both = pairs.select("path", "other", "commits").union(pairs.select(F.col("other"), F.col("path"), "commits"))
    top = Window.partitionBy("path").orderBy(F.desc("commits"), "other")
    return both.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)


def history(evidence: DataFrame, limit: int) -> DataFrame:
    """Of ranked evidence (rank): the 2*limit first, each source once, the oldest `limit` of them in order of time."""
    first = evidence.orderBy("rank", "source_id").limit(2 * limit)
    once = Window.partitionBy("source_type", "source_id").orderBy("rank")
    kept = first.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    return kept.orderBy(F.coalesce("ts", F.lit("")), "source_id").limit(limit)


def commit_evidence(commits: DataFrame, limit: int) -> DataFrame:
    return commits.orderBy(F.desc("ts"), "sha").limit(limit)


def collect_evidence(evidence: DataFrame) -> DataFrame:
    """Each (source_type, source_id, path) once: the last row's values at the first row's place (seq)."""
    rest = [c for c in evidence.columns if c not in ("source_type", "source_id", "path", "seq")]
    return evidence.groupBy("source_type", "source_id", "path").agg(F.min("seq").alias("seq"), F.max_by(F.struct(*rest), "seq").alias("_row")).select("source_type", "source_id", "path", "seq", "_row.*")


def entities_of_commits(commits: DataFrame, path_features: bool = False) -> DataFrame:
    """key, kind, name, confidence entities that commits (sha, author, subject, files) speak of; each key once.

    With path_features, feature terms come from the parts of changed paths too, not from subjects alone.
    """
    row = lambda kind, name, confidence: F.struct(F.concat(F.lit(f"{kind}:"), name).alias("key"), F.lit(kind).alias("kind"), name.alias("name"), F.lit(confidence).alias("confidence"))
    one = lambda kind, column, confidence: commits.select(row(kind, F.col(column).cast("string"), confidence).alias("e"))
    many = lambda kind, items, confidence: commits.select(F.explode(items).alias("_x")).select(row(kind, F.col("_x"), confidence).alias("e"))
    parts = [
        one("developer", "author", 0.9),
        one("commit", "sha", 0.95),
        many("module", F.array_distinct(F.transform("files", infer.component)), 0.8),
        many("file", F.col("files"), 0.86),
        many("feature", infer.feature_terms(F.col("subject")), 0.62),
        many("pull_request", F.array_compact(F.array(infer.pull_request(F.col("subject")).cast("string"))), 0.78),
    ]
    if path_features:
        words = commits.select(F.explode("files").alias("_p")).distinct().select(F.explode(F.split("_p", "/")).alias("_p")).distinct()
        parts.append(words.select(F.explode(infer.feature_terms(F.translate("_p", "_-", "  "))).alias("_x")).select(row("feature", F.col("_x"), 0.62).alias("e")))
    found = reduce(DataFrame.union, parts).select("e.*")
    return found.groupBy("key").agg(F.first("kind").alias("kind"), F.first("name").alias("name"), F.max("confidence").alias("confidence"))


def related_tests(changed: DataFrame, tests: DataFrame, k: int = 8) -> DataFrame:
    """path, test, score, rank of the k best tests of each changed path; a changed test is its own.

    Tests meet changed paths by a key for each choice of what they share: equal stem or a stem anywhere in the
    test's, component, folder; stems meet as substrings of the distinct test stems. Of each key's tests only the first k by name can be among a path's k best, as all
    before them share as much; so a path meets 11 * k tests at most, however many its component has.
    """
    stem = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"\.[^.]+$", ""), "^test_", ""), "_test$", "")
    folders = lambda p: F.split(p, "/")
    side = lambda df, name: df.select(F.col("path").alias(name), stem(F.col("path")).alias(f"{name}_stem"), infer.component(F.col("path")).alias(f"{name}_component"), F.coalesce(F.get(folders(F.col("path")), F.size(folders(F.col("path"))) - 2), F.lit("")).alias(f"{name}_folder"), folders(F.col("path")).alias(f"{name}_parts"))
    c, t = side(changed.distinct(), "path"), side(tests.distinct(), "test")
    is_test = infer.is_test_for_verification(F.col("path"))
    none = F.lit(None).cast("string")
    shared = lambda df, stems, component, parts: (
        df.withColumn("_s", F.explode(stems))
        .withColumn("_c", F.explode(F.array(none, component)))
        .withColumn("_f", F.explode(F.array_union(F.array(none), parts)))
        .where("_s.how <> 'any' or _c is not null or _f is not null")
        .withColumn("_key", F.struct(F.col("_s.how"), F.col("_s.stem"), F.col("_c").isNotNull(), F.coalesce("_c", F.lit("")), F.col("_f").isNotNull(), F.coalesce("_f", F.lit(""))))
    )
    by = lambda how, value: F.struct(F.lit(how).alias("how"), value.alias("stem"))
    n = F.length("test_stem")
    within = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda size: F.substring(F.col("test_stem"), i, size))))
    wanted = c.where(~is_test & (F.col("path_stem") != "")).select(F.col("path_stem").alias("stem")).distinct()
    held = t.select("test_stem").distinct().where(n > 0).select("test_stem", F.explode(F.array_distinct(within)).alias("stem")).join(wanted, "stem")
    held = held.groupBy("test_stem").agg(F.collect_list("stem").alias("_within"))
    t = t.join(held, "test_stem", "left")
    inside = F.transform(F.coalesce("_within", F.array().cast("array<string>")), lambda s: by("in", s))
    stems_t = F.concat(F.array(by("any", F.lit("")), by("is", F.col("test_stem"))), inside)
    first = Window.partitionBy("_key").orderBy("test")
    keys_t = shared(t, stems_t, F.col("test_component"), F.col("test_parts")).select("_key", "test", "test_stem", "test_component", "test_parts").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n")
    stems_c = F.array(by("any", F.lit("")), by("is", F.col("path_stem")), by("in", F.col("path_stem")))
    keys_c = shared(c.where(~is_test), stems_c, F.col("path_component"), F.array("path_folder")).select("_key", *c.columns)
    met = keys_c.join(keys_t, "_key").drop("_key").dropDuplicates(["path", "test"])
    score = (
        F.when(F.col("test_stem") == F.col("path_stem"), 5).otherwise(0)
        + F.when((F.col("path_stem") != "") & F.contains(F.col("test_stem"), F.col("path_stem")), 3).otherwise(0)
        + F.when(F.col("test_component") == F.col("path_component"), 2).otherwise(0)
        + F.when((F.col("path_folder") != "") & F.array_contains("test_parts", F.col("path_folder")), 1).otherwise(0)
    )
    top = Window.partitionBy("path").orderBy(F.desc("score"), "test")
    ranked = met.withColumn("score", score).where("score > 0").withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    own = c.where(is_test).select("path", F.col("path").alias("test"), F.lit(0).alias("score"), F.lit(1).alias("rank"))
    return ranked.select("path", "test", "score", "rank").union(own)


def aggregate_risk(risk: Column) -> Column:
    """The highest of high, medium, low, none."""
    rank = F.max(F.when(risk == "high", 3).when(risk == "medium", 2).when(risk == "low", 1).otherwise(0))
    return F.element_at(F.array(*map(F.lit, ["none", "low", "medium", "high"])), rank + 1)
