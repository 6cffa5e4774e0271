"""Reports over commits, evidence and an index: decisions, impact, verification, packs of context."""

from __future__ import annotations

import json
from functools import reduce
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import infer
from ..functions import text as tx
from ..operators import memory, search

NO_DECISION = "No evidence-backed decision found."


def decisions(evidence: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """source_id, title, confidence of decision documents and of commits that speak of architecture, best matches first.

    evidence has source_type, source_id, path, title, snippet, ts; without a match there is one row that says so.
    """
    decided = (infer.document_kind(F.col("path")) == "decision") | infer.has_any(F.col("title"), infer.HIGH_IMPACT + ["decision", "adr"])
    score = tx.score_match(query, F.col("title"), F.col("snippet"))
    hits = evidence.where(decided).withColumn("confidence", F.round(score, 6)).where(F.col("confidence") > 0.35)
    top = hits.select("source_id", "title", "confidence").orderBy(F.desc("confidence"), "source_id").limit(limit)
    none = evidence.sparkSession.createDataFrame([(None, NO_DECISION, 0.0)], "source_id string, title string, confidence double")
    found = top.select(F.col("source_id").cast("string"), "title", "confidence")
    has = found.agg((F.count(F.lit(1)) == 0).alias("_none"))
    return found.unionByName(none.join(F.broadcast(has)).where("_none").drop("_none"))


def architecture(evidence: DataFrame, limit: int = 20) -> DataFrame:
    """term, mentions, sources: architecture words in titles and snippets, most frequent first."""
    terms = evidence.select("source_id", F.explode(infer.feature_terms(F.concat_ws(" ", "title", "snippet"))).alias("term"))
    found = terms.where(F.col("term").isin(infer.ARCHITECTURE_TERMS)).groupBy("term").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("source_id").alias("sources"))
    return found.orderBy(F.desc("mentions"), "term").limit(limit)


def component_summary(commit_files: DataFrame, topic: str, limit: int = 10) -> DataFrame:
    """commits, authors, files and the first `limit` paths of the files that name the topic."""
    mine = commit_files.where(F.contains(F.lower("path"), F.lit(topic.lower())))
    counts = mine.agg(F.count_distinct("sha").alias("commits"), F.count_distinct("author").alias("authors"), F.count_distinct("path").alias("files"))
    first = mine.select("path").distinct().orderBy("path").limit(limit).agg(F.array_join(F.sort_array(F.collect_list("path")), "|").alias("paths"))
    return counts.join(F.broadcast(first)).withColumn("topic", F.lit(topic))


def commit_graph(commits: DataFrame, commit_files: DataFrame, newest: int = 180, files: int = 20) -> DataFrame:
    """source, target, type, weight: developers to their newest commits, commits to the components of their first files."""
    few = commits.orderBy(F.desc("ts"), "sha").limit(newest)
    authored = few.select(F.concat(F.lit("developer:"), "author").alias("source"), F.concat(F.lit("commit:"), F.col("sha").cast("string")).alias("target"), F.lit("authored").alias("type"), F.lit(1).cast("long").alias("weight"))
    first = Window.partitionBy("sha").orderBy("path")
    touched = commit_files.join(few.select("sha"), "sha", "left_semi").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= files)
    touched = touched.groupBy("sha", "component").agg(F.count(F.lit(1)).alias("weight"))
    return authored.union(touched.select(F.concat(F.lit("commit:"), F.col("sha").cast("string")), F.concat(F.lit("component:"), "component"), F.lit("touched"), "weight"))


def impact_report(changed: DataFrame, commit_files: DataFrame, max_related: int = 5) -> DataFrame:
    """path, status, owner, owners, related, risk, reasons of changed files (path, status): one plan over all of them."""
    seen = commit_files.join(changed.select("path").distinct(), "path", "left_semi")
    per = seen.groupBy("path", "author").agg(F.count_distinct("sha").alias("n"))
    owners = per.groupBy("path").agg(F.count(F.lit(1)).alias("owners"), F.min_by("author", F.struct((-F.col("n")).alias("a"), "author")).alias("owner"))
    shas = seen.select("sha").distinct()
    pairs = memory.cochange_pairs(commit_files.join(shas, "sha", "left_semi"), min_commits=1)
    related = memory.related_files(pairs, max_related).groupBy("path").agg(F.count(F.lit(1)).alias("related"))
    rows = changed.join(owners, "path", "left").join(related, "path", "left").fillna(0, ["owners", "related"])
    risk, reasons = infer.impact_risk(F.col("status"), F.col("path"), F.col("owners"), F.col("related"), F.col("owners"))
    return rows.withColumns({"risk": risk, "reasons": reasons})


def verification_plan(changed: DataFrame, tests: DataFrame) -> DataFrame:
    """path, status, tests, reason of changed files (path, status)."""
    found = memory.related_tests(changed.select("path"), tests).groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "test"))), lambda x: x["test"]).alias("tests"))
    rows = changed.join(found, "path", "left").withColumn("tests", F.coalesce("tests", F.array().cast("array<string>")))
    reason = (
        F.when(F.col("status").startswith("D"), "Deleted file; run related and broader regression tests.")
        .when(infer.is_test_for_verification(F.col("path")), "Changed test file; verify the test still exercises the intended behavior.")
        .when(F.size("tests") > 0, "Related tests matched by component and filename.")
        .otherwise("No direct test match found; use broader commands and inspect callers.")
    )
    return rows.withColumn("reason", reason)


def verification_commands(sources: DataFrame, tests: DataFrame, present: set[str], project: str = "") -> DataFrame:
    """command, reason to check changed sources (path) and the tests (path) chosen for them; `present` are names at the
    repository's top, `project` is the text of its pyproject.toml. Chosen tests are few, so they come to the driver."""
    ending = lambda *ends: reduce(lambda a, e: a | F.col("path").endswith(e), ends, F.lit(False))
    script = (".js", ".jsx", ".ts", ".tsx")
    chosen = [r["path"] for r in tests.select("path").distinct().orderBy("path").collect()]
    python, scripts = [p for p in chosen if p.endswith(".py")], [p for p in chosen if p.endswith(script)]
    held = sources.agg(F.max(ending(".py")).alias("python"), F.max(ending(*script)).alias("script")).first()
    told = []
    if python:
        told.append(("python -m pytest " + " ".join(python), "Targeted Python tests related to changed files."))
    elif held["python"] and "tests" in present:
        told.append(("python -m unittest discover", "Broad Python test fallback because no exact test file matched."))
    if scripts:
        told.append(("npm test -- " + " ".join(scripts), "Targeted JavaScript/TypeScript tests related to changed files."))
    elif held["script"] and "package.json" in present:
        told.append(("npm test", "JavaScript/TypeScript project test fallback."))
    if "ruff" in project:
        told.append(("python -m ruff check .", "Configured Python lint check."))
    if "package.json" in present:
        told.append(("npm run lint", "Common JavaScript/TypeScript lint check."))
    told = told or [("update the index", "Refresh the index and inspect diagnostics.")]
    return sources.sparkSession.createDataFrame(told, "command string, reason string")


EVIDENCE_TEXT = ["title", "snippet", "path"]


def evidence_holding(evidence: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """evidence that holds a word of the query anywhere, within longer words too, newest first; rank is 0."""
    text = F.lower(F.concat_ws("\n", *EVIDENCE_TEXT))
    held = reduce(lambda a, t: a | F.contains(text, F.lit(t)), tx.evidence_terms(query), F.lit(False))
    return evidence.where(held).withColumn("rank", F.lit(0.0)).orderBy(F.desc("ts"), "source_id").limit(limit)


def search_evidence(evidence: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """evidence with rank: Okapi order, then newest; rows that only hold a word within another where no whole word matches."""
    terms = tx.evidence_terms(query)
    if not terms:
        return evidence.limit(0).withColumn("rank", F.lit(0.0))
    ranked = search.phrase_bm25(evidence, "source_id", EVIDENCE_TEXT, query) if search.phrases_of(query) else evidence.select(F.col("source_id").alias("id"), F.lit(0.0).alias("rank")).limit(0)
    # ranked by keys and times alone, then the texts of the few that are shown: a common word's hits would shuffle them all
    best = evidence.select("source_id", "ts").join(ranked, F.col("source_id") == F.col("id")).orderBy(F.desc("rank"), F.desc("ts"), "source_id").limit(limit)
    hits = evidence.join(F.broadcast(best.select("id", "rank").distinct()), F.col("source_id") == F.col("id")).drop("id")
    none = ranked.agg((F.count(F.lit(1)) == 0).alias("_none"))
    anywhere = evidence_holding(evidence, query, limit).join(F.broadcast(none)).where("_none").drop("_none")
    return hits.unionByName(anywhere).orderBy(F.desc("rank"), F.desc("ts"), "source_id").limit(limit)


def render(parts: dict[str, DataFrame], how: str = "markdown", rows: int = 50) -> str:
    """A pack of named parts, at most `rows` rows of each, as markdown, json or xml: for reading, so it is made on the driver."""
    taken = {name: [r.asDict(recursive=True) for r in df.limit(rows).collect()] for name, df in parts.items()}
    if how == "json":
        return json.dumps(taken, default=str, indent=1)
    if how == "xml":
        body = "".join(f"<part name={json.dumps(n)}>" + "".join("<row>" + "".join(f"<{k}>{escape(str(v))}</{k}>" for k, v in r.items()) + "</row>" for r in rs) + "</part>" for n, rs in taken.items())
        return f"<pack>{body}</pack>"
    out = []
    for name, rs in taken.items():
        out.append(f"## {name}")
        out += ["- " + "; ".join(f"{k}: {v}" for k, v in r.items() if v is not None) for r in rs] or ["(none)"]
    return "\n".join(out)
