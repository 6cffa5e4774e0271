"""What commits and documents tell about a repository: evidence, entities and relationships, and questions over them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import infer
from ..functions import text as tx
from ..operators import graph, memory, search
from ..operators.lineage import kept
from . import reports

#: Kinds of entities, relationships between them, and what is answered where nothing is found.
REPOSITORY, FILE, MODULE, FEATURE, DEVELOPER, COMMIT = "Repository", "File", "Module", "Feature", "Developer", "Commit"
PULL_REQUEST, DECISION, EVENT, INCIDENT, RELEASE = "PullRequest", "ArchitectureDecision", "RepositoryEvent", "Incident", "Release"
INTRODUCED, MODIFIED, RELATED, CONTRIBUTES = "introduced_by", "modified_by", "related_to", "contributes_to"
HERE = "repository:local"
INFERRED_DECISION = "Related evidence was found, but no explicit architecture decision record. Treat this as inferred context."
NO_DECISION = "No evidence-backed decision was found in indexed memory."
NO_ARCHITECTURE = "No architecture-specific evidence found in indexed memory."
NO_API_FLOW = "No evidence-backed API flow was found in indexed memory."
API_FLOW = "Related API or infrastructure evidence was found; endpoint-level flow extraction is conservative. Use the evidence to guide inspection."
API_WORDS = "api route endpoint producer consumer event kafka database"
#: Confidence of every piece of evidence that is shown.
SHOWN_CONFIDENCE = 0.75


@dataclass
class Memory:
    """evidence: source_type, source_id, path, title, snippet, author, email, ts, files, kind. entities: key, kind, name,
    summary, confidence. relationships: source_key, target_key, relationship, confidence, evidence_type, evidence_id, commit, cochange.
    decided: entities of the kind DECISION; where they are not given, they are looked for among all entities.
    history: the commits that evidence tells of, as build() takes them; where it is not given, evidence has what is asked of it."""

    evidence: DataFrame
    entities: DataFrame
    relationships: DataFrame
    decided: DataFrame | None = None
    history: DataFrame | None = None


def slug(text: Column) -> Column:
    plain = tx.slug(text)
    return F.when(plain != "", plain).otherwise("unknown")


def commit_features(subject: Column, files: Column) -> Column:
    """Feature terms of a subject and of the parts of changed paths, where _ and - part words."""
    paths = F.translate(F.array_join(files, "\n"), "_-", "  ")
    return F.sort_array(F.array_union(infer.feature_terms(subject), infer.feature_terms(paths)))


def document_kind(path: Column, content: Column) -> Column:
    low, text = F.lower(path), F.lower(content)
    return (
        F.when(F.contains(low, F.lit("adr")) | F.contains(text, F.lit("architecture decision")), DECISION)
        .when(F.contains(low, F.lit("release")) | F.contains(low, F.lit("changelog")), RELEASE)
        .when(F.contains(low, F.lit("incident")) | F.contains(text, F.lit("postmortem")), INCIDENT)
        .otherwise(EVENT)
    )


def _read_commits(commits: DataFrame) -> DataFrame:
    subject, files = F.col("subject"), F.col("files")
    components = F.sort_array(F.array_distinct(F.transform(files, infer.component)))
    rows = commits.withColumns({"sha": F.col("sha").cast("string"), "components": components, "features": commit_features(subject, files), "purpose": infer.purpose(subject), "risk": infer.risk_level(subject, files), "impact": infer.architectural_impact(subject, files)})
    who = F.coalesce(F.nullif(F.col("email"), F.lit("")), F.nullif(F.col("author"), F.lit("")), F.lit("unknown"))
    return rows.withColumns({"author_key": F.concat(F.lit("developer:"), slug(who)), "commit_key": F.concat(F.lit("commit:"), "sha"), "pull": infer.pull_request(subject)})


def _read_documents(documents: DataFrame) -> DataFrame:
    path, content = F.col("path"), F.col("content")
    rows = documents.select("path", "content", tx.title(content, path).alias("title"), tx.compact_snippet(content).alias("snippet"), document_kind(path, content).alias("kind"), F.substring(F.sha2(path.cast("binary"), 256), 1, 16).alias("source_id"))
    features = infer.feature_terms(F.concat_ws("\n", "path", "title", "content"))
    return rows.withColumns({"features": features, "entity_key": F.concat(F.lower("kind"), F.lit(":"), "source_id")}).drop("content")


def read(commits: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """commits and documents with what is read out of each, as build() takes them."""
    return _read_commits(commits), _read_documents(documents)


def build(commits: DataFrame, documents: DataFrame, name: str = "repository", *, reading: Callable = lambda c, d: tuple(kept(df) for df in read(c, d))) -> Memory:
    """commits: sha, author, email, ts, subject, files (oldest first by ts, sha). documents: path, content.
    reading: read(), and where its result is kept: entities and relationships read it for each of their rules.

    Every rule is a select over commits or documents; a key that several rows write keeps the last one's values and the
    greatest confidence, and a relationship counts once for each piece of evidence.
    """
    c, d = reading(commits, documents)
    evidence = evidence_of(c, d)
    return Memory(evidence, entities_of(c, d, name), relationships_of(c, d), decision_entities(evidence))


def evidence_of(c: DataFrame, d: DataFrame) -> DataFrame:
    """build()'s evidence of commits and documents as read() gives them."""
    none = lambda kind="string": F.lit(None).cast(kind)
    written = d.select(F.lit("document"), "source_id", "path", "title", "snippet", none(), none(), none(), F.array().cast("array<string>"), "kind", none(), none())
    return commit_evidence(c).union(written)


def commit_evidence(c: DataFrame) -> DataFrame:
    """evidence_of() commits alone."""
    return c.select(F.lit("commit").alias("source_type"), F.col("sha").alias("source_id"), F.lit("").alias("path"), F.col("subject").alias("title"), infer.commit_snippet(F.col("subject"), F.col("files"), F.col("components")).alias("snippet"), "author", "email", "ts", "files", F.lit(COMMIT).alias("kind"), "risk", "impact")


def entities_of(c: DataFrame, d: DataFrame, name: str = "repository") -> DataFrame:
    """build()'s entities of commits and documents as read() gives them."""
    spark = c.sparkSession
    at = lambda n: F.struct(F.col("ts").alias("ts"), F.col("sha").alias("id"), F.lit(n).alias("n"))
    later = lambda n: F.struct(F.lit("~").alias("ts"), F.col("path").alias("id"), F.lit(n).alias("n"))

    def entity(df: DataFrame, kind, key: Column, label: Column, summary: Column, confidence, seq: Column) -> DataFrame:
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        return df.select(key.alias("key"), as_column(kind).alias("kind"), label.alias("name"), summary.alias("summary"), as_column(confidence).cast("double").alias("confidence"), seq.alias("write_seq"))

    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    each = lambda column: c.withColumn("_x", F.explode(column))
    x = F.col("_x")
    subject, purpose = F.col("subject"), F.col("purpose")
    decided = c.where("impact <> 'low'")
    entities = [
        entity(c, DEVELOPER, F.col("author_key"), F.coalesce(F.nullif(F.col("author"), F.lit("")), "email"), text(F.col("author"), " contributed repository changes."), 0.95, at(0)),
        entity(c, COMMIT, F.col("commit_key"), F.substring("sha", 1, 7), purpose, 0.86, at(0)),
        entity(each("components"), MODULE, text("module:", slug(x)), x, text("Repository area inferred from paths touched by commits: ", x, "."), 0.72, at(1)),
        entity(each("files"), FILE, text("file:", x), x, text("File touched by repository history: ", x, "."), 0.9, at(1)),
        entity(each("features"), FEATURE, text("feature:", slug(x)), x, text("Feature/topic inferred from commit text or changed paths: ", x, "."), 0.68, at(1)),
        entity(c.where("pull is not null"), PULL_REQUEST, text("pull_request:", F.col("pull").cast("string")), text("PR #", F.col("pull").cast("string")), text("Pull request inferred from commit message: ", subject), 0.62, at(1)),
        entity(decided, DECISION, text("decision:", F.substring("sha", 1, 12)), subject, text("Architectural signal from commit: ", purpose, ". Impact assessed as ", F.col("impact"), "."), F.when(F.col("impact") == "medium", 0.58).otherwise(0.72), at(1)),
        entity(d, F.col("kind"), F.col("entity_key"), F.col("title"), F.col("snippet"), 0.82, later(0)),
        entity(d.withColumn("_x", F.explode("features")), FEATURE, text("feature:", slug(x)), x, text("Repository topic mentioned in evidence: ", x, "."), 0.62, later(1)),
        spark.createDataFrame([(HERE, REPOSITORY, name, f"Local repository {name}", 1.0)], "key string, kind string, name string, summary string, confidence double").withColumn("write_seq", F.struct(F.lit("").alias("ts"), F.lit("").alias("id"), F.lit(0).alias("n"))),
    ]
    return graph.upsert_entities(reduce(DataFrame.unionByName, entities)).drop("write_seq")


def relationships_of(c: DataFrame, d: DataFrame) -> DataFrame:
    """build()'s relationships of commits and documents as read() gives them."""
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    each = lambda column: c.withColumn("_x", F.explode(column))
    x = F.col("_x")
    subject = F.col("subject")
    decided = c.where("impact <> 'low'")

    def link(df: DataFrame, source: Column, target: Column, kind, confidence: float, *, of=("commit", "sha"), cochange: bool = False) -> DataFrame:
        kind = kind if isinstance(kind, Column) else F.lit(kind)
        return df.select(source.alias("source_key"), target.alias("target_key"), kind.alias("relationship"), F.lit(confidence).alias("confidence"), F.lit(of[0]).alias("evidence_type"), F.col(of[1]).alias("evidence_id"), F.lit(cochange).alias("cochange"))

    author, commit = F.col("author_key"), F.col("commit_key")
    few = F.slice("files", 1, memory.COCHANGE_FILES)
    first = c.select("sha", few.alias("_few"), F.posexplode(few).alias("_i", "_a")).select("sha", "_i", "_a", F.posexplode("_few").alias("_j", "_b")).where("_i <> _j")
    introduces = F.when(infer.is_introductory(subject), INTRODUCED).otherwise(MODIFIED)
    of_document = ("document", "source_id")
    #: between files alone, where no other rule writes: counted apart, so that what asks for them reads nothing else
    together = link(first, text("file:", F.col("_a")), text("file:", F.col("_b")), RELATED, 0.66, cochange=True)
    links = [
        link(c, author, commit, CONTRIBUTES, 0.95),
        link(c, commit, F.lit(HERE), MODIFIED, 0.88),
        link(each("components"), text("module:", slug(x)), author, MODIFIED, 0.74),
        link(each("components"), commit, text("module:", slug(x)), RELATED, 0.76),
        link(each("files"), commit, text("file:", x), RELATED, 0.86),
        link(each("files"), text("file:", x), author, MODIFIED, 0.84),
        link(each("features"), text("feature:", slug(x)), commit, introduces, 0.7),
        link(c.where("pull is not null"), text("pull_request:", F.col("pull").cast("string")), commit, RELATED, 0.62),
        link(decided, text("decision:", F.substring("sha", 1, 12)), commit, INTRODUCED, 0.7),
        link(d, F.col("entity_key"), F.lit(HERE), RELATED, 0.8, of=of_document),
        link(d.withColumn("_x", F.explode("features")), F.col("entity_key"), text("feature:", slug(x)), RELATED, 0.64, of=of_document),
    ]
    once = lambda df, cochange: df.groupBy("source_key", "target_key", "relationship", "evidence_type", "evidence_id").agg(F.max("confidence").alias("confidence")).withColumn("cochange", F.lit(cochange))
    return once(reduce(DataFrame.unionByName, links), False).unionByName(once(together, True))


def commits_of(m: Memory) -> DataFrame:
    """sha, author, ts, files of all commits."""
    if getattr(m, "history", None) is not None:
        return m.history.select(F.col("sha").cast("string").alias("sha"), "author", "ts", "files")
    return m.evidence.where("source_type = 'commit'").select(F.col("source_id").alias("sha"), "author", "ts", "files")


def newest_commits(m: Memory, limit: int) -> DataFrame:
    """Evidence of the newest commits; of a history, it is made of those alone."""
    if getattr(m, "history", None) is None:
        return m.evidence.where("source_type = 'commit'").orderBy(F.desc(F.coalesce("ts", F.lit(""))), F.desc("source_id")).limit(limit)
    rows = m.history.withColumn("sha", F.col("sha").cast("string")).orderBy(F.desc(F.coalesce("ts", F.lit(""))), F.desc("sha")).limit(limit)
    return commit_evidence(_read_commits(rows))


def cochanged(commits: DataFrame) -> DataFrame:
    """sha, a, b, a_component, b_component of files in different components that a commit (sha, files) changed: the pairs
    of relationships' cochange between components, once for each sha, and no pair is shuffled but those of a sha that
    several commits have."""
    files = F.array_distinct(F.slice("files", 1, memory.COCHANGE_FILES))
    placed = F.transform(files, lambda p: F.struct(p.alias("p"), infer.component(p).alias("c")))  # once a file, not once a pair
    rows = commits.select("sha", placed.alias("_few"))
    seen = rows.groupBy("sha").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = kept(seen.select(F.col("sha").alias("_again")))
    same = F.col("sha").eqNullSafe(F.col("_again"))

    def pairs(of: DataFrame) -> DataFrame:
        both = of.select("sha", "_few", F.explode("_few").alias("_a")).select("sha", "_a", F.explode("_few").alias("_b"))
        return both.where("_a.c <> _b.c").select("sha", F.col("_a.p").alias("a"), F.col("_b.p").alias("b"), F.col("_a.c").alias("a_component"), F.col("_b.c").alias("b_component"))

    if not again.limit(1).count():
        return pairs(rows)
    return pairs(rows.join(again, same, "left_anti")).unionByName(pairs(rows.join(again, same, "left_semi")).distinct())


def decision_entities(evidence: DataFrame) -> DataFrame:
    """build()'s entities of the kind DECISION, of evidence alone: no other rule writes their keys."""
    title, impact, source = F.col("title"), F.col("impact"), F.col("source_id")
    entity = lambda df, key, summary, confidence, seq: df.select(key.alias("key"), F.lit(DECISION).alias("kind"), title.alias("name"), summary.alias("summary"), confidence.cast("double").alias("confidence"), F.struct(*seq).alias("write_seq"))
    said = F.concat(F.lit("Architectural signal from commit: "), infer.purpose(title), F.lit(". Impact assessed as "), impact, F.lit("."))
    commits = evidence.where("source_type = 'commit' and impact <> 'low'")
    documents = evidence.where((F.col("source_type") == "document") & (F.col("kind") == DECISION))
    writes = entity(commits, F.concat(F.lit("decision:"), F.substring(source, 1, 12)), said, F.when(impact == "medium", 0.58).otherwise(0.72), [F.col("ts").alias("ts"), source.alias("id"), F.lit(1).alias("n")])
    writes = writes.unionByName(entity(documents, F.concat(F.lower("kind"), F.lit(":"), source), F.col("snippet"), F.lit(0.82), [F.lit("~").alias("ts"), F.col("path").alias("id"), F.lit(0).alias("n")]))
    return graph.upsert_entities(writes).drop("write_seq")


def counts(m: Memory) -> DataFrame:
    """metric, value: entities, relationships, evidence."""
    one = lambda df, name: df.agg(F.lit(name).alias("metric"), F.count(F.lit(1)).alias("value"))
    return one(m.entities, "entities").union(one(m.relationships, "relationships")).union(one(m.evidence, "evidence"))


def evidence_for_source(m: Memory, source_type: str, source_id: str) -> DataFrame:
    return m.evidence.where((F.col("source_type") == source_type) & (F.col("source_id") == source_id)).orderBy(F.desc(F.coalesce("ts", F.lit(""))))


def relationships_for_key(m: Memory, key: str) -> DataFrame:
    """Relationships of a key at either end, most confident first."""
    return m.relationships.where((F.col("source_key") == key) | (F.col("target_key") == key)).orderBy(F.desc("confidence"), "relationship")


def relationship_evidence(m: Memory) -> DataFrame:
    """Relationships with the title, author and time of their evidence."""
    relationships = m.relationships  # first: of what they are made of, evidence is made as well
    e = m.evidence.select(F.col("source_type").alias("evidence_type"), F.col("source_id").alias("evidence_id"), "title", "author", "ts")
    return relationships.join(e, ["evidence_type", "evidence_id"], "left")


def shown(evidence: DataFrame) -> DataFrame:
    """Evidence as it is shown: empty paths are null, the confidence is constant."""
    return evidence.select("source_type", "source_id", "title", "snippet", F.nullif(F.col("path"), F.lit("")).alias("path"), "author", "ts", F.lit(SHOWN_CONFIDENCE).alias("confidence"))


# -- questions --------------------------------------------------------------------


def _found(m: Memory, query: str, limit: int) -> DataFrame:
    """The first evidence for a query with its place, from 1: `limit` rows at most, so one partition ranks them."""
    hits = reports.search_evidence(m.evidence, query, limit)
    place = F.row_number().over(Window.orderBy(F.desc("rank"), F.desc(F.coalesce("ts", F.lit(""))), "source_id"))
    return kept(hits.withColumn("place", place))


def history(m: Memory, topic: str, limit: int = 20) -> DataFrame:
    """date, title, summary, entity_key, entity_kind, confidence of evidence for a topic; the oldest of the 2 * limit best."""
    hits = _found(m, topic, 2 * limit).withColumn("rank", F.col("place"))
    rows = memory.history(hits, limit)
    return rows.select(F.col("ts").alias("date"), "title", F.col("snippet").alias("summary"), F.concat_ws(":", "source_type", "source_id").alias("entity_key"), F.col("kind").alias("entity_kind"), F.round(tx.score_match(topic, F.col("title"), F.col("snippet")), 6).alias("confidence"), "source_type", "source_id", "path")


def ownership(m: Memory, topic: str, limit: int = 10) -> DataFrame:
    """developer, email, score, commits, files, last_active, evidence (first three) from the 200 best pieces of evidence."""
    hits = _found(m, topic, 200).where("source_type = 'commit'").withColumn("author", F.coalesce(F.nullif(F.col("author"), F.lit("")), F.lit("Unknown")))
    listed = hits.groupBy("author").agg(F.count_distinct("source_id").alias("commits"), F.size(F.array_distinct(F.flatten(F.collect_list("files")))).alias("files"), F.max("ts").alias("last_active"), F.max_by("email", F.when(F.col("email").isNotNull(), F.col("place"))).alias("email"), F.slice(F.transform(F.sort_array(F.collect_list(F.struct("place", "source_id"))), lambda s: s["source_id"]), 1, 3).alias("evidence"))
    found = listed.withColumn("score", F.round(F.col("commits") * F.lit(2.0) + F.col("files") * F.lit(0.5), 6))
    return found.select(F.col("author").alias("developer"), "email", "score", "commits", "files", "last_active", "evidence").orderBy(F.desc("score"), "developer").limit(limit)


def _impact(hits: DataFrame) -> Column:
    return infer.architectural_impact(F.col("title"), F.col("files"))


def _else(found: DataFrame, otherwise: DataFrame) -> DataFrame:
    """found, or `otherwise` where it has no rows."""
    empty = found.agg((F.count(F.lit(1)) == 0).alias("_none"))
    return found.unionByName(otherwise.join(F.broadcast(empty)).where("_none").drop("_none"))


def decisions(m: Memory, question: str, limit: int = 5) -> DataFrame:
    """answer, confidence, evidence: decision records; else what evidence suggests; else that there is none."""
    spark = m.evidence.sparkSession
    hits = _found(m, question, 2 * limit)
    related = kept(hits.where((F.col("source_type") == "document") | (_impact(hits) != "low")).orderBy("place").limit(limit * 2))
    first = related.agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("place", "source_id"))), lambda s: s["source_id"]), 1, 3).alias("evidence"))
    decided = getattr(m, "decided", None)
    records = search.search_entities((m.entities if decided is None else decided).withColumn("updated_at", F.lit("")), question, [DECISION], limit)
    answers = kept(records.join(F.broadcast(first)).select(F.col("summary").alias("answer"), "confidence", "evidence"))
    inferred = related.orderBy("place").limit(1).select(F.lit(INFERRED_DECISION).alias("answer"), F.lit(SHOWN_CONFIDENCE).alias("confidence"), F.array("source_id").alias("evidence"))
    nothing = spark.createDataFrame([(NO_DECISION, 0.0, [])], "answer string, confidence double, evidence array<string>")
    return _else(_else(answers, inferred), nothing)


def architecture(m: Memory, topic: str, limit: int = 8) -> DataFrame:
    """summary, confidence, evidence of what speaks of architecture among the 4 * limit best pieces of evidence."""
    hits = _found(m, topic, 4 * limit)
    speaks = F.exists(F.array(*map(F.lit, infer.ARCHITECTURE_TERMS)), lambda t: F.contains(F.lower("snippet"), t))
    rows = hits.where((_impact(hits) != "low") | speaks).orderBy("place").limit(limit).select(F.col("snippet").alias("summary"), F.lit(SHOWN_CONFIDENCE).alias("confidence"), F.col("source_id").alias("evidence"))
    nothing = m.evidence.sparkSession.createDataFrame([(NO_ARCHITECTURE, 0.0, None)], "summary string, confidence double, evidence string")
    return _else(rows, nothing)


def api_flow(m: Memory, query: str, limit: int = 10) -> DataFrame:
    """answer, confidence, evidence for a question about an API."""
    rows = _found(m, f"{query} {API_WORDS}", limit)
    told = rows.agg(F.count(F.lit(1)).alias("_n"), F.transform(F.sort_array(F.collect_list(F.struct("place", "source_id"))), lambda s: s["source_id"]).alias("evidence"))
    any_ = F.col("_n") > 0
    return told.select(F.when(any_, API_FLOW).otherwise(NO_API_FLOW).alias("answer"), F.when(any_, 0.45).otherwise(0.0).alias("confidence"), "evidence")


def related_files(m: Memory, path: str, limit: int = 10) -> DataFrame:
    """related, commits, confidence by relationships, as they are stored: both orders of a pair count, and commits that
    touched the file take places among the 4 * limit most confident first."""
    key = f"file:{path}"
    mine = m.relationships.where((F.col("relationship") == RELATED) & ((F.col("source_key") == key) | (F.col("target_key") == key)))
    some = mine.orderBy(F.desc("confidence"), F.desc("evidence_id"), F.desc("source_key"), F.desc("target_key")).limit(4 * limit).where("cochange")
    other = F.when(F.col("source_key") == key, F.col("target_key")).otherwise(F.col("source_key"))
    found = some.groupBy(F.regexp_replace(other, "^file:", "").alias("related")).agg(F.count(F.lit(1)).alias("commits"))
    return found.withColumn("confidence", F.round(F.least(F.lit(0.95), F.lit(0.45) + F.lit(0.12) * F.col("commits")), 6)).orderBy(F.desc("commits"), "related").limit(limit)


def component_summary(m: Memory, topic: str, limit: int = 8) -> DataFrame:
    """One row: component, summary, commits, authors, files, related of the 100 best pieces of evidence."""
    rows = _found(m, topic, 100)
    low = topic.lower()
    commits = rows.where("source_type = 'commit'")
    touched = commits.select("place", F.posexplode("files").alias("_at", "path")).groupBy("path").agg(F.min(F.struct("place", "_at")).alias("_first"))
    named = touched.where(F.contains(F.lower("path"), F.lit(low)) | F.contains(F.lower(infer.component(F.col("path"))), F.lit(low)))
    in_order = lambda df, n=None: df.agg(F.transform(F.sort_array(F.collect_list(F.struct("_first", "path"))), lambda s: s["path"]).alias("_p")).select((F.slice("_p", 1, n) if n else F.col("_p")).alias("_p"))
    both = in_order(named).withColumnRenamed("_p", "_named").join(F.broadcast(in_order(touched.orderBy("_first").limit(limit))))
    files = kept(both.select(F.when(F.size("_named") > 0, F.col("_named")).otherwise(F.col("_p")).alias("files")))
    authors = commits.groupBy(F.coalesce(F.nullif(F.col("author"), F.lit("")), F.lit("Unknown")).alias("a")).agg(F.min("place").alias("p")).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "a"))), lambda s: s["a"]).alias("authors"))
    sizes = rows.agg(F.sum(F.when(F.col("source_type") == "commit", 1).otherwise(0)).alias("_c"), F.count(F.lit(1)).alias("_e"), F.count_distinct(F.when(F.col("source_type") == "commit", F.col("source_id"))).alias("commits"))
    all_ = files.join(F.broadcast(authors)).join(F.broadcast(sizes)).fillna(0, ["_c"])
    number = lambda c: c.cast("string")
    plain = F.concat(F.lit(f"{topic} appears in "), number(F.col("_c")), F.lit(" indexed commits across "), number(F.size("files")), F.lit(" files with "), number(F.size("authors")), F.lit(" contributors."))
    summary = F.when((F.col("_c") == 0) & (F.col("_e") > 0), F.lit(f"{topic} appears in indexed documentation but not commit evidence.")).when(F.col("_e") == 0, F.lit(f"No indexed memory evidence was found for {topic}.")).otherwise(plain)
    first = [p for r in files.select(F.slice("files", 1, 3).alias("f")).collect() for p in r["f"]]  # three paths at most
    related = [r["related"] for p in first for r in related_files(m, p, 3).collect()][:limit]
    return all_.select(F.lit(topic).alias("component"), summary.alias("summary"), "commits", "authors", F.slice("files", 1, limit).alias("files"), F.array(*map(F.lit, related)).cast("array<string>").alias("related"))


def impact(m: Memory, changed: DataFrame, max_related: int = 5) -> DataFrame:
    """path, status, component, risk, reasons, owners, related, evidence of changed files (path, status): one plan over all.

    Evidence of a file is what its path or its first changed files name, the newest five; its owners are the authors of
    all such commits, three at most by commits and files, or, where there is none, of commits to its component.
    """
    named = m.evidence.select("source_type", "source_id", "author", "ts", "files", F.explode(F.array_union(F.slice("files", 1, 6), F.array(F.nullif(F.col("path"), F.lit(""))))).alias("_path")).where("_path is not null")
    paths = changed.select("path").distinct()
    met = named.join(paths, F.col("_path") == F.col("path")).drop("_path")
    newest = Window.partitionBy("path").orderBy(F.desc(F.coalesce("ts", F.lit(""))), "source_id")
    shown_ = met.withColumn("_n", F.row_number().over(newest)).where("_n <= 5").groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "source_id"))), lambda s: s["source_id"]).alias("evidence"))
    own = _owners(met.where("source_type = 'commit'").select("path", "author", "source_id"), "path")
    touched = m.evidence.where("source_type = 'commit'").select("author", "source_id", F.explode("files").alias("_p")).select("author", "source_id", infer.component(F.col("_p")).alias("component"))
    wide = changed.withColumn("component", infer.component(F.col("path")))
    near = _owners(touched.join(wide.select("component").distinct(), "component", "left_semi").distinct(), "component").withColumnRenamed("owners", "_near")
    pairs = m.relationships.where("cochange").select(F.regexp_replace("source_key", "^file:", "").alias("path"), F.regexp_replace("target_key", "^file:", "").alias("other"))
    counted = pairs.join(paths, "path", "left_semi").groupBy("path", "other").agg(F.count(F.lit(1)).alias("_c"))
    top = Window.partitionBy("path").orderBy(F.desc("_c"), "other")
    related = counted.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= max_related).groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "other"))), lambda s: s["other"]).alias("related"))
    rows = wide.join(shown_, "path", "left").join(own, "path", "left").join(near, "component", "left").join(related, "path", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"evidence": F.coalesce("evidence", none), "owners": F.coalesce("owners", "_near", none), "related": F.coalesce("related", none)})
    risk, reasons = infer.impact_risk(F.col("status"), F.col("path"), F.size("owners"), F.size("related"), F.size("evidence"))
    return rows.select("path", "status", "component", risk.alias("risk"), reasons.alias("reasons"), "owners", "related", "evidence")


def _owners(rows: DataFrame, key: str) -> DataFrame:
    """key and owners: the three authors with most commits, by name among equals."""
    counted = rows.groupBy(key, "author").agg(F.count_distinct("source_id").alias("_c"))
    top = Window.partitionBy(key).orderBy(F.desc("_c"), "author")
    return counted.withColumn("_n", F.row_number().over(top)).where("_n <= 3").groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "author"))), lambda s: s["author"]).alias("owners"))


def impact_summary(found: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files, high, medium, low, risk, baseline_tokens, optimized_tokens, summary of impact() and files (path, size_bytes)."""
    kind = lambda k: F.sum(F.when(F.col("risk") == k, 1).otherwise(0)).alias(k)
    told = F.length(F.to_json(F.struct("path", "risk", "owners", "related", "reasons")))
    sized = found.join(files.select("path", "size_bytes"), "path", "left")
    row = sized.agg(F.count(F.lit(1)).alias("files"), kind("high"), kind("medium"), kind("low"), memory.aggregate_risk(F.col("risk")).alias("risk"), F.ceil(F.coalesce(F.sum("size_bytes"), F.lit(0)) / 4).alias("_b"), F.ceil(F.coalesce(F.sum(told), F.lit(0)) / 4).alias("optimized_tokens"))
    row = row.withColumn("baseline_tokens", F.greatest("_b", "optimized_tokens")).fillna(0, ["high", "medium", "low"])
    saved = F.when(F.col("baseline_tokens") > 0, F.round((1 - F.col("optimized_tokens") / F.col("baseline_tokens")) * 100).cast("int")).otherwise(0)
    text = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    summary = text(F.col("files"), " changed files analyzed: ", F.col("high"), " high, ", F.col("medium"), " medium, ", F.col("low"), " low risk. Estimated context savings: ", saved, "%.")
    return row.drop("_b").withColumn("summary", F.when(F.col("files") > 0, summary).otherwise("No local changes were detected."))


def collected(*parts: DataFrame) -> DataFrame:
    """Evidence of several answers (source_type, source_id, path): each once, at its first place."""
    numbered = [p.select("source_type", "source_id", "path").withColumn("seq", F.struct(F.lit(i).alias("part"), F.monotonically_increasing_id().alias("row"))) for i, p in enumerate(parts)]
    return memory.collect_evidence(reduce(DataFrame.unionByName, numbered).withColumn("shown", F.lit(True))).orderBy("seq").drop("seq", "shown")
