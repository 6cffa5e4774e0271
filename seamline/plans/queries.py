"""One query for each operator over the driver's tables, and the same result as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import infer
from ..functions import text as tx
from ..operators import compare, components, graph, memory, rank, rules, search
from . import adapters as ad
from . import reports
from .registry import query

# -- memory -------------------------------------------------------------------


@query("SELECT component, count(DISTINCT sha)::BIGINT AS commits, count(DISTINCT author)::BIGINT AS authors, count(DISTINCT path)::BIGINT AS files, round(2.0::DOUBLE * count(DISTINCT sha) + count(DISTINCT author) + 0.4::DOUBLE * count(DISTINCT path), 6) AS risk FROM commit_files GROUP BY component ORDER BY risk DESC, component LIMIT 25")
def hotspots(spark, sf_dir):
    return memory.hotspots(ad.commit_files(spark, sf_dir))


@query("SELECT author, count(DISTINCT sha)::BIGINT AS commits, count(DISTINCT path)::BIGINT AS files, max(ts) AS last_active, round(2.0::DOUBLE * count(DISTINCT sha) + 0.5::DOUBLE * count(DISTINCT path), 6) AS score FROM commit_files GROUP BY author ORDER BY score DESC, author LIMIT 10")
def ownership(spark, sf_dir):
    return memory.ownership(ad.commit_files(spark, sf_dir))


@query("SELECT author, count(DISTINCT sha)::BIGINT AS commits, count(DISTINCT path)::BIGINT AS files, max(ts) AS last_active, round(2.0::DOUBLE * count(DISTINCT sha) + 0.5::DOUBLE * count(DISTINCT path), 6) AS score FROM commit_files WHERE component = 'brand3' GROUP BY author ORDER BY score DESC, author LIMIT 10")
def ownership_of_component(spark, sf_dir):
    return memory.ownership(ad.commit_files(spark, sf_dir).where("component = 'brand3'"))


COCHANGE = """+few AS (
  SELECT sha, path FROM (SELECT sha, path, row_number() OVER (PARTITION BY sha ORDER BY path) AS n FROM (SELECT DISTINCT sha, path FROM commit_files)) WHERE n <= 30
), pairs AS (
  SELECT a.path, b.path AS other, count(*)::BIGINT AS commits FROM few a JOIN few b ON a.sha = b.sha AND a.path < b.path GROUP BY ALL HAVING count(*) >= 2
)"""


@query(COCHANGE + " SELECT path, other, commits, round(least(0.95::DOUBLE, 0.45::DOUBLE + 0.12::DOUBLE * commits), 6) AS confidence FROM pairs")
def cochange_pairs(spark, sf_dir):
    return memory.cochange_pairs(ad.commit_files(spark, sf_dir))


@query(COCHANGE + " SELECT path, other, 2 * commits AS commits, round(least(0.95::DOUBLE, 0.45::DOUBLE + 0.24::DOUBLE * commits), 6) AS confidence FROM pairs")
def cochange_compat(spark, sf_dir):
    return memory.cochange_pairs(ad.commit_files(spark, sf_dir), mode="compat")


@query(COCHANGE + """, both_ AS (SELECT path, other, commits FROM pairs UNION ALL SELECT other, path, commits FROM pairs)
SELECT path, other, commits, rank FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY commits DESC, other)::INTEGER AS rank FROM both_) WHERE rank <= 5""")
def related_files(spark, sf_dir):
    return memory.related_files(memory.cochange_pairs(ad.commit_files(spark, sf_dir)))


@query("""+t AS (SELECT DISTINCT path FROM files WHERE regexp_matches(path, '_test[.]py$')), c AS (
  SELECT path, regexp_replace(regexp_extract(path, '([^/]*)[.][^./]*$', 1), '_test$', '') AS stem, split_part(path, '/', 2) AS comp, split_part(path, '/', 3) AS folder FROM files
  WHERE NOT regexp_matches(path, '_test[.]py$')
), u AS (SELECT path AS test, regexp_replace(regexp_extract(path, '([^/]*)[.][^./]*$', 1), '_test$', '') AS tstem, split_part(path, '/', 2) AS tcomp, string_split(path, '/') AS parts FROM t
), s AS (
  SELECT path, test, (CASE WHEN tstem = stem THEN 5 ELSE 0 END + CASE WHEN contains(tstem, stem) THEN 3 ELSE 0 END + CASE WHEN tcomp = comp THEN 2 ELSE 0 END + CASE WHEN list_contains(parts, folder) THEN 1 ELSE 0 END)::INTEGER AS score FROM c, u
), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, test)::INTEGER AS rank FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 8""")
def related_tests(spark, sf_dir):
    files = ad.files(spark, sf_dir)
    is_test = infer.is_test_for_verification(F.col("path"))
    return memory.related_tests(files.where(~is_test).select("path"), files.where(is_test).select("path"))


@query("""+e AS (SELECT 'commit' AS source_type, sha AS source_id, ts, subject AS title, row_number() OVER (ORDER BY sha) AS rank FROM commits WHERE contains(lower(subject), 'cache')), f AS (SELECT * FROM e ORDER BY rank LIMIT 40)
SELECT source_type, source_id, ts, title FROM f ORDER BY ts, source_id LIMIT 20""")
def history_timeline(spark, sf_dir):
    found = ad.commits(spark, sf_dir).where(F.lower("subject").contains("cache"))
    evidence = found.select(F.lit("commit").alias("source_type"), F.col("sha").alias("source_id"), "ts", F.col("subject").alias("title"), F.col("sha").alias("rank"))
    return memory.history(evidence, 20).drop("rank")


@query("SELECT sha, author, ts, subject FROM commits ORDER BY ts DESC, sha LIMIT 50")
def recent_commits(spark, sf_dir):
    return memory.commit_evidence(ad.commits(spark, sf_dir), 50)


def features_sql(sources: str) -> str:
    """found (id, term): feature terms of texts (id, t), which `sources` defines."""
    terms = ad._list(infer.ARCHITECTURE_TERMS)
    return f"""+terms AS (SELECT unnest({terms}) AS term), {sources}, found AS (
  SELECT id, term FROM texts, terms WHERE contains(lower(t), term)
  UNION SELECT id, replace(w, '_', ' ') FROM (SELECT id, unnest(regexp_extract_all(lower(t), '[a-z][a-z0-9_]{{3,}}')) AS w FROM texts)
  WHERE w NOT IN ({ad._list(infer.PLAIN_WORDS)[1:-1]}) AND (ends_with(w, 'ing') OR ends_with(w, 'tion') OR list_contains({terms}, w))
)"""


PATH_WORDS = """changed AS (SELECT DISTINCT path FROM commit_files), pieces AS (
  SELECT path, unnest(string_split(path, '/')) AS p FROM changed
)"""


@query(features_sql(PATH_WORDS + ", texts AS (SELECT 0 AS id, subject AS t FROM commits UNION SELECT 0, translate(p, '_-', '  ') FROM pieces)") + """, e AS (
  SELECT 'developer' AS kind, author AS name, 0.9::DOUBLE AS confidence FROM commits UNION SELECT 'commit', sha::VARCHAR, 0.95::DOUBLE FROM commits
  UNION SELECT 'module', component, 0.8::DOUBLE FROM commit_files UNION SELECT 'file', path, 0.86::DOUBLE FROM commit_files
  UNION SELECT 'pull_request', sha::VARCHAR, 0.78::DOUBLE FROM commits UNION SELECT 'feature', term, 0.62::DOUBLE FROM found
) SELECT kind || ':' || name AS key, kind, name, confidence FROM e""")
def commit_entities(spark, sf_dir):
    files = ad.commit_files(spark, sf_dir).groupBy("sha").agg(F.collect_list("path").alias("files"))
    commits = ad.commits(spark, sf_dir).join(files, "sha", "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))
    return memory.entities_of_commits(commits, path_features=True)


RISK = """+f AS (SELECT sha, count(*) AS n, string_agg(path, ' ' ORDER BY path) AS paths FROM commit_files GROUP BY sha), t AS (
  SELECT c.sha, c.subject, lower(c.subject || ' ' || coalesce(f.paths, '')) AS x, coalesce(f.n, 0) AS n FROM commits c LEFT JOIN f ON f.sha = c.sha
) """


@query(RISK + "SELECT sha, CASE WHEN regexp_matches(x, 'auth|security|payment|migration|database|schema|infra') OR n >= 12 THEN 'high' WHEN n >= 5 OR regexp_matches(x, 'retry|cache|api|service') THEN 'medium' ELSE 'low' END AS risk, CASE WHEN regexp_matches(x, 'microservice|kafka|redis|database|terraform|kubernetes|migration') THEN 'high' WHEN regexp_matches(x, 'cache|queue|api|gateway|service|architecture|jwt|auth') THEN 'medium' ELSE 'low' END AS impact FROM t")
def commit_risk(spark, sf_dir):
    files = ad.commit_files(spark, sf_dir).groupBy("sha").agg(F.sort_array(F.collect_list("path")).alias("files"))
    rows = ad.commits(spark, sf_dir).join(files, "sha", "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))
    return rows.select("sha", infer.risk_level(F.col("subject"), F.col("files")).alias("risk"), infer.architectural_impact(F.col("subject"), F.col("files")).alias("impact"))


@query("""+v AS (SELECT sha, subject, lower(split_part(subject, ' ', 1)) AS verb, substr(subject, strpos(subject, ' ') + 1) AS rest FROM commits)
SELECT sha, CASE verb WHEN 'add' THEN 'Added ' || rest WHEN 'fix' THEN 'Fixed ' || rest WHEN 'refactor' THEN 'Refactored ' || rest WHEN 'remove' THEN 'Removed ' || rest WHEN 'update' THEN 'Updated ' || rest WHEN 'migrate' THEN 'Migrated ' || rest WHEN 'introduce' THEN 'Introduced ' || rest ELSE subject END AS purpose,
  CASE WHEN contains(lower(subject), 'timeout') THEN 'Likely response to timeout or reliability failures.' WHEN contains(lower(subject), 'retry') THEN 'Likely added to improve resilience after transient failures.'
       WHEN contains(lower(subject), 'fix') THEN 'Likely motivated by incorrect behavior or failing tests.' WHEN contains(lower(subject), 'auth') THEN 'Likely related to authentication or authorization behavior.'
       WHEN contains(lower(subject), 'cache') THEN 'Likely motivated by repeated work, latency, or load reduction.' ELSE 'Motivation not explicit in indexed evidence.' END AS motivation,
  regexp_matches(lower(subject), '^(add|added|introduce|introduced) ') AS introductory, regexp_extract(subject, '[(]#([0-9]+)[)]', 1)::INTEGER AS pull_request FROM v""")
def commit_inference(spark, sf_dir):
    s = F.col("subject")
    return ad.commits(spark, sf_dir).select("sha", infer.purpose(s).alias("purpose"), infer.motivation(s).alias("motivation"), infer.is_introductory(s).alias("introductory"), infer.pull_request(s).alias("pull_request"))


@query(COCHANGE + """, n AS (SELECT path, count(*) AS related FROM (SELECT path FROM pairs UNION ALL SELECT other FROM pairs) GROUP BY path), o AS (SELECT path, count(DISTINCT author) AS owners FROM commit_files GROUP BY path), s AS (
  SELECT f.path, f.file_id, CASE f.file_id % 4 WHEN 0 THEN 'D' WHEN 1 THEN 'R100' WHEN 2 THEN 'A' ELSE 'M' END AS status, coalesce(n.related, 0) AS related, coalesce(o.owners, 0) AS owners FROM files f LEFT JOIN n ON n.path = f.path LEFT JOIN o ON o.path = f.path
), r AS (SELECT path, status, CASE status WHEN 'D' THEN 3 WHEN 'R100' THEN 2 WHEN 'A' THEN 1 ELSE 0 END + CASE WHEN owners > 0 THEN 1 ELSE 2 END + least(3, related) + CASE WHEN owners > 0 THEN 1 ELSE 0 END AS score FROM s)
SELECT path, status, CASE WHEN score >= 6 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS risk FROM r""")
def impact_risk(spark, sf_dir):
    cf = ad.commit_files(spark, sf_dir)
    related = memory.related_files(memory.cochange_pairs(cf), 3).groupBy("path").agg(F.count(F.lit(1)).alias("related"))
    owners = cf.groupBy("path").agg(F.count_distinct("author").alias("owners"))
    key = F.col("file_id") % 4
    status = F.when(key == 0, "D").when(key == 1, "R100").when(key == 2, "A").otherwise("M")
    rows = ad.files(spark, sf_dir).join(related, "path", "left").join(owners, "path", "left").fillna(0, ["related", "owners"]).withColumn("status", status)
    risk, _ = infer.impact_risk(F.col("status"), F.col("path"), F.col("owners"), F.col("related"), F.col("owners"))
    return rows.select("path", "status", risk.alias("risk"))


# -- text ---------------------------------------------------------------------



def rules_sql(rows: str) -> str:
    """found (path, line_number, rule, severity) of `rows` (path, line, line_number, languages): the rules of operators/rules.py."""
    secret = rules.RULES[0].pattern.replace("'", "''")
    return rf"""+l AS ({rows}), hit AS (
  SELECT *, lower(regexp_extract(line, '{secret}', 1)) AS name, trim(regexp_extract(line, '{secret}', 2)) AS value, regexp_extract(lower(path), '[^/]*$') AS base FROM l WHERE regexp_matches(line, '{secret}')
), found AS (
  SELECT path, line_number, 'possible-secret' AS rule, 'high' AS severity FROM hit WHERE NOT regexp_matches(value, '^[A-Z][A-Z0-9_]{{7,}}$') AND lower(value) NOT IN ({ad._list(rules.HARMLESS_VALUES)[1:-1]}) AND NOT (contains(name, lower(value)) AND NOT regexp_matches(name, 'api|secret|token'))
    AND NOT ((regexp_matches(lower(path), '/tests?/') OR starts_with(base, 'test_') OR contains(base, '.test.')) AND regexp_matches(lower(value), '{"|".join(rules.TEST_VALUES)}'))
  UNION ALL SELECT path, line_number, 'python-requests-without-timeout', 'medium' FROM l WHERE list_contains(languages, 'python') AND regexp_matches(line, '\brequests\.(get|post|put|patch|delete|request)\s*\(') AND NOT regexp_matches(line, 'timeout\s*=')
  UNION ALL SELECT path, line_number, 'shell-true', 'high' FROM l WHERE list_contains(languages, 'python') AND regexp_matches(line, '\bsubprocess\.[A-Za-z_]+\([^#]*shell\s*=\s*True')
  UNION ALL SELECT path, line_number, 'dynamic-code-execution', 'high' FROM l WHERE regexp_matches(line, '\b(eval|exec)\s*\(')
  UNION ALL SELECT path, line_number, 'sql-string-interpolation', 'high' FROM l WHERE regexp_matches(line, '\bexecute(?:Query)?\s*\(\s*(?:f[''"]|`|\w+\s*\+)')
  UNION ALL SELECT path, line_number, 'fetch-without-abort', 'low' FROM l WHERE list_contains(languages, 'javascript') AND regexp_matches(line, '\bfetch\s*\(') AND NOT regexp_matches(line, 'signal')
)"""


BM25 = """+w AS (SELECT doc_id, regexp_extract_all(lower(content), '([a-z0-9]+)') AS ws FROM docs), p AS (
  SELECT doc_id, len(ws) AS len, t.term, len(list_filter(ws, lambda x: {match})) AS tf FROM w, (SELECT unnest({terms}) AS term) t
), s AS (SELECT term, count(*) AS docs, count(*) FILTER (WHERE tf > 0) AS n, avg(len) AS mean FROM p GROUP BY term
), r AS (
  SELECT p.doc_id AS id, round(sum(greatest(ln((s.docs - s.n + 0.5::DOUBLE) / (s.n + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS rank
  FROM p JOIN s ON p.term = s.term WHERE tf > 0 GROUP BY ALL
) SELECT id, rank FROM r ORDER BY rank DESC, id LIMIT 100"""


@query(BM25.format(match="x = t.term", terms="['password', 'token', 'licensed']"))
def bm25_search(spark, sf_dir):
    found = search.bm25(ad.documents(spark, sf_dir), "doc_id", ["content"], ["password", "token", "licensed"])
    return found.withColumn("rank", F.round("rank", 6)).orderBy(F.desc("rank"), "id").limit(100)


@query(BM25.format(match="starts_with(x, t.term)", terms="['licens', 'passw']"))
def bm25_prefix_search(spark, sf_dir):
    found = search.bm25(ad.documents(spark, sf_dir), "doc_id", ["content"], ["licens", "passw"], prefix=True)
    return found.withColumn("rank", F.round("rank", 6)).orderBy(F.desc("rank"), "id").limit(100)


@query("SELECT doc_id AS id FROM docs WHERE contains(' ' || array_to_string(regexp_extract_all(lower(content), '([a-z0-9]+)'), ' ') || ' ', ' under cc ') OR contains(' ' || array_to_string(regexp_extract_all(lower(content), '([a-z0-9]+)'), ' ') || ' ', ' by nc ')")
def phrase_search(spark, sf_dir):
    return search.phrase_search(ad.documents(spark, sf_dir), "doc_id", ["content"], "under.cc BY-NC")


@query("SELECT doc_id, CASE WHEN length(content) > 0 THEN ceil(length(content) / 4.0)::INTEGER ELSE 0 END AS tokens, (length(content) - length(replace(content, chr(10), '')) + CASE WHEN length(content) > 0 AND NOT ends_with(content, chr(10)) THEN 1 ELSE 0 END)::INTEGER AS lines, sha256(content) AS sha256 FROM docs")
def file_scan(spark, sf_dir):
    c = F.col("content")
    return ad.documents(spark, sf_dir).select("doc_id", tx.estimate_tokens(c).alias("tokens"), tx.line_count(c).alias("lines"), F.sha2(c.cast("binary"), 256).alias("sha256"))


@query("""+l AS (SELECT doc_id, path, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM docs), t AS (SELECT *, ls[1] AS f, array_to_string(ls, ' ') AS j FROM l)
SELECT doc_id, CASE WHEN f IS NULL THEN path WHEN starts_with(f, '#') THEN CASE WHEN trim(regexp_replace(f, '^#+', '')) <> '' THEN trim(regexp_replace(f, '^#+', '')) ELSE path END ELSE substr(f, 1, 120) END AS title,
  CASE WHEN length(j) <= 700 THEN j ELSE rtrim(substr(j, 1, 700)) || '...' END AS snippet FROM t""")
def document_summary(spark, sf_dir):
    c = F.col("content")
    return ad.documents(spark, sf_dir).select("doc_id", tx.title(c, F.col("path")).alias("title"), tx.compact_snippet(c).alias("snippet"))


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(content, '(?i)([A-Za-z0-9_]*(?:api[_-]?key|secret|token|password)[A-Za-z0-9_]*)(\b\s*[:=]\s*[''"])[^''"]+([''"])', '\1\2[REDACTED]\3', 'g'), '(?i)(bearer\s+)[A-Za-z0-9._~+/=-]{12,}', '\1[REDACTED]', 'g')) AS redacted FROM docs""")
def secret_redaction(spark, sf_dir):
    return ad.documents(spark, sf_dir).select("doc_id", F.sha2(tx.redact(F.col("content")).cast("binary"), 256).alias("redacted"))


@query(rules_sql("SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INTEGER AS line_number, ['python', 'javascript'] AS languages FROM docs") + " SELECT DISTINCT path, line_number, rule, severity FROM found")
def rule_findings(spark, sf_dir):
    # documents say no programming language: the rules of both are tried
    languages = F.explode(F.array(F.lit("python"), F.lit("javascript")))
    files = ad.documents(spark, sf_dir).withColumn("language", languages)
    return rules.findings(files).select("path", "line_number", "rule", "severity").distinct()


@query("""+l AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INTEGER AS n FROM docs), h AS (
  SELECT doc_id, n, CASE WHEN contains(lower(line), 'password') THEN 1 ELSE 0 END + CASE WHEN contains(lower(line), 'token') THEN 1 ELSE 0 END + CASE WHEN contains(lower(line), 'license') THEN 1 ELSE 0 END AS hits FROM l
), b AS (SELECT doc_id AS id, arg_max(n, hits * 1000000 - n) AS best, max(hits) AS hits FROM h WHERE hits > 0 GROUP BY doc_id)
SELECT id, 12 * hits AS score, greatest(best - 6, 1) AS line_start, best + 8 AS line_end FROM b ORDER BY score DESC, id LIMIT 8""")
def text_fallback(spark, sf_dir):
    return rank.text_fallback(ad.documents(spark, sf_dir), "doc_id", "path", "content", ["password", "token", "license"])


@query("SELECT language, count(*)::BIGINT AS files, sum(length(content))::BIGINT AS chars FROM docs GROUP BY language")
def language_counts(spark, sf_dir):
    return ad.documents(spark, sf_dir).groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("content")).alias("chars"))


@query("SELECT path, CASE WHEN regexp_matches(lower(path), 'adr') THEN 'decision' WHEN regexp_matches(lower(path), 'release|changelog') THEN 'release' WHEN regexp_matches(lower(path), 'incident|postmortem') THEN 'incident' ELSE 'event' END AS kind, split_part(path, '/', 2) AS component, replace(regexp_replace(path, '[.][^./]+$', ''), '/', '.') AS module, regexp_matches(lower(path), 'test|spec') AS tested FROM files")
def path_inference(spark, sf_dir):
    p = F.col("path")
    return ad.files(spark, sf_dir).select("path", infer.document_kind(p).alias("kind"), infer.component(p).alias("component"), infer.module_name(p).alias("module"), infer.is_test_for_ranking(p).alias("tested"))


# -- graph --------------------------------------------------------------------


@query("SELECT path, qualified_name, line_start FROM symbols s WHERE kind IN ('FUNCTION', 'METHOD') AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.target_key = 'symbol:' || s.qualified_name AND e.edge_type IN ('CALLS', 'REFERENCES')) AND NOT regexp_matches(lower(name), 'main|handler|route_|describe_|it_|test_|setup|teardown')")
def dead_code(spark, sf_dir):
    return graph.dead_code(ad.symbols(spark, sf_dir), ad.edges(spark, sf_dir)).select("path", "qualified_name", "line_start")


@query("SELECT source_key, target_key, weight FROM edges WHERE edge_type = 'CALLS' AND target_key IN (SELECT 'symbol:' || qualified_name FROM symbols WHERE name = 'red_widget')")
def callers(spark, sf_dir):
    keys = ad.symbols(spark, sf_dir).where("name = 'red_widget'").select(F.concat(F.lit("symbol:"), "qualified_name").alias("key"))
    return graph.callers(ad.edges(spark, sf_dir), keys).select("source_key", "target_key", "weight")


@query("SELECT source_key, target_key, weight FROM edges WHERE edge_type = 'CALLS' AND source_key IN ('module:supplier_1', 'module:supplier_2')")
def callees(spark, sf_dir):
    keys = spark.createDataFrame([("module:supplier_1",), ("module:supplier_2",)], "key string")
    return graph.callees(ad.edges(spark, sf_dir), keys).select("source_key", "target_key", "weight")


@query("""+k AS (SELECT 'symbol:' || qualified_name AS key FROM symbols WHERE name = 'red_widget' UNION SELECT 'module:supplier_1'), r AS (
  SELECT key, edge_type, source_key AS other, 'in' AS way FROM edges JOIN k ON target_key = key UNION ALL SELECT key, edge_type, target_key, 'out' FROM edges JOIN k ON source_key = key)
SELECT key, coalesce(string_agg(DISTINCT other, '|' ORDER BY other) FILTER (WHERE way = 'in' AND edge_type = 'CALLS'), '') AS callers, coalesce(string_agg(DISTINCT other, '|' ORDER BY other) FILTER (WHERE way = 'out' AND edge_type = 'CALLS'), '') AS callees,
  coalesce(string_agg(DISTINCT other, '|' ORDER BY other) FILTER (WHERE way = 'out' AND edge_type = 'INHERITS'), '') AS parents, coalesce(string_agg(DISTINCT other, '|' ORDER BY other) FILTER (WHERE way = 'in' AND edge_type = 'REFERENCES'), '') AS referrers,
  coalesce(string_agg(DISTINCT other, '|' ORDER BY other) FILTER (WHERE way = 'in' AND edge_type = 'IMPORTS'), '') AS importers FROM r GROUP BY key""")
def dependency_explain(spark, sf_dir):
    named = ad.symbols(spark, sf_dir).where("name = 'red_widget'").select(F.concat(F.lit("symbol:"), "qualified_name").alias("key"))
    found = graph.dependencies(ad.edges(spark, sf_dir), named.union(spark.createDataFrame([("module:supplier_1",)], "key string")))
    return found.select("key", *[F.array_join(c, "|").alias(c) for c in ("callers", "callees", "parents", "referrers", "importers")])


BFS = """+u AS (SELECT source_key AS a, target_key AS b FROM edges {where} {back}), t AS (
  SELECT '{seed}' AS key, 0 AS dist UNION SELECT u.b, t.dist + 1 FROM t JOIN u ON u.a = t.key WHERE t.dist < {depth}
) SELECT key, min(dist)::INTEGER AS dist FROM t GROUP BY key"""


@query(BFS.format(where="", back="UNION SELECT target_key, source_key FROM edges", seed="module:supplier_1", depth=2), recursive=True)
def bfs_neighborhood(spark, sf_dir):
    seeds = spark.createDataFrame([("module:supplier_1",)], "key string")
    return graph.traverse(ad.edges(spark, sf_dir), seeds, 2)


@query(BFS.format(where="WHERE edge_type = 'CONTAINS'", back="", seed="module:AFRICA", depth=3), recursive=True)
def directional_trace(spark, sf_dir):
    edges = ad.edges(spark, sf_dir).where("edge_type = 'CONTAINS'")
    return graph.traverse(edges, spark.createDataFrame([("module:AFRICA",)], "key string"), 3, "out")


@query("""+k AS (SELECT target_key AS key FROM edges WHERE source_key = 'module:supplier_1' UNION SELECT source_key FROM edges WHERE target_key = 'module:supplier_1' UNION SELECT 'module:supplier_1')
SELECT source_key, target_key, edge_type, weight FROM edges WHERE source_key IN (SELECT key FROM k) OR target_key IN (SELECT key FROM k)""")
def incident_edges(spark, sf_dir):
    edges = ad.edges(spark, sf_dir)
    reached = graph.traverse(edges, spark.createDataFrame([("module:supplier_1",)], "key string"), 1)
    return graph.incident_edges(edges, reached, 2).select("source_key", "target_key", "edge_type", "weight")


@query("SELECT e.source_key, e.target_key, e.edge_type, s.label AS source_label, t.label AS target_label, t.file_path AS target_path FROM edges e LEFT JOIN nodes s ON s.key = e.source_key LEFT JOIN nodes t ON t.key = e.target_key")
def edge_view(spark, sf_dir):
    return graph.edge_view(ad.edges(spark, sf_dir), ad.nodes(spark, sf_dir)).select("source_key", "target_key", "edge_type", "source_label", "target_label", "target_path")


BONUS = """+x AS (SELECT unnest([source_key, target_key]) AS key, CASE edge_type WHEN 'CALLS' THEN 28 WHEN 'INHERITS' THEN 24 WHEN 'REFERENCES' THEN 20 WHEN 'CONTAINS' THEN 10 WHEN 'IMPORTS' THEN 8 WHEN 'DEFINES' THEN 6 ELSE 4 END::DOUBLE AS b, lower(edge_type) AS t FROM edges), b AS (SELECT key, sum(b) AS bonus, string_agg(DISTINCT t, ', ' ORDER BY t) AS edge_types FROM x GROUP BY key)"""


@query(BONUS + " SELECT * FROM b")
def edge_bonus(spark, sf_dir):
    return graph.edge_bonus(ad.edges(spark, sf_dir))


@query("SELECT key, sum(weight) AS degree, count(*)::BIGINT AS edges FROM (SELECT unnest([source_key, target_key]) AS key, weight FROM edges) GROUP BY key")
def weighted_degree(spark, sf_dir):
    return graph.weighted_degree(ad.edges(spark, sf_dir))


@query("""SELECT 'files' AS metric, count(*)::BIGINT AS value FROM files UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'classes', count(*) FROM symbols WHERE kind = 'CLASS' UNION ALL SELECT 'functions', count(*) FROM symbols WHERE kind = 'FUNCTION'
UNION ALL SELECT 'methods', count(*) FROM symbols WHERE kind = 'METHOD' UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'calls', count(*) FROM edges WHERE edge_type = 'CALLS'""")
def repository_stats(spark, sf_dir):
    return graph.stats(ad.files(spark, sf_dir), ad.symbols(spark, sf_dir), ad.nodes(spark, sf_dir), ad.edges(spark, sf_dir))


@query("SELECT name, qualified_name, (CASE WHEN name = 'widget' THEN 0 WHEN qualified_name = 'widget' THEN 1 WHEN name ILIKE 'widget%' THEN 2 ELSE 3 END)::INTEGER AS rank FROM symbols WHERE name ILIKE '%widget%' OR qualified_name ILIKE '%widget%' ORDER BY rank, length(qualified_name), qualified_name LIMIT 50")
def symbol_search(spark, sf_dir):
    return search.find_symbols(ad.symbols(spark, sf_dir), "widget").select("name", "qualified_name", "rank")


@query("""+refs AS (SELECT symbol_id AS ref_id, name, module AS source_module FROM symbols), m AS (SELECT r.*, s.qualified_name, row_number() OVER (PARTITION BY ref_id ORDER BY s.module = r.source_module DESC, length(s.qualified_name), s.qualified_name) AS n FROM refs r JOIN symbols s ON s.name = r.name)
SELECT ref_id, name, source_module, qualified_name FROM m WHERE n = 1""")
def symbol_resolution(spark, sf_dir):
    s = ad.symbols(spark, sf_dir)
    return search.resolve(s.select(F.col("symbol_id").alias("ref_id"), "name", F.col("module").alias("source_module")), s)


@query("""+w AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_quantity) AS q FROM lineitem) SELECT 'part:' || l_partkey AS key, arg_max(l_returnflag, q) AS type, arg_max(l_suppkey, q) FILTER (WHERE l_quantity > 25) AS symbol_id FROM w GROUP BY l_partkey""")
def node_upsert(spark, sf_dir):
    w = ad.table(spark, sf_dir, "lineitem").withColumn("write_seq", F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity"))
    writes = w.select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("key"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("label"), F.lit("").alias("metadata"), F.lit(None).cast("string").alias("file_path"), F.when(F.col("l_quantity") > 25, F.col("l_suppkey")).alias("symbol_id"), "write_seq")
    return graph.upsert_nodes(writes).select("key", "type", "symbol_id")


@query("SELECT l_suppkey::VARCHAR AS source_key, l_partkey::VARCHAR AS target_key, l_returnflag AS edge_type, arg_min(l_quantity, (l_orderkey * 100 + l_linenumber) * 1000 + l_quantity) AS weight FROM lineitem GROUP BY ALL", canonical=False)
def edge_insert(spark, sf_dir):
    w = ad.table(spark, sf_dir, "lineitem")
    writes = w.select(F.col("l_suppkey").cast("string").alias("source_key"), F.col("l_partkey").cast("string").alias("target_key"), F.col("l_returnflag").alias("edge_type"), F.lit("{}").alias("metadata"), F.col("l_quantity").alias("weight"), F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("write_seq"))
    return graph.insert_edges(writes).select("source_key", "target_key", "edge_type", "weight")


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '^(https?://|/)') THEN 0.78::DOUBLE ELSE 0.52::DOUBLE END AS http_confidence, 'route:external:GET:' || regexp_replace(regexp_extract(url, '^(?:https?://[^/?#]+)?([^?#]*)', 1), '[^A-Za-z0-9_./:-]+', '_', 'g') AS route_key FROM pages""", canonical=False)
def route_extraction(spark, sf_dir):
    return graph.routes(ad.table(spark, sf_dir, "pages"), "url").select("page_id", "http_confidence", "route_key")


@query("""SELECT page_id, h AS target, count(*)::BIGINT AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages) GROUP BY ALL""", canonical=False)
def page_links(spark, sf_dir):
    links = ad.table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return links.groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))


# -- ranking and components ---------------------------------------------------

RANK = BONUS + """, r AS (SELECT s.qualified_name, s.path, s.line_start, CASE WHEN contains(s.name, 'widget') OR contains(s.qualified_name, 'widget') THEN 80 ELSE 0 END + CASE WHEN s.name = 'widget' THEN 100 WHEN contains(s.name, 'widget') THEN 55 WHEN contains(s.qualified_name, 'widget') THEN 40 ELSE 0 END
  + CASE WHEN s.kind = 'METHOD' THEN 6 ELSE 0 END + CASE WHEN contains(s.path, 'widget') THEN 12 ELSE 0 END + coalesce(b.bonus, 0) AS score, s.kind FROM symbols s LEFT JOIN b ON b.key = 'symbol:' || s.qualified_name)"""


@query(RANK + " SELECT qualified_name, score::DOUBLE AS score FROM r ORDER BY score DESC, path, line_start LIMIT 100")
def snippet_rank(spark, sf_dir):
    ranked = rank.rank_snippets(ad.symbols(spark, sf_dir), "widget", graph.edge_bonus(ad.edges(spark, sf_dir)))
    return ranked.orderBy(F.desc("score"), "path", "line_start").limit(100).select("qualified_name", "score")


@query("""+o AS (SELECT component, size_bytes, row_number() OVER (PARTITION BY component ORDER BY path) AS n FROM files), g AS (
  SELECT component, 0::BIGINT AS n, 0::BIGINT AS used, 0::INTEGER AS kept FROM (SELECT DISTINCT component FROM files)
  UNION ALL SELECT g.component, o.n, CASE WHEN g.used + o.size_bytes <= 20000 THEN g.used + o.size_bytes ELSE g.used END, CASE WHEN g.used + o.size_bytes <= 20000 THEN g.kept + 1 ELSE g.kept END FROM g JOIN o ON o.component = g.component AND o.n = g.n + 1
) SELECT component, arg_max(kept, n)::INTEGER AS kept, arg_max(used, n) AS used FROM g GROUP BY component""", recursive=True)
def token_budget(spark, sf_dir):
    return rank.greedy_budget(ad.files(spark, sf_dir), "component", ["path"], "size_bytes", 20000)


@query("""+f AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS folder, size_bytes FROM files), b AS (SELECT coalesce(sum(ceil(size_bytes / 4.0)), 0)::BIGINT AS b FROM f WHERE folder IN ('src/brand3/economy', 'src/brand4/small'))
SELECT greatest(b, 500) AS baseline_tokens, 500::BIGINT AS optimized_tokens, round((1 - 500 / greatest(b, 500)::DOUBLE) * 100, 4) AS savings_percent FROM b""")
def token_report(spark, sf_dir):
    folders = spark.createDataFrame([("src/brand3/economy",), ("src/brand4/small",)], "folder string")
    return rank.token_report(ad.files(spark, sf_dir), folders, 500)


NODES = """+cn AS (SELECT component, count(*)::BIGINT AS files, sum(line_count)::BIGINT AS lines FROM files GROUP BY component), cs AS (SELECT component, count(*)::BIGINT AS symbols, count(*) FILTER (WHERE kind = 'CLASS') AS classes, count(*) FILTER (WHERE kind = 'FUNCTION') AS functions, count(*) FILTER (WHERE kind = 'METHOD') AS methods FROM symbols GROUP BY component),
cc AS (SELECT component, count(*)::BIGINT AS commits, count(DISTINCT author)::BIGINT AS authors FROM commit_files GROUP BY component), comp AS (
  SELECT cn.component, files, lines, symbols, classes, functions, methods, coalesce(commits, 0) AS commits, coalesce(authors, 0) AS authors, 12 + least(30, 3 * files + symbols) AS size FROM cn LEFT JOIN cs USING (component) LEFT JOIN cc USING (component))"""


@query(NODES + " SELECT *, CASE WHEN commits >= 25 OR authors >= 8 THEN 'high' WHEN commits >= 8 OR files >= 8 THEN 'medium' ELSE 'low' END AS risk FROM comp")
def component_graph_nodes(spark, sf_dir):
    return components.component_nodes(ad.files(spark, sf_dir), ad.symbols(spark, sf_dir), ad.commit_files(spark, sf_dir)).drop("is_service")


EDGES = """+cx AS (SELECT l_orderkey, p.component, p.file_id FROM lineitem JOIN files p ON p.file_id = l_partkey), ce AS (
  SELECT a.component AS source, b.component AS target, 'cochange' AS type, count(*)::BIGINT AS weight FROM (SELECT DISTINCT l_orderkey, component FROM cx) a JOIN (SELECT DISTINCT l_orderkey, component FROM cx) b ON a.l_orderkey = b.l_orderkey AND a.component < b.component GROUP BY ALL)"""


def _component_links(spark, sf_dir) -> DataFrame:
    of = ad.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("file_id")).join(ad.files(spark, sf_dir).select("file_id", "component"), "file_id")
    together = of.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("component")).alias("c")).where(F.size("c") > 1)
    left = together.select("l_orderkey", "c", F.posexplode("c").alias("i", "source_component"))
    return left.select("source_component", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("target_component"), F.lit("cochange").alias("edge_type"), F.col("l_orderkey").cast("string").alias("example"))


def _component_edges(spark, sf_dir) -> DataFrame:
    links = _component_links(spark, sf_dir).groupBy("source_component", "target_component", "edge_type").agg(F.count(F.lit(1)).alias("weight"))
    return links.toDF("source", "target", "type", "weight").withColumn("edge_id", F.concat("source", F.lit(">"), "target"))


LISTED = """, cp AS (SELECT DISTINCT l_orderkey, component FROM cx), cl AS (SELECT a.component AS source, b.component AS target, a.l_orderkey::VARCHAR AS example, 'r' || a.l_orderkey % 7 AS reason FROM cp a JOIN cp b ON a.l_orderkey = b.l_orderkey AND a.component < b.component),
ex AS (SELECT source, target, array_to_string(list_sort(list(example ORDER BY example)[1:10]), '|') AS examples, array_to_string(list_sort(list(reason ORDER BY reason)[1:5]), '|') AS reasons FROM cl GROUP BY ALL)"""


@query(EDGES + LISTED + " SELECT source, target, type AS edge_type, weight, examples, reasons FROM ce JOIN ex USING (source, target)")
def component_graph_edges(spark, sf_dir):
    links = _component_links(spark, sf_dir).withColumn("reason", F.concat(F.lit("r"), (F.col("example").cast("long") % 7).cast("string")))
    return components.component_edges(links)


def _component_nodes(spark, sf_dir) -> DataFrame:
    return component_graph_nodes(spark, sf_dir).withColumnRenamed("component", "id")


BUDGET = NODES + ", " + EDGES.removeprefix("+") + ", deg AS (SELECT unnest([source, target]) AS id, weight FROM ce), sc AS (SELECT component AS id, round((coalesce((SELECT sum(weight) FROM deg WHERE deg.id = component), 0) + size * 0.05::DOUBLE + (functions + methods + classes) * 0.2::DOUBLE + files * 0.6::DOUBLE)::DOUBLE, 6) AS score FROM comp)"


@query(BUDGET + " SELECT id, score FROM sc ORDER BY score DESC, id LIMIT 10")
def node_budget(spark, sf_dir):
    return components.budget_by_nodes(_component_nodes(spark, sf_dir), _component_edges(spark, sf_dir), 10).select("id", "score")


@query(BUDGET + """, be AS (SELECT source, target, row_number() OVER (ORDER BY round(weight * 100 + 24 + (a.score + b.score) * 0.05::DOUBLE, 6) DESC, source || '>' || target) AS n FROM ce JOIN sc a ON a.id = source JOIN sc b ON b.id = target
), fold AS (
  SELECT 0::BIGINT AS n, ['brand3'] AS ids UNION ALL SELECT fold.n + 1, CASE WHEN len(list_distinct(list_concat(ids, [source, target]))) <= 10 THEN list_distinct(list_concat(ids, [source, target])) ELSE ids END FROM fold JOIN be ON be.n = fold.n + 1
), k AS (SELECT unnest(arg_max(ids, n)) AS id FROM fold), o AS (SELECT sc.id, CASE WHEN k.id IS NULL THEN 1 ELSE 0 END AS tier, score FROM sc LEFT JOIN k ON k.id = sc.id)
SELECT id FROM o ORDER BY tier, score DESC, id LIMIT 10""", recursive=True)
def node_budget_by_edges(spark, sf_dir):
    return components.budget_by_edges(_component_nodes(spark, sf_dir), _component_edges(spark, sf_dir), 10, ["brand3"])


@query(EDGES + """, n AS (SELECT *, weight % 4 AS e, weight % 6 AS r FROM ce), v AS (SELECT *, 10 + CASE WHEN e > 0 THEN least(55, 25 + e * 6) ELSE 0 END + CASE WHEN r > 0 THEN least(20, r * 4) ELSE 0 END + least(15::DOUBLE, log2(greatest(weight, 1) + 1) * 5) + 5 AS s FROM n),
c AS (SELECT *, floor(greatest(5, least(96, CASE WHEN e = 0 AND r = 0 THEN least(s, 30) ELSE s END)) + 0.5)::INTEGER AS confidence FROM v)
SELECT source, target, confidence, CASE WHEN confidence >= 85 THEN 'strong' WHEN confidence >= 60 THEN 'good' WHEN confidence >= 35 THEN 'partial' ELSE 'sparse' END AS label FROM c""")
def edge_confidence(spark, sf_dir):
    score = infer.edge_confidence(F.col("type"), F.col("weight"), F.col("weight") % 4, F.col("weight") % 6)
    return _component_edges(spark, sf_dir).select("source", "target", score.alias("confidence"), infer.confidence_label(score).alias("label"))


@query("""+be AS (SELECT source_key || '>' || target_key || '>' || edge_type AS edge_id, source_key AS source, target_key AS target, lower(edge_type) AS type, weight, 'owned' AS sc, CASE WHEN regexp_matches(target_key, '_[0-9]*0$') THEN 'tests' ELSE 'owned' END AS tc FROM edges),
bk AS (SELECT *, CASE WHEN tc = 'tests' THEN concat_ws('|', 'out', source, type, tc) END AS key FROM be), bg AS (SELECT key, type, count(*)::BIGINT AS n, sum(weight) AS weight FROM bk WHERE key IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)
SELECT 'bundle' AS kind, 'bundle:' || key AS key, type, n, weight FROM bg UNION ALL SELECT 'edge', edge_id, type, 1, weight FROM bk WHERE key IS NULL OR key NOT IN (SELECT key FROM bg)""")
def edge_bundles(spark, sf_dir):
    e = ad.edges(spark, sf_dir)
    tests = F.when(F.col("target_key").rlike("_[0-9]*0$"), "tests").otherwise("owned")
    edges = e.select(F.concat_ws(">", "source_key", "target_key", "edge_type").alias("edge_id"), F.col("source_key").alias("source"), F.col("target_key").alias("target"), F.lower("edge_type").alias("type"), "weight", F.lit("owned").alias("source_category"), tests.alias("target_category"))
    return components.bundles(edges)


@query(EDGES + " SELECT CASE WHEN source = 'brand3' THEN target ELSE source END AS other, sum(weight)::BIGINT AS weight, count(*)::BIGINT AS edges FROM ce WHERE source = 'brand3' OR target = 'brand3' GROUP BY ALL")
def edge_counterparts(spark, sf_dir):
    return components.counterparts(_component_edges(spark, sf_dir), "brand3")


@query(r"""+c AS (SELECT path, regexp_matches(lower(component || ' ' || path), '(^|[/._-])(generated|dist|build|coverage|node_modules|vendor)($|[/._-])') AS g, regexp_matches(lower(component || ' ' || path), '(^|[/._-])(__tests__|tests?|specs?)($|[/._-])') AS t FROM files)
SELECT path, CASE WHEN g THEN 'generated' WHEN t THEN 'tests' ELSE 'owned' END AS category FROM c""")
def node_categories(spark, sf_dir):
    category = infer.node_category(F.col("component"), F.col("component"), F.col("path"), F.lit("file"), F.array().cast("array<string>"))
    return ad.files(spark, sf_dir).select("path", category.alias("category"))


@query(EDGES + ", k AS (SELECT * FROM ce WHERE weight >= 5 AND source <> 'brand4' AND target <> 'brand4') SELECT source, target, weight FROM k")
def graph_filter(spark, sf_dir):
    nodes = _component_nodes(spark, sf_dir).withColumn("category", F.lit("owned"))
    _, edges = components.filter_graph(nodes, _component_edges(spark, sf_dir), hidden_ids=["brand4"], min_weight=5, connections=["git"])
    return edges.select("source", "target", "weight")


# -- comparison ---------------------------------------------------------------

DIFF = """+base AS (SELECT l_suppkey, l_returnflag, count(*)::BIGINT AS n, sum(l_quantity) AS q FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY ALL), head AS (SELECT l_suppkey, l_returnflag, count(*)::BIGINT AS n, sum(l_quantity) AS q FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' GROUP BY ALL),
d AS (SELECT coalesce(b.l_suppkey, h.l_suppkey) AS l_suppkey, coalesce(b.l_returnflag, h.l_returnflag) AS l_returnflag, CASE WHEN b.n IS NULL THEN 'added' WHEN h.n IS NULL THEN 'removed' WHEN b.n = h.n AND b.q = h.q THEN 'unchanged' ELSE 'changed' END AS change, h.n AS head_n FROM base b FULL JOIN head h ON b.l_suppkey = h.l_suppkey AND b.l_returnflag = h.l_returnflag)"""


def _snapshots(spark, sf_dir) -> DataFrame:
    l = ad.table(spark, sf_dir, "lineitem")  # noqa: E741
    of = lambda df: df.groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    return compare.diff(of(l.where("l_shipdate < timestamp '1998-01-01'")), of(l.where("l_shipdate >= timestamp '1994-01-01'")), ["l_suppkey", "l_returnflag"], ["n", "q"])


@query(DIFF + " SELECT l_suppkey, l_returnflag, change FROM d")
def graph_diff(spark, sf_dir):
    return _snapshots(spark, sf_dir).select("l_suppkey", "l_returnflag", "change")


@query(DIFF + " SELECT change, count(*)::BIGINT AS n FROM d GROUP BY change")
def graph_diff_summary(spark, sf_dir):
    return _snapshots(spark, sf_dir).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT path, CASE file_id % 7 WHEN 0 THEN 'new' WHEN 1 THEN 'deleted' WHEN 2 THEN 'dirty' ELSE 'clean' END AS status FROM files""")
def change_detection(spark, sf_dir):
    key, f = F.col("file_id") % 7, ad.files(spark, sf_dir)
    hashed = lambda salt: f.withColumn("sha256", F.sha2(F.concat("path", salt), 256)).select("path", "sha256", "file_id")
    return compare.changed_files(hashed(F.lit("")).where(key != 0), hashed(F.when(key == 2, "x").otherwise("")).where(key != 1))


@query(NODES + ", " + EDGES.removeprefix("+") + """, ch AS (SELECT source || '>' || target AS edge_id, source, target, weight, CASE WHEN weight % 3 = 0 THEN 'added' WHEN weight % 3 = 1 THEN 'changed' ELSE 'unchanged' END AS change FROM ce),
nc AS (SELECT *, CASE WHEN commits >= 25 OR authors >= 8 THEN 'high' WHEN commits >= 8 OR files >= 8 THEN 'medium' ELSE 'low' END AS risk, CASE files % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' WHEN 2 THEN 'changed' ELSE 'unchanged' END AS change FROM comp), dl AS (SELECT id, count(*) AS links FROM (SELECT unnest([source, target]) AS id FROM ch) GROUP BY id),
r AS (SELECT 'edge' AS kind, edge_id AS item, round((CASE change WHEN 'added' THEN 150 ELSE 120 END + 50 + 40 + weight * 12 + (weight % 5) * 18)::DOUBLE, 6) AS score FROM ch WHERE change <> 'unchanged'
  UNION ALL SELECT 'node', component, round((CASE change WHEN 'added' THEN 160 WHEN 'removed' THEN 150 ELSE 120 END + CASE risk WHEN 'high' THEN 180 WHEN 'medium' THEN 80 ELSE 0 END + coalesce(links, 0) * 18 + files * 12 + size * 0.08::DOUBLE)::DOUBLE, 6) FROM nc LEFT JOIN dl ON dl.id = component WHERE change <> 'unchanged')
SELECT kind, item, score FROM r ORDER BY score DESC, item LIMIT 60""")
def compare_impact(spark, sf_dir):
    change = F.when(F.col("weight") % 3 == 0, "added").when(F.col("weight") % 3 == 1, "changed").otherwise("unchanged")
    edges = _component_edges(spark, sf_dir).withColumns({"change": change, "examples": F.col("weight") % 5})
    key = F.col("files") % 4
    nodes = _component_nodes(spark, sf_dir).withColumn("change", F.when(key == 0, "added").when(key == 1, "removed").when(key == 2, "changed").otherwise("unchanged"))
    return compare.impact_queue(nodes, edges, 60)


@query(EDGES + """, ch AS (SELECT source || '>' || target AS edge_id, weight, CASE WHEN weight % 3 = 0 THEN 3 WHEN weight % 3 = 1 THEN 2 ELSE 0 END AS change_rank FROM ce) SELECT edge_id, weight, change_rank::INTEGER AS change_rank FROM ch ORDER BY change_rank DESC, weight DESC, edge_id LIMIT 10""")
def top_connections(spark, sf_dir):
    change = F.when(F.col("weight") % 3 == 0, "added").when(F.col("weight") % 3 == 1, "changed").otherwise("unchanged")
    return components.top_connections(_component_edges(spark, sf_dir).withColumn("change", change)).select("edge_id", "weight", "change_rank")


# -- reports and streams ------------------------------------------------------


@query("""+few AS (SELECT * FROM commits ORDER BY ts DESC, sha LIMIT 180), t AS (SELECT f.sha, f.component, row_number() OVER (PARTITION BY f.sha ORDER BY path) AS n FROM commit_files f WHERE f.sha IN (SELECT sha FROM few))
SELECT 'developer:' || author AS source, 'commit:' || sha AS target, 'authored' AS type, 1::BIGINT AS weight FROM few UNION ALL SELECT 'commit:' || sha, 'component:' || component, 'touched', count(*)::BIGINT FROM t WHERE n <= 20 GROUP BY sha, component""")
def commit_graph(spark, sf_dir):
    return reports.commit_graph(ad.commits(spark, sf_dir), ad.commit_files(spark, sf_dir))


@query("""+m AS (SELECT * FROM commit_files WHERE contains(path, 'widget')), p AS (SELECT string_agg(path, '|' ORDER BY path) AS paths FROM (SELECT DISTINCT path FROM m ORDER BY path LIMIT 10))
SELECT count(DISTINCT sha)::BIGINT AS commits, count(DISTINCT author)::BIGINT AS authors, count(DISTINCT path)::BIGINT AS files, any_value(p.paths) AS paths, 'widget' AS topic FROM m, p""")
def component_summary(spark, sf_dir):
    return reports.component_summary(ad.commit_files(spark, sf_dir), "widget")


@query("""+v AS (VALUES ('api'), ('auth'), ('cache'), ('database'), ('gateway'), ('queue'), ('redis'), ('retry'), ('service')), t AS (SELECT c.sha, v.col0 AS term FROM commits c, v WHERE contains(lower(c.subject), v.col0))
SELECT term, count(*)::BIGINT AS mentions, count(DISTINCT sha)::BIGINT AS sources FROM t GROUP BY term ORDER BY mentions DESC, term LIMIT 20""")
def architecture_terms(spark, sf_dir):
    evidence = ad.commits(spark, sf_dir).select(F.col("sha").alias("source_id"), F.col("subject").alias("title"), F.lit("").alias("snippet"))
    return reports.architecture(evidence)


@query("""+s AS (SELECT sha, subject, lower(subject) AS x FROM commits WHERE regexp_matches(lower(subject), 'microservice|kafka|redis|database|terraform|kubernetes|migration|decision|adr')),
r AS (SELECT sha::VARCHAR AS source_id, subject AS title, round(least(1.0::DOUBLE, 0.35::DOUBLE + (CASE WHEN contains(x, 'redis') THEN 1 ELSE 0 END + CASE WHEN contains(x, 'timeout') THEN 1 ELSE 0 END) / 2.0::DOUBLE * 0.45::DOUBLE + CASE WHEN contains(x, 'redis timeout') THEN 0.25::DOUBLE ELSE 0 END), 6) AS confidence FROM s)
SELECT * FROM r WHERE confidence > 0.35 ORDER BY confidence DESC, source_id::BIGINT LIMIT 10""")
def decisions(spark, sf_dir):
    evidence = ad.commits(spark, sf_dir).select(F.col("sha").alias("source_id"), F.lit("").alias("path"), F.col("subject").alias("title"), F.lit("").alias("snippet"), "ts")
    return reports.decisions(evidence, "redis timeout")


@query("SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS value FROM events GROUP BY event_type", canonical=False)
def watch_stream(spark, sf_dir):
    """Events as a stream of files, each batch taken in by foreachBatch; the result is what all batches left."""
    from . import streams

    return streams.counted_events(spark, sf_dir)
