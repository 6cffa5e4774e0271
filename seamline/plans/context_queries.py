"""Queries that answer with several parts, and the same results as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import infer
from . import code_tables, composites
from .code_queries import RESOLVED, _sources, index_of, part_of
from .memory_queries import CM, _hits, memory_of
from .registry import query

Q = "unused_14"
#: Symbols that a search for Q and two hops reach, ranked; then taken in order while they fit into 300 tokens.
RANKED = f""", hits AS (SELECT q FROM sym WHERE name ILIKE '%{Q}%' OR q ILIKE '%{Q}%' OR coalesce(docstring, '') ILIKE '%{Q}%' ORDER BY CASE WHEN name = '{Q}' THEN 0 WHEN q = '{Q}' THEN 1 WHEN name ILIKE '{Q}%' THEN 2 ELSE 3 END, length(q), q LIMIT 50
), pairs AS (SELECT source_key AS a, target_key AS b FROM edge_rows UNION SELECT target_key, source_key FROM edge_rows), d0 AS (SELECT 'symbol:' || q AS key FROM hits), d1 AS (SELECT b AS key FROM pairs JOIN d0 ON d0.key = a UNION SELECT key FROM d0), d2 AS (SELECT b AS key FROM pairs JOIN d1 ON d1.key = a UNION SELECT key FROM d1
), ie AS (SELECT * FROM edge_rows WHERE source_key IN (SELECT key FROM d1) OR target_key IN (SELECT key FROM d1)), bonus AS (
  SELECT key, sum(CASE edge_type WHEN 'CALLS' THEN 28 WHEN 'INHERITS' THEN 24 WHEN 'REFERENCES' THEN 20 WHEN 'CONTAINS' THEN 10 WHEN 'IMPORTS' THEN 8 WHEN 'DEFINES' THEN 6 ELSE 4 END::DOUBLE) AS bonus FROM (SELECT source_key AS key, edge_type FROM ie UNION ALL SELECT target_key, edge_type FROM ie) GROUP BY key
), code AS (
  SELECT s.q, s.path, s.line_start, CASE WHEN s.q IN (SELECT q FROM hits) THEN 80 ELSE 0 END + CASE WHEN lower(s.name) = '{Q}' THEN 100 WHEN lower(s.q) = '{Q}' THEN 110 WHEN contains(lower(s.name), '{Q}') THEN 55 WHEN contains(lower(s.q), '{Q}') THEN 40 ELSE 0 END + CASE WHEN s.kind = 'METHOD' THEN 6 ELSE 0 END + coalesce(b.bonus, 0) AS score,
    ceil(length(array_to_string(string_split(f.content, chr(10))[s.line_start:s.line_end], chr(10))) / 4.0)::INTEGER AS tokens
  FROM sym s JOIN first_state f USING (path) LEFT JOIN bonus b ON b.key = 'symbol:' || s.q WHERE 'symbol:' || s.q IN (SELECT key FROM d2)
), ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, path, line_start, q) AS n FROM code WHERE tokens > 0
), fold AS (
  SELECT 0::BIGINT AS n, 0 AS used, []::VARCHAR[] AS kept UNION ALL
  SELECT r.n, CASE WHEN fold.used + r.tokens <= 300 THEN fold.used + r.tokens ELSE fold.used END, CASE WHEN fold.used + r.tokens <= 300 THEN list_append(fold.kept, r.q) ELSE fold.kept END FROM fold JOIN ranked r ON r.n = fold.n + 1
), taken AS (SELECT unnest(arg_max(kept, n)) AS q FROM fold)"""


@query(RESOLVED + RANKED + " SELECT q AS qualified_name, path, line_start, score::DOUBLE AS score, tokens FROM ranked JOIN taken USING (q)", recursive=True, tables=code_tables.SQL)
def retrieval(spark, sf_dir):
    return composites.retrieve(index_of(spark, sf_dir), Q, max_tokens=300).select("qualified_name", "path", "line_start", "score", "tokens")


@query(RESOLVED + RANKED + """, folders AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS f FROM ranked JOIN taken USING (q)), o AS (SELECT sum(tokens)::BIGINT AS o FROM ranked JOIN taken USING (q)), b AS (SELECT coalesce(sum(ceil(length(content) / 4.0)), 0)::BIGINT AS b FROM first_state WHERE kind <> 'ignored' AND EXISTS (SELECT 1 FROM folders WHERE starts_with(path, f || '/')))
SELECT greatest(b, o) AS baseline_tokens, o AS optimized_tokens, round((1 - o / greatest(b, o)::DOUBLE) * 100, 4) AS savings_percent FROM b, o""", recursive=True, tables=code_tables.SQL)
def retrieval_tokens(spark, sf_dir):
    index = index_of(spark, sf_dir)
    return composites.token_report(index, composites.retrieve(index, Q, max_tokens=300))


TEXTS = """+fts AS (SELECT path, regexp_extract_all(lower(concat_ws(' ', path, language, content)), '([a-z0-9]+)') AS ws FROM first_state WHERE kind <> 'ignored'), p AS (SELECT path, len(ws) AS len, t.term, len(list_filter(ws, lambda x: starts_with(x, t.term))) AS tf FROM fts, (SELECT unnest(['test', 'price']) AS term) t
), st AS (SELECT term, count(*) AS docs, count(*) FILTER (WHERE tf > 0) AS n, avg(len) AS mean FROM p GROUP BY term), bm AS (SELECT path, sum(greatest(ln((docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))) AS rank FROM p JOIN st USING (term) WHERE tf > 0 GROUP BY path ORDER BY rank DESC, path LIMIT 30
), ln AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INTEGER AS n FROM first_state WHERE kind <> 'ignored'), lh AS (SELECT path, n, CASE WHEN contains(lower(line), 'test') THEN 1 ELSE 0 END + CASE WHEN contains(lower(line), 'price') THEN 1 ELSE 0 END AS hits FROM ln
), bl AS (SELECT path, max(hits) AS hits, arg_min(n, (-hits, n)) AS best FROM lh WHERE hits > 0 GROUP BY path), r AS (
  SELECT f.path, (CASE WHEN contains(lower(f.path), 'test') THEN 1 ELSE 0 END + CASE WHEN contains(lower(f.path), 'price') THEN 1 ELSE 0 END) AS ph, coalesce(hits, 0) AS hits, best, rank FROM first_state f JOIN bm USING (path) LEFT JOIN bl USING (path) WHERE f.kind <> 'ignored'
) SELECT path, round(18 * ph + 12 * hits + CASE WHEN ph > 0 AND hits > 0 THEN 4 ELSE 0 END + 40 + least(20::DOUBLE, abs(rank)) + CASE WHEN regexp_matches(lower(path), 'test|spec') THEN 35 ELSE 0 END, 6) AS score, CASE WHEN best IS NULL THEN 1 ELSE greatest(best - 6, 1) END AS line_start FROM r WHERE ph > 0 OR hits > 0 ORDER BY score DESC, path LIMIT 8"""


@query(TEXTS, tables=code_tables.SQL)
def text_search_rank(spark, sf_dir):
    found = composites.text_search(index_of(spark, sf_dir), "test price")
    return found.select("path", F.round("score", 6).alias("score"), F.col("line_start").cast("int").alias("line_start"))


@query(TEXTS, tables=code_tables.SQL)
def retrieval_fallback(spark, sf_dir):
    """No symbol holds the words, so texts are searched."""
    found = composites.retrieve(index_of(spark, sf_dir), "test price").where("kind = 'FILE'")
    return found.select("path", F.round("score", 6).alias("score"), F.col("line_start").cast("int").alias("line_start"))


# -- context ------------------------------------------------------------------------------

CONTEXT = CM + _hits(["migrate"], 200) + """, hi AS (SELECT * FROM (SELECT * FROM hits WHERE place <= 10) ORDER BY coalesce(ts, ''), source_id LIMIT 5), rl AS (SELECT * FROM hits WHERE place <= 6 AND (source_type = 'document' OR impact <> 'low')), ow AS (
  SELECT author, 2.0::DOUBLE * count(DISTINCT source_id) + 0.5::DOUBLE * len(list_distinct(flatten(list(files)))) AS score, list(source_id ORDER BY place)[1:3] AS evidence FROM hits WHERE source_type = 'commit' GROUP BY author ORDER BY score DESC, author LIMIT 3
), ar AS (SELECT * FROM hits WHERE place <= 16 AND (coalesce(impact, 'low') <> 'low' OR regexp_matches(lower(snippet), '@terms@')) ORDER BY place LIMIT 4),
de AS (SELECT summary, confidence FROM ent0 ORDER BY confidence DESC, key LIMIT 3), shown AS (SELECT source_id FROM hi UNION SELECT source_id FROM (SELECT source_id FROM rl ORDER BY place LIMIT 3) UNION SELECT unnest(evidence) FROM ow UNION SELECT source_id FROM ar)"""
DECIDED = """, ent0 AS (SELECT 'decision:' || substr(sha, 1, 12) AS key, 'Architectural signal from commit: ' || purpose || '. Impact assessed as ' || impact || '.' AS summary, CASE impact WHEN 'medium' THEN 0.58::DOUBLE ELSE 0.72::DOUBLE END AS confidence FROM cm WHERE impact <> 'low' AND (contains(lower(subject), 'migrate') OR contains(lower(purpose), 'migrate')))"""
CONTEXT = CONTEXT.replace("@terms@", "|".join(infer.ARCHITECTURE_TERMS)).replace(CM, CM + DECIDED, 1)


def _context(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return composites.compressed_context(memory_of(spark, sf_dir), index_of(spark, sf_dir), "migrate")


@query(CONTEXT + " SELECT 'history' AS part, source_id AS item FROM hi UNION ALL SELECT 'decisions', summary FROM de UNION ALL SELECT 'ownership', author FROM ow UNION ALL SELECT 'architecture', source_id FROM ar UNION ALL SELECT 'evidence', source_id FROM shown")
def compressed_context(spark, sf_dir):
    parts = _context(spark, sf_dir)
    pick = {"history": "source_id", "decisions": "answer", "ownership": "developer", "architecture": "evidence", "evidence": "source_id"}
    rows = [parts[name].select(F.lit(name).alias("part"), F.col(column).alias("item")) for name, column in pick.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3]).union(rows[4])


@query(CONTEXT + " SELECT 'code' AS part, 0::BIGINT AS n UNION ALL SELECT 'history', (SELECT count(*) FROM hi) UNION ALL SELECT 'ownership', (SELECT count(*) FROM ow) UNION ALL SELECT 'architecture', (SELECT count(*) FROM ar) UNION ALL SELECT 'decisions', (SELECT count(*) FROM de) UNION ALL SELECT 'evidence', (SELECT least(8, count(*)) FROM shown)")
def ask_parts(spark, sf_dir):
    """How much each part of an answer holds; no symbol or text holds the question's word."""
    said = composites.ask(memory_of(spark, sf_dir), index_of(spark, sf_dir), "migrate")
    names = ["code", "history", "ownership", "architecture", "decisions", "evidence"]
    return spark.createDataFrame([(n, len(said[n])) for n in names], "part string, n long")


@query(CONTEXT + " SELECT 'owner' AS part, author AS item FROM ow UNION ALL SELECT 'heading', unnest(['Files', 'Snippets', 'Evidence', 'Owners', 'Tokens'])")
def agent_context(spark, sf_dir):
    made = composites.agent_context(memory_of(spark, sf_dir), index_of(spark, sf_dir), "migrate")
    headings = [line[3:] for line in made["markdown"].splitlines() if line.startswith("## ")]
    return spark.createDataFrame([("owner", r["developer"]) for r in made["ownership"]] + [("heading", h) for h in headings], "part string, item string")


@query("""SELECT * FROM (VALUES ('task'), ('status'), ('recommended_files'), ('snippets'), ('evidence'), ('ownership'), ('verification'), ('rule_findings'), ('source_outline'), ('token_report')) v(part)""", canonical=False)
def context_pack(spark, sf_dir):
    """The parts of a pack that hold something."""
    changed = _sources(spark, sf_dir).where("path like 'src/brand3/%'").select("path", F.lit("M").alias("status"))
    parts = composites.context_pack(memory_of(spark, sf_dir), index_of(spark, sf_dir), "cache total", _sources(spark, sf_dir, True), changed)
    return spark.createDataFrame([(name,) for name, df in parts.items() if name in ("snippets", "recommended_files", "source_outline") or df.limit(1).count()], "part string")


# -- status, inventories, maps ---------------------------------------------------------------


@query("""+now AS (SELECT * FROM texts_of WHERE k % 13 <> 0 AND kind <> 'ignored'), then_ AS (SELECT * FROM first_state WHERE kind <> 'ignored'), st AS (SELECT CASE WHEN a.path IS NULL THEN 'new_files' WHEN b.path IS NULL THEN 'deleted_files' WHEN b.kind = 'python' AND b.k % 10 = 3 THEN 'dirty_files' ELSE 'clean' END AS s FROM then_ a FULL JOIN now b ON a.path = b.path)
SELECT s AS metric, count(*)::BIGINT AS value FROM st WHERE s <> 'clean' GROUP BY s UNION ALL SELECT 'stale', 1 UNION ALL SELECT 'files_indexed', count(*) FROM then_ UNION ALL SELECT 'symbols', count(*) FROM sym UNION ALL SELECT 'parser_errors', count(*) FROM first_state WHERE kind IN ('broken', 'unknown')""", tables=code_tables.SQL)
def status_report(spark, sf_dir):
    return composites.status_report(index_of(spark, sf_dir), _sources(spark, sf_dir, True)).where("metric not like 'graph%'")


@query("SELECT path, c AS component, language, 0::BIGINT + (length(content) - length(replace(content, chr(10), '')) + CASE WHEN content <> '' AND NOT ends_with(content, chr(10)) THEN 1 ELSE 0 END) AS lines, length(content)::BIGINT AS size_bytes FROM first_state WHERE kind <> 'ignored'", tables=code_tables.SQL)
def file_inventory(spark, sf_dir):
    return composites.file_inventory(index_of(spark, sf_dir).files)


@query("SELECT sym.name, q AS qualified_name, sym.kind, sym.m AS module, sym.path AS file_path, f.c AS component, line_start, line_end, coalesce(signature, '') AS signature FROM sym JOIN first_state f ON f.path = sym.path", tables=code_tables.SQL)
def symbol_inventory(spark, sf_dir):
    return composites.symbol_inventory(index_of(spark, sf_dir).symbols)


@query(CM + " SELECT sha, substr(sha, 1, 12) AS short_sha, subject AS title, author, ts AS timestamp, len(files)::INTEGER AS files, risk, impact FROM cm ORDER BY ts DESC, sha DESC LIMIT 2000")
def commit_inventory(spark, sf_dir):
    return composites.commit_inventory(memory_of(spark, sf_dir).evidence)


#: Components of code and history: nodes with their figures, and edges with their weights.
MAP = CM + """, recent AS (SELECT * FROM cm ORDER BY ts DESC, sha DESC LIMIT 2000), tf AS (SELECT author, unnest(files) AS path FROM recent), touched AS (SELECT split_part(path, '/', 2) AS component, count(*)::BIGINT AS commits, count(DISTINCT author)::BIGINT AS authors FROM tf GROUP BY ALL),
fw AS (SELECT split_part(regexp_replace(path, '^node_modules/', ''), '/', 2) AS component, count(*)::BIGINT AS files FROM first_state WHERE kind <> 'ignored' GROUP BY ALL), sw AS (SELECT split_part(path, '/', 2) AS component, count(*)::BIGINT AS symbols FROM sym GROUP BY ALL),
co AS (SELECT split_part(a, '/', 2) AS s, split_part(b, '/', 2) AS t, sha FROM (SELECT sha, a, unnest(fs) AS b FROM (SELECT sha, files[1:30] AS fs, unnest(files[1:30]) AS a FROM cm)) WHERE a <> b)"""


@query(MAP + " SELECT component AS id, coalesce(files, 0) AS files, coalesce(symbols, 0) AS symbols, coalesce(commits, 0) AS commits, coalesce(authors, 0) AS authors, CASE WHEN coalesce(commits, 0) >= 25 OR coalesce(authors, 0) >= 8 THEN 'high' WHEN coalesce(commits, 0) >= 8 OR coalesce(files, 0) >= 8 THEN 'medium' ELSE 'low' END AS risk FROM fw FULL JOIN sw USING (component) FULL JOIN touched USING (component) UNION ALL SELECT unnest(['json', 'src', 'fs', 'B', 'metaclass=Meta', 'GET https://example']), 0, 0, 0, 0, 'low'", tables=code_tables.SQL)
def map_nodes(spark, sf_dir):
    nodes, _ = composites.component_graph(index_of(spark, sf_dir), memory_of(spark, sf_dir))
    return nodes.select("id", "files", "symbols", "commits", "authors", "risk")


@query(MAP + " SELECT s || '|' || t || '|COCHANGE' AS edge_id, count(*)::BIGINT AS weight FROM co WHERE s <> t GROUP BY ALL", tables=code_tables.SQL)
def map_cochange(spark, sf_dir):
    _, edges = composites.component_graph(index_of(spark, sf_dir), memory_of(spark, sf_dir))
    return edges.where("type = 'cochange'").select("edge_id", "weight")


@query(MAP + " SELECT 'files' AS metric, count(*)::BIGINT AS value FROM first_state WHERE kind <> 'ignored' UNION ALL SELECT 'symbols', count(*) FROM sym UNION ALL SELECT 'commits', count(*) FROM cm UNION ALL SELECT 'components', (SELECT count(*) FROM fw FULL JOIN sw USING (component) FULL JOIN touched USING (component)) + 6", tables=code_tables.SQL)
def build_map(spark, sf_dir):
    return composites.build_map(index_of(spark, sf_dir), memory_of(spark, sf_dir))["stats"].where("metric <> 'component_edges'")


@query("SELECT 'nodes' AS part, 'changed' AS change, count(*)::BIGINT AS n FROM (SELECT c FROM (SELECT c, count(*) AS n, count(*) FILTER (WHERE kind IN ('python', 'javascript')) AS s FROM first_state WHERE kind <> 'ignored' GROUP BY c) a FULL JOIN (SELECT c, count(*) AS n, count(*) FILTER (WHERE kind IN ('python', 'javascript')) AS s FROM first_state WHERE kind <> 'ignored' AND k % 9 <> 4 GROUP BY c) b USING (c) WHERE a.n <> b.n) t HAVING count(*) > 0", tables=code_tables.SQL)
def build_compare(spark, sf_dir):
    """A map against that of the same repository without every ninth file."""
    whole, part = index_of(spark, sf_dir), part_of(spark, sf_dir, "file_id % 9 = 4")
    found = composites.build_compare(*composites.component_graphs([whole, part], memory_of(spark, sf_dir)))
    return found["summary"].where("part = 'nodes' and change = 'changed'")


@query("SELECT count(*)::BIGINT AS files_scanned, (SELECT count(*) FROM sym)::BIGINT AS symbols, 1::BIGINT AS exact FROM first_state WHERE kind <> 'ignored'", tables=code_tables.SQL)
def benchmark_run(spark, sf_dir):
    made = composites.benchmark(lambda: index_of(spark, sf_dir), "unused_14")
    return spark.createDataFrame([(made["files_scanned"], made["symbols"], int(made["accuracy"].split(", ")[1].split(" ")[0]))], "files_scanned long, symbols long, exact long")


