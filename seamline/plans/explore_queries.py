"""Queries that look at graphs, and the same results as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import infer
from ..functions import text as tx
from ..operators import components, explore
from . import adapters as ad
from . import api, code_queries, code_tables
from .registry import query

ACTIONS = [(1, "Copy share link", "share", "url clipboard", False), (2, "Trace callers", "trace", "incoming flow", False), (3, "Trace API flow", "trace", "routes requests", True), (4, "Fit selection", "view", "zoom", False), (5, "Agent context", "agent", "copy prompt", False), (6, "Show tests", "lens", "specs", False)]
GRAPH = r"""+gn AS (
  SELECT n.key AS id, lower(n.type) AS type, coalesce(regexp_extract(n.file_path, '[^/]*$'), n.label) AS label, s.symbol_id AS k, coalesce(s.line_start, 0) AS size,
         CASE WHEN lower(n.key) = 'module:africa' THEN 'third_party' WHEN regexp_matches(lower(concat_ws(' ', n.key, coalesce(regexp_extract(n.file_path, '[^/]*$'), n.label), n.file_path)), '(^|[/._-])(__tests__|tests?|specs?)($|[/._-])') THEN 'tests' ELSE 'owned' END AS category,
         CASE WHEN coalesce(s.line_start, 2) % 5 = 0 THEN 'high' WHEN coalesce(s.line_start, 2) % 5 = 1 THEN 'medium' ELSE 'low' END AS risk
  FROM nodes n LEFT JOIN symbols s ON n.key = 'symbol:' || s.qualified_name
), ge AS (SELECT source_key || '>' || target_key || '>' || edge_type AS edge_id, source_key AS source, target_key AS target, lower(edge_type) AS type, weight, weight::BIGINT % 7 AS examples FROM edges)"""
ENDED = """, gx AS (SELECT ge.*, a.category AS sc, b.category AS tc, a.risk AS sr, b.risk AS tr, a.label AS sl, b.label AS tl, CASE WHEN ge.type = 'calls' THEN 'functions' ELSE 'component' END AS connection,
  coalesce(a.category IN ('team', 'third_party'), false) OR coalesce(b.category IN ('team', 'third_party'), false) AS crosses FROM ge LEFT JOIN gn a ON a.id = source LEFT JOIN gn b ON b.id = target)"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = ad.symbols(spark, sf_dir).select(F.concat(F.lit("symbol:"), "qualified_name").alias("id"), F.col("symbol_id").alias("k"), F.col("line_start"))
    rows = ad.nodes(spark, sf_dir).withColumnRenamed("key", "id").join(symbols, "id", "left")
    label = F.coalesce(F.regexp_extract("file_path", "([^/]*)$", 1), "label")
    place = F.coalesce("line_start", F.lit(2)) % 5
    risk = F.when(place == 0, "high").when(place == 1, "medium").otherwise("low")
    rows = rows.withColumns({"label": label, "type": F.lower("type"), "size": F.coalesce("line_start", F.lit(0)), "risk": risk})
    category = infer.node_category(F.col("id"), F.col("label"), F.col("file_path"), F.col("type"), F.array().cast("array<string>"), third_party=["module:africa"])
    return rows.select("id", "type", "label", "k", "size", category.alias("category"), "risk", *[F.lit(0).alias(c) for c in ("files", "functions", "methods", "classes")])


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.edges(spark, sf_dir).select(F.concat_ws(">", "source_key", "target_key", "edge_type").alias("edge_id"), F.col("source_key").alias("source"), F.col("target_key").alias("target"), F.lower("edge_type").alias("type"), "weight", (F.col("weight").cast("long") % 7).alias("examples"))


def _ended(spark, sf_dir) -> DataFrame:
    return explore.with_ends(_edges(spark, sf_dir), _nodes(spark, sf_dir))


def _seed(spark, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _reach(name: str, pairs: str, seeds: str, hops: int) -> str:
    """CTEs name0 ... of ids within so many hops along pairs (a, b)."""
    parts = [f"{name}0 AS (SELECT id FROM ({seeds}) x)"]
    parts += [f"{name}{h} AS (SELECT p.b AS id FROM ({pairs}) p JOIN {name}{h - 1} r ON r.id = p.a UNION SELECT id FROM {name}{h - 1})" for h in range(1, hops + 1)]
    return ", ".join(parts)


BOTH = "SELECT source AS a, target AS b FROM {e} UNION SELECT target, source FROM {e}"

# -- lenses and guards --------------------------------------------------------------


@query("""SELECT * FROM (VALUES ('overview', 180, 1.0::DOUBLE, true, 'owned|team|tests', 'api|component|custom|database|functions|graphql|projects|tests'), ('subway', 12, 1.0, true, 'owned|team|tests', 'api|component|custom|database|functions|graphql|projects|tests'),
  ('apis', 220, 1.0, true, 'owned|team|tests', 'api|custom|functions|graphql|projects'), ('data', 220, 1.0, true, 'owned|team|tests', 'custom|database|functions|projects'), ('tests', 180, 1.0, true, 'owned|team|tests', 'component|functions|tests'),
  ('external', 220, 1.0, true, 'owned|team|third_party', 'api|component|custom|projects'), ('git', 260, 2.0, true, 'owned|team|tests', 'git'), ('full', 0, 1.0, false, 'docs_config|generated|owned|team|tests|third_party', 'api|component|custom|database|functions|git|graphql|projects|tests')
) v(lens, node_budget, min_weight, connected_only, categories, connections)""", canonical=False)
def lens_presets(spark, sf_dir):
    return explore.lens_table(spark).withColumns({c: F.array_join(c, "|") for c in ("categories", "connections")})


@query("SELECT count(DISTINCT component)::BIGINT AS components, (SELECT count(*) FROM edges)::BIGINT AS component_edges, count(*)::BIGINT AS files, count(*)::BIGINT AS symbols, count(DISTINCT component) > 350 OR (SELECT count(*) FROM edges) > 1200 OR count(*) > 3000 OR count(*) > 50000 AS large, CASE WHEN count(DISTINCT component) > 350 OR (SELECT count(*) FROM edges) > 1200 OR count(*) > 3000 OR count(*) > 50000 THEN 240 ELSE 500 END::INTEGER AS node_budget FROM files")
def large_graph_guard(spark, sf_dir):
    files = ad.files(spark, sf_dir).agg(F.count_distinct("component").alias("components"), F.count(F.lit(1)).alias("files"), F.count(F.lit(1)).alias("symbols"))
    sizes = files.join(F.broadcast(ad.edges(spark, sf_dir).agg(F.count(F.lit(1)).alias("component_edges"))))
    return explore.large_graph_guard(sizes, 500)


# -- traces ---------------------------------------------------------------------------

RED = "SELECT 'symbol:' || qualified_name AS id FROM symbols WHERE name = 'red_widget'"
MODES = {"callers": "connection = 'functions'", "callees": "connection = 'functions'", "api": "connection = 'functions' OR crosses", "data": "regexp_matches(type, 'db|sql|model|schema|store')", "tests": "regexp_matches(lower(concat_ws(' ', sl, tl)), 'test|spec')", "git": "false"}


@query(GRAPH + ", " + _reach("r", BOTH.format(e="ge"), "SELECT 'module:supplier_1' AS id", 3) + " SELECT id FROM r3")
def expand_neighborhood(spark, sf_dir):
    return explore.expand(_edges(spark, sf_dir), _seed(spark, "module:supplier_1"), 9)


@query(GRAPH + ENDED + ", " + ", ".join(f"m_{m} AS (SELECT * FROM gx WHERE {c})" for m, c in MODES.items()) + ", " + ", ".join([_reach("x", "SELECT target AS a, source AS b FROM m_callers", RED, 2), _reach("y", "SELECT source AS a, target AS b FROM m_callees", "SELECT 'module:supplier_1' AS id", 2), *[_reach(f"z_{m}_", BOTH.format(e=f"m_{m}"), "SELECT 'module:supplier_1' AS id", 1) for m in ("api", "data", "tests", "git")], _reach("w", BOTH.format(e="gx"), "SELECT 'module:supplier_1' AS id", 1)]) + """
SELECT 'callers' AS mode, edge_id, 1 AS step FROM m_callers WHERE target IN (SELECT id FROM x0) UNION ALL SELECT 'callers', edge_id, 2 FROM m_callers WHERE target IN (SELECT id FROM x1 EXCEPT SELECT id FROM x0)
UNION ALL SELECT 'callees', edge_id, 1 FROM m_callees WHERE source IN (SELECT id FROM y0) UNION ALL SELECT 'callees', edge_id, 2 FROM m_callees WHERE source IN (SELECT id FROM y1 EXCEPT SELECT id FROM y0)
UNION ALL SELECT 'neighbors', edge_id, 0 FROM gx WHERE source IN (SELECT id FROM w1) AND target IN (SELECT id FROM w1)""" + "".join(f" UNION ALL SELECT '{m}', edge_id, 0 FROM m_{m} WHERE source IN (SELECT id FROM z_{m}_1) AND target IN (SELECT id FROM z_{m}_1)" for m in ("api", "data", "tests", "git")))
def trace_modes(spark, sf_dir):
    edges = _ended(spark, sf_dir)
    red = ad.symbols(spark, sf_dir).where("name = 'red_widget'").select(F.concat(F.lit("symbol:"), "qualified_name").alias("id"))
    out = None
    for mode in ("callers", "callees", "neighbors", "api", "data", "tests", "git"):
        _, walked = explore.trace(edges, red if mode == "callers" else _seed(spark, "module:supplier_1"), mode, 2 if mode in ("callers", "callees") else 1)
        step = F.col("step") if "step" in walked.columns else F.lit(0)
        rows = walked.select(F.lit(mode).alias("mode"), "edge_id", step.cast("int").alias("step"))
        out = rows if out is None else out.union(rows)
    return out


PINNED = ENDED + ", vis AS (SELECT * FROM gx WHERE source IN (SELECT id FROM gn) AND target IN (SELECT id FROM gn)), " + _reach("f", BOTH.format(e="vis"), "SELECT 'module:supplier_1' AS id", 1) + ", pc AS (SELECT * FROM vis WHERE connection = 'functions'), " + _reach("p", "SELECT source AS a, target AS b FROM pc", "SELECT 'module:supplier_2' AS id", 1)


@query(GRAPH + PINNED + """, ids AS (SELECT id FROM f1 UNION SELECT id FROM p1), kept AS (SELECT edge_id, source, target FROM vis WHERE source IN (SELECT id FROM f1) AND target IN (SELECT id FROM f1) UNION SELECT edge_id, source, target FROM pc WHERE source IN (SELECT id FROM p0))
SELECT edge_id FROM kept WHERE source IN (SELECT id FROM ids) AND target IN (SELECT id FROM ids)""")
def pinned_trace(spark, sf_dir):
    _, edges, _ = explore.limit_graph(_nodes(spark, sf_dir), _edges(spark, sf_dir), focus=_seed(spark, "module:supplier_1"), pinned=(_seed(spark, "module:supplier_2"), "callees", 1))
    return edges.select("edge_id")


LIMITED = ENDED + """, n0 AS (SELECT * FROM gn WHERE id <> 'module:supplier_3' AND category IN ('owned', 'tests')), e0 AS (SELECT * FROM gx WHERE coalesce(weight, 1) >= 46 AND connection IN ('functions') AND source IN (SELECT id FROM n0) AND target IN (SELECT id FROM n0)),
ends AS (SELECT source AS id FROM e0 UNION SELECT target FROM e0), n1 AS (SELECT * FROM n0 WHERE id IN (SELECT id FROM ends)), """ + _reach("f", BOTH.format(e="e0"), "SELECT 'module:supplier_1' AS id UNION SELECT 'module:supplier_4'", 2) + """, n2 AS (SELECT * FROM n1 WHERE id IN (SELECT id FROM f2)), e2 AS (SELECT * FROM e0 WHERE source IN (SELECT id FROM f2) AND target IN (SELECT id FROM f2)),
deg AS (SELECT id, sum(w) AS d FROM (SELECT source AS id, weight AS w FROM e2 UNION ALL SELECT target, weight FROM e2) GROUP BY id), n3 AS (SELECT n2.id FROM n2 LEFT JOIN deg USING (id) ORDER BY round((coalesce(d, 0) + size * 0.05::DOUBLE)::DOUBLE, 6) DESC, id LIMIT 12)"""


def _limited(spark, sf_dir):
    return explore.limit_graph(_nodes(spark, sf_dir), _edges(spark, sf_dir), categories=["owned", "tests"], hidden=["module:supplier_3"], min_weight=46, connections=["functions"], connected_only=True, focus=_seed(spark, "module:supplier_1", "module:supplier_4"), mode="neighbors", hops=2, budget=12)


@query(GRAPH + LIMITED + " SELECT 'connection' AS stage, (SELECT count(*) FROM n0) - (SELECT count(*) FROM n1) AS n UNION ALL SELECT 'connected', 0 UNION ALL SELECT 'focus', (SELECT count(*) FROM n1) - (SELECT count(*) FROM n2) UNION ALL SELECT 'budget', (SELECT count(*) FROM n2) - (SELECT count(*) FROM n3) WHERE (SELECT count(*) FROM n2) > 12")
def limit_counts(spark, sf_dir):
    return _limited(spark, sf_dir)[2]


@query(GRAPH + LIMITED + " SELECT 'node' AS part, id FROM n3 UNION ALL SELECT 'edge', edge_id FROM e2 WHERE source IN (SELECT id FROM n3) AND target IN (SELECT id FROM n3)")
def limit_graph(spark, sf_dir):
    nodes, edges, _ = _limited(spark, sf_dir)
    return nodes.select(F.lit("node").alias("part"), "id").union(edges.select(F.lit("edge"), "edge_id"))


@query(GRAPH + ENDED + ", k AS (SELECT id, category FROM gn WHERE category IN ('owned') AND id <> 'module:supplier_2'), s AS (SELECT * FROM gx WHERE weight >= 47 AND connection = 'functions' AND source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)) SELECT id, category FROM k WHERE id IN (SELECT source FROM s UNION SELECT target FROM s)")
def graph_filter_nodes(spark, sf_dir):
    nodes, _ = components.filter_graph(_nodes(spark, sf_dir).select("id", "category"), _edges(spark, sf_dir), hidden_categories=["tests", "third_party"], hidden_ids=["module:supplier_2"], min_weight=47, connections=["functions"])
    return nodes


@query(GRAPH + ENDED + " SELECT edge_id, connection || CASE WHEN crosses THEN '|projects' ELSE '' END AS connections FROM gx")
def edge_connections(spark, sf_dir):
    rows = _ended(spark, sf_dir)
    return rows.select("edge_id", F.array_join(infer.connections(F.col("type"), F.coalesce("source_category", F.lit("")), F.coalesce("target_category", F.lit(""))), "|").alias("connections"))


@query(GRAPH + ENDED + """ SELECT edge_id, CASE WHEN coalesce(sr = 'high', false) OR coalesce(tr = 'high', false) THEN 'Touches a high-risk component; inspect exact proofs before editing.' WHEN coalesce(sr = 'medium', false) OR coalesce(tr = 'medium', false) THEN 'Touches a medium-risk component; review related callers, callees, and tests.'
  WHEN examples > 0 THEN 'Exact source examples are available below.' ELSE 'Use this as a lead and inspect nearby evidence before relying on it.' END AS status FROM gx""")
def edge_risk_text(spark, sf_dir):
    return _ended(spark, sf_dir).select("edge_id", explore.risk_status().alias("status"))


@query(GRAPH + ENDED + " SELECT edge_id, (CASE type WHEN 'calls' THEN 4 WHEN 'references' THEN 3 WHEN 'imports' THEN 2 ELSE 0 END * 1000 + least(examples, 50))::BIGINT AS rank FROM gx WHERE (source = 'module:supplier_1' OR target = 'module:supplier_1') AND connection = 'functions' ORDER BY rank DESC, weight DESC, edge_id LIMIT 8")
def trace_timeline(spark, sf_dir):
    return explore.timeline(_ended(spark, sf_dir), "module:supplier_1", "callees").select("edge_id", F.col("rank").cast("long").alias("rank"))


# -- lists ------------------------------------------------------------------------------


@query(GRAPH + " SELECT v.c AS category, count(gn.id)::BIGINT AS n FROM (VALUES ('owned'), ('team'), ('third_party'), ('docs_config'), ('tests'), ('generated')) v(c) LEFT JOIN gn ON gn.category = v.c GROUP BY v.c")
def category_counts(spark, sf_dir):
    return explore.category_counts(_nodes(spark, sf_dir))


@query(GRAPH + ENDED + ", h AS (SELECT connection AS c FROM gx UNION ALL SELECT 'projects' FROM gx WHERE crosses) SELECT v.c AS connection, count(h.c)::BIGINT AS n FROM (VALUES ('api'), ('functions'), ('graphql'), ('database'), ('component'), ('projects'), ('tests'), ('git'), ('custom')) v(c) LEFT JOIN h ON h.c = v.c GROUP BY v.c")
def connection_counts(spark, sf_dir):
    rows = _ended(spark, sf_dir).fillna("", ["source_category", "target_category"])
    return explore.connection_counts(rows)


@query("SELECT path, component, language, line_count AS lines, size_bytes FROM files ORDER BY path LIMIT 120 OFFSET 120")
def inventory_page(spark, sf_dir):
    rows = ad.files(spark, sf_dir).select("path", infer.component(F.col("path")).alias("component"), "language", F.col("line_count").alias("lines"), "size_bytes")
    return explore.page(rows, [F.col("path")], 1)


@query("""SELECT seq, (1 + CASE WHEN lower(label) = 'trace' THEN 80 WHEN starts_with(lower(label), 'trace') THEN 45 WHEN contains(lower(label), ' trace') THEN 24 WHEN contains(kind, 'trace') THEN 18 ELSE 8 END + CASE WHEN lower(label) = 'flow' THEN 80 WHEN starts_with(lower(label), 'flow') THEN 45 WHEN contains(lower(label), ' flow') THEN 24 WHEN contains(kind, 'flow') THEN 18 ELSE 8 END
  + CASE WHEN kind = 'trace' OR regexp_matches(lower(label), 'fit|pin|selection') THEN 14 ELSE 0 END + CASE WHEN kind = 'trace' THEN 18 ELSE 0 END - CASE WHEN disabled THEN 12 ELSE 0 END)::INTEGER AS score
FROM (VALUES (1, 'Copy share link', 'share', 'url clipboard', false), (2, 'Trace callers', 'trace', 'incoming flow', false), (3, 'Trace API flow', 'trace', 'routes requests', true), (4, 'Fit selection', 'view', 'zoom', false), (5, 'Agent context', 'agent', 'copy prompt', false), (6, 'Show tests', 'lens', 'specs', false)) v(seq, label, kind, keywords, disabled)
WHERE contains(lower(concat_ws(' ', label, kind, keywords)), 'trace') AND contains(lower(concat_ws(' ', label, kind, keywords)), 'flow')""", canonical=False)
def command_palette(spark, sf_dir):
    actions = spark.createDataFrame(ACTIONS, "seq int, label string, kind string, keywords string, disabled boolean")
    return explore.palette(actions, "trace flow", selected=True).select("seq", F.col("score").cast("int").alias("score"))


TERMS = [("file", tx.file_query_terms), ("ranking", tx.ranking_terms), ("evidence", tx.evidence_terms), ("chat", tx.chat_terms)]


@query("""SELECT * FROM (VALUES ('file', 'payment|service|retry_policy|redis|cache'), ('ranking', 'payment|service|retry|policy|redis-cache'), ('evidence', 'where|is|the|payment.service|retry_policy|for|redis-cache'), ('chat', 'Where|payment.service|redis-cache|policy|retry')) v(kind, terms)""", canonical=False)
def query_tokenizers(spark, sf_dir):
    asked = "Where is the payment.service retry_policy for redis-cache"
    return spark.createDataFrame([(name, "|".join(f(asked))) for name, f in TERMS], "kind string, terms string")


@query("SELECT path, CASE WHEN regexp_matches(lower(path), 'test|spec|coverage|validate|assert') THEN 'test' WHEN regexp_matches(lower(path), 'bug|fix|error|exception|fail|regression') THEN 'bug' WHEN regexp_matches(lower(path), 'owner|owns|authored|maintainer|who changed') THEN 'ownership' WHEN regexp_matches(lower(path), 'architecture|design|decision|adr|why') THEN 'architecture' WHEN regexp_matches(lower(path), 'api|request|route|endpoint|flow') THEN 'api' WHEN regexp_matches(lower(path), 'data|database|db|sql|model|schema') THEN 'data' ELSE 'general' END AS intent FROM (SELECT path FROM files UNION ALL SELECT subject FROM commits) t")
def query_intent(spark, sf_dir):
    texts = ad.files(spark, sf_dir).select("path").union(ad.commits(spark, sf_dir).select("subject"))
    return texts.select("path", infer.intent(F.col("path")).alias("intent"))


@query("SELECT path, regexp_replace(regexp_replace(lower(path), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, substr(regexp_replace(regexp_replace(path, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48) AS name FROM files")
def slugs(spark, sf_dir):
    p = F.col("path")
    return ad.files(spark, sf_dir).select("path", tx.slug(p).alias("slug"), tx.slug_name(p).alias("name"))


# -- two states -----------------------------------------------------------------------

STATES = GRAPH + """, sn AS (SELECT *, 'tag' || coalesce(k, 0) % 3 AS tag FROM gn), bn AS (SELECT id, label, type, tag, size, risk FROM sn WHERE coalesce(k, 1) % 17 <> 5), hn AS (SELECT id, label, type, tag, CASE WHEN coalesce(k, 1) % 10 = 3 THEN size + 5 ELSE size END AS size, CASE WHEN coalesce(k, 1) % 11 = 4 THEN 'changed' ELSE risk END AS risk FROM sn WHERE coalesce(k, 1) % 13 <> 0),
nd AS (SELECT coalesce(b.id, h.id) AS id, coalesce(h.label, b.label) AS label, b.size AS bs, h.size AS hs, b.id IS NOT NULL AS in_b, h.id IS NOT NULL AS in_h, CASE WHEN b.id IS NULL THEN 'added' WHEN h.id IS NULL THEN 'removed' WHEN b.size = h.size AND b.risk = h.risk THEN 'unchanged' ELSE 'changed' END AS change FROM bn b FULL JOIN hn h ON b.id = h.id),
be AS (SELECT * FROM ge WHERE weight < 48), he AS (SELECT edge_id, source, target, type, CASE WHEN examples = 3 THEN weight + 1 ELSE weight END AS weight FROM ge WHERE weight > 3), ed AS (SELECT coalesce(b.edge_id, h.edge_id) AS edge_id, coalesce(h.source, b.source) AS source, coalesce(h.target, b.target) AS target, b.edge_id IS NOT NULL AS in_b, h.edge_id IS NOT NULL AS in_h, CASE WHEN b.edge_id IS NULL THEN 'added' WHEN h.edge_id IS NULL THEN 'removed' WHEN b.weight = h.weight THEN 'unchanged' ELSE 'changed' END AS change FROM be b FULL JOIN he h ON b.edge_id = h.edge_id)"""


def _states(spark, sf_dir):
    """Annotated nodes and edges of a base and a head."""
    key = F.coalesce("k", F.lit(1))
    nodes = _nodes(spark, sf_dir).withColumn("tags", F.array(F.concat(F.lit("tag"), (F.coalesce("k", F.lit(0)) % 3).cast("string"))))
    base = nodes.where(key % 17 != 5)
    head = nodes.where(key % 13 != 0).withColumns({"size": F.when(key % 10 == 3, F.col("size") + 5).otherwise(F.col("size")), "risk": F.when(key % 11 == 4, "changed").otherwise(F.col("risk"))})
    edges = _edges(spark, sf_dir)
    heads = edges.where("weight > 3").withColumn("weight", F.when(F.col("examples") == 3, F.col("weight") + 1).otherwise(F.col("weight")))
    listed = lambda df: df.withColumn("shown", F.array(F.col("edge_id")))
    return explore.annotated(base, head, "id", explore.node_signature(metrics=["size"])), explore.annotated(listed(edges.where("weight < 48")), listed(heads), "edge_id", explore.edge_signature("shown"))


@query(STATES + " SELECT 'node' AS part, change, count(*)::BIGINT AS n FROM nd WHERE change <> 'unchanged' GROUP BY change UNION ALL SELECT 'edge', change, count(*) FROM ed WHERE change <> 'unchanged' GROUP BY change")
def compare_summary(spark, sf_dir):
    (_, _, nodes), (_, _, edges) = _states(spark, sf_dir)
    return nodes.select(F.lit("node").alias("part"), "change", "n").union(edges.select(F.lit("edge"), "change", "n"))


@query(STATES + " SELECT 'base' AS side, id, change FROM nd WHERE in_b UNION ALL SELECT 'head', id, change FROM nd WHERE in_h")
def compare_nodes(spark, sf_dir):
    (base, head, _), _ = _states(spark, sf_dir)
    return base.select(F.lit("base").alias("side"), "id", "change").union(head.select(F.lit("head"), "id", "change"))


@query(STATES + " SELECT 'base' AS side, edge_id, change FROM ed WHERE in_b UNION ALL SELECT 'head', edge_id, change FROM ed WHERE in_h")
def compare_edges(spark, sf_dir):
    _, (base, head, _) = _states(spark, sf_dir)
    return base.select(F.lit("base").alias("side"), "edge_id", "change").union(head.select(F.lit("head"), "edge_id", "change"))


@query(STATES + " SELECT id, change, CASE WHEN in_b THEN bs ELSE hs END::INTEGER AS size FROM nd")
def merged_nodes(spark, sf_dir):
    (base, head, _), _ = _states(spark, sf_dir)
    return explore.merged_nodes(base, head).select("id", "change", F.col("size").cast("int").alias("size"))


@query(STATES + ", ids AS (SELECT id FROM nd WHERE in_h AND change <> 'unchanged' UNION SELECT source FROM ed WHERE in_h AND change <> 'unchanged' UNION SELECT target FROM ed WHERE in_h AND change <> 'unchanged') SELECT 'node' AS part, id FROM nd WHERE in_h AND id IN (SELECT id FROM ids) UNION ALL SELECT 'edge', edge_id FROM ed WHERE in_h AND change <> 'unchanged'")
def compare_gate(spark, sf_dir):
    (_, head, _), (_, edges, _) = _states(spark, sf_dir)
    nodes, changed = explore.change_gate(head, edges)
    return nodes.select(F.lit("node").alias("part"), "id").union(changed.select(F.lit("edge"), "edge_id"))


@query(STATES + " SELECT id, 'size: ' || bs || ' -> ' || hs AS lines FROM nd WHERE in_b AND in_h AND bs <> hs")
def node_deltas(spark, sf_dir):
    (base, head, _), _ = _states(spark, sf_dir)
    return explore.delta_lines(base, head, ["size", "files", "functions"]).where(F.size("lines") > 0).select("id", F.array_join("lines", "|").alias("lines"))


@query(GRAPH + ", more AS (SELECT 'custom:' || n_nationkey AS id FROM nation UNION ALL SELECT id FROM gn WHERE size > 40), every AS (SELECT id FROM gn UNION SELECT id FROM more) SELECT 'node' AS part, id FROM every UNION ALL SELECT 'edge', edge_id FROM ge UNION ALL SELECT 'edge', 'new' || n_nationkey FROM nation WHERE n_nationkey < 20")
def graph_overlay(spark, sf_dir):
    nodes, edges = _nodes(spark, sf_dir), _edges(spark, sf_dir)
    nation = ad.table(spark, sf_dir, "nation")
    name = F.concat(F.lit("custom:"), F.col("n_nationkey").cast("string"))
    more = nation.select(name.alias("id")).union(nodes.where("size > 40").select("id"))
    target = F.when(F.col("n_nationkey") < 20, "module:AFRICA").otherwise("nowhere")
    links = nation.select(F.concat(F.lit("new"), F.col("n_nationkey").cast("string")).alias("edge_id"), name.alias("source"), target.alias("target"), F.lit("custom").alias("type"), F.lit(1.0).alias("weight"))
    every, joined = explore.overlay(nodes, edges, more, links)
    return every.select(F.lit("node").alias("part"), "id").union(joined.select(F.lit("edge"), "edge_id"))


@query(GRAPH + ", l AS (SELECT edge_id, weight FROM ge WHERE weight < 30), r AS (SELECT edge_id, weight + 100 AS weight FROM ge WHERE weight > 10) SELECT coalesce(r.edge_id, l.edge_id) AS edge_id, coalesce(r.weight, l.weight) AS weight FROM l FULL JOIN r ON l.edge_id = r.edge_id")
def unique_edges(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return explore.unique_edges(edges.where("weight < 30"), edges.where("weight > 10").withColumn("weight", F.col("weight") + 100)).select("edge_id", "weight")


# -- components of code ------------------------------------------------------------------

TARGETS = """+targets AS (SELECT path, unnest(['json', 'js', 'src', 'B', 'Base', 'helper_' || h]) AS alias, unnest(['json', 'json', 'src', 'src', 'src', 'src']) AS component FROM py UNION ALL SELECT path, 'fs', 'fs' FROM js)"""


@query(TARGETS + " SELECT path, alias, component FROM targets", tables=code_tables.SQL)
def import_alias_targets(spark, sf_dir):
    return explore.import_targets(api.wide_edges(code_queries.index_of(spark, sf_dir)))


@query("""+parts AS (SELECT k, c, m FROM py UNION ALL SELECT k, c, m FROM js), links AS (
  SELECT c AS s, 'json' AS t, 'imports' AS type, 'json as js@' || path || ':1' AS example, path AS reason FROM py
  UNION ALL SELECT c, 'src', 'imports', unnest(['src.' || c || '.helper_' || h, 'src.' || c || '.Base as B']) || '@' || path || ':2', path FROM py UNION ALL SELECT c, 'fs', 'imports', 'fs as fs@' || path || ':3', path FROM js
  UNION ALL SELECT py.c, parts.c, unnest(['calls', 'references']), unnest(['Part' || j, parts.m || '.Part' || j]) || '@' || path || ':7', 'list_' || n FROM py JOIN parts ON parts.k = py.j WHERE parts.c <> py.c
  UNION ALL SELECT c, 'json', 'calls', 'js.dumps@' || path || ':14', 'total' FROM py UNION ALL SELECT c, unnest(['B', 'metaclass=Meta']), 'inherits', unnest(['B', 'metaclass=Meta']) || '@' || path || ':10', 'Part' || k FROM py
  UNION ALL SELECT c, 'GET https://example', 'http_calls', 'client.get@' || path || ':8', 'list_' || n FROM py
) SELECT s AS source, t AS target, type AS edge_type, count(*)::BIGINT AS weight, array_to_string(list(example ORDER BY example)[1:10], '|') AS examples, array_to_string(list(reason ORDER BY reason)[1:5], '|') AS reasons FROM links GROUP BY ALL""", tables=code_tables.SQL)
def code_component_edges(spark, sf_dir):
    links = explore.component_links(api.wide_edges(code_queries.index_of(spark, sf_dir)))
    return components.component_edges(links)
