"""Questions over an index: the structural query language, ranked retrieval, packs of context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graph, rank, search
from ..operators.lineage import kept
from .index import Index


#: What a figure above zero suggests.
SUGGESTIONS = {
    "files_without_symbols": lambda n: F.concat(n, F.lit(" files have no symbols: look at parsers or generated files.")),
    "unresolved_calls": lambda n: F.concat(n, F.lit(" calls lead outside or to unknown names: check them before relying on them.")),
    "parse_errors": lambda n: F.concat(n, F.lit(" files could not be parsed.")),
    "files_skipped": lambda n: F.concat(n, F.lit(" files were skipped by the last incremental index.")),
    "stale": lambda n: F.lit("The index is older than a day: refresh it before risky changes."),
    "large_graph": lambda n: F.lit("The graph is large: look at it through a lens or a trace."),
}
#: What retrieve() gives.
SNIPPETS = "path string, qualified_name string, kind string, line_start int, line_end int, score double, reason string, tokens int, code string"


def _keys(index: Index, name: str) -> DataFrame:
    return search.find_symbols(index.symbols, name).select(F.concat(F.lit("symbol:"), "qualified_name").alias("key"))


def structural_query(index: Index, expression: str, limit: int = 50) -> DataFrame:
    """`command:value` with callers, called-by, calls, callees, imports, route, dead, http, api; else a symbol search."""
    command, colon, value = expression.partition(":")
    command, value = command.strip().lower(), value.strip()
    if not colon:
        return search.find_symbols(index.symbols, expression, limit)
    heaviest = [F.desc("weight"), F.col("source_key"), F.col("target_key"), F.col("metadata")]
    if command in ("callers", "called-by"):
        return graph.edge_view(graph.callers(index.edges, _keys(index, value)), index.nodes).orderBy(*heaviest).limit(limit)
    if command in ("calls", "callees"):
        return graph.edge_view(graph.callees(index.edges, _keys(index, value)), index.nodes).orderBy(*heaviest).limit(limit)
    if command == "imports":
        found = index.imports.where(search.like(F.col("module"), value) | search.like(F.coalesce("name", F.lit("")), value) | search.like(F.coalesce("alias", F.lit("")), value))
        return found.orderBy("path", "line_number").limit(limit)
    if command == "route":
        return route_list(index, value, limit)
    if command == "dead":
        return graph.dead_code(index.symbols, index.edges, limit)
    if command in ("http", "api"):
        held = search.like(F.coalesce("source_label", F.lit("")), value) | search.like(F.coalesce("target_label", F.lit("")), value) | search.like(F.col("metadata"), value)
        return _http_edges(index).where(held).orderBy(*heaviest).limit(limit)
    return search.find_symbols(index.symbols, value or expression, limit)


def _http_edges(index: Index) -> DataFrame:
    return graph.edge_view(index.edges.where(F.col("edge_type").isin("HTTP_CALLS", "HANDLES")), index.nodes)


def http_confidence(index: Index, limit: int = 100) -> DataFrame:
    """HTTP calls and handlers with their ends, heaviest first, and the confidence that each call's metadata tells."""
    found = _http_edges(index).withColumn("confidence", F.get_json_object("metadata", "$.confidence").cast("double"))
    return found.orderBy(F.desc("weight"), "source_label", "target_label", "source_key", "target_key", "metadata").limit(limit)


def route_list(index: Index, value: str = "", limit: int = 100) -> DataFrame:
    """key, label, file_path, metadata of routes whose label or file holds the value, by file and label."""
    routes = index.nodes.where(F.col("type") == "ROUTE")
    if value:
        routes = routes.where(search.like(F.col("label"), value) | search.like(F.coalesce("file_path", F.lit("")), value))
    return routes.select("key", "label", "file_path", "metadata").orderBy(F.asc_nulls_first("file_path"), "label", "key").limit(limit)


def retrieve(index: Index, query: str, *, depth: int = 2, max_tokens: int = 8000) -> DataFrame:
    """Ranked snippets of code for a query under a token budget; those that don't fit are skipped, a first one is cut.

    Only the symbols that the traversal reaches are ranked, and only their files' content is read. Where no symbol
    matches, nothing is reached and the graph is not asked for.
    """
    matched = kept(search.find_symbols(index.symbols, query))
    if not matched.limit(1).count():
        return index.symbols.sparkSession.createDataFrame([], SNIPPETS)
    seeds = matched.select(F.concat(F.lit("symbol:"), "qualified_name").alias("key"))
    reached = graph.traverse(index.edges, seeds, depth)
    around = graph.incident_edges(index.edges, reached, depth)
    rows = index.symbols.join(reached, F.concat(F.lit("symbol:"), "qualified_name") == F.col("key"), "left_semi")
    ranked = rank.rank_snippets(rows, query, graph.edge_bonus(around), matched)
    coded = ranked.join(index.files.select("path", "content"), "path").withColumn("code", tx.line_range(F.col("content"), F.col("line_start"), F.col("line_end"))).drop("content")
    coded = coded.where("code <> ''").withColumn("tokens", tx.estimate_tokens(F.col("code")))
    ordered = coded.select(F.lit(0).alias("_all"), (-F.col("score")).alias("order"), "path", "line_start", "qualified_name", "tokens")
    chosen = rank.greedy_kept(ordered, "_all", ["order", "path", "line_start", "qualified_name"], "tokens", max_tokens, "qualified_name", cut_first=True)
    taken = chosen.select(F.explode("names").alias("qualified_name"))
    out = coded.join(taken, "qualified_name").withColumn("code", tx.trim_to_tokens(F.col("code"), max_tokens))
    return out.select("path", "qualified_name", "kind", "line_start", "line_end", "score", "reason", "tokens", "code").orderBy(F.desc("score"), "path", "line_start")


def explain(index: Index, name: str) -> DataFrame:
    return graph.dependencies(index.edges, _keys(index, name))


def explained_imports(index: Index, name: str) -> DataFrame:
    """import: what the files of symbols that match the name, loosely, bring in, each once."""
    found = imports_for_files(index, search.find_symbols(index.symbols, name).select("path"))
    shown = F.concat(F.col("module"), F.when(F.coalesce("name", F.lit("")) != "", F.concat(F.lit("."), "name")).otherwise(""), F.when(F.coalesce("alias", F.lit("")) != "", F.concat(F.lit(" as "), "alias")).otherwise(""))
    return found.select(shown.alias("import")).distinct()


def neighborhood(index: Index, name: str, depth: int = 1) -> DataFrame:
    return graph.traverse(index.edges, _keys(index, name), depth)


def outline(index: Index, query: str = "", limit: int = 80) -> DataFrame:
    """path and its symbols in order of lines, of files that a path, name or kind matches.

    As the first 8 * limit matching symbols count, by path and line, a file beyond them is not shown, or not whole.
    """
    hit = search.like(F.col("path"), query) | search.like(F.col("name"), query) | search.like(F.col("qualified_name"), query) | search.like(F.col("kind"), query)
    rows = (index.symbols.where(hit) if query else index.symbols).orderBy("path", "line_start", "name").limit(8 * limit)
    found = rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line_start", "name", "kind"))).alias("symbols"))
    return found.orderBy("path").limit(limit)


def all_symbols(index: Index) -> DataFrame:
    return index.symbols.orderBy("qualified_name")


def nodes_by_keys(index: Index, keys: DataFrame) -> DataFrame:
    """Nodes of the keys (key) that there are."""
    return index.nodes.join(keys.select("key").distinct(), "key", "left_semi")


def symbols_by_keys(index: Index, keys: DataFrame) -> DataFrame:
    """Symbols of the keys (key) that name symbols."""
    named = keys.where(F.col("key").startswith("symbol:")).select(F.regexp_replace("key", "^symbol:", "").alias("qualified_name")).distinct()
    return index.symbols.join(named, "qualified_name", "left_semi")


def imports_for_files(index: Index, paths: DataFrame) -> DataFrame:
    """Imports of the files (path), by file and line."""
    return index.imports.join(paths.select("path").distinct(), "path", "left_semi").orderBy("path", "line_number")


def files_in_directories(files: DataFrame, directories: list[str]) -> DataFrame:
    """Files below any of the folders, each once; "" and "." are the files at the top alone, and no folder means all files."""
    if not directories:
        return files
    at_top = F.instr("path", "/") == 0
    below = [at_top if d in ("", ".") else F.col("path").startswith(d.rstrip("/") + "/") for d in dict.fromkeys(directories)]
    return files.where(reduce(lambda a, b: a | b, below))


def wide_edges(index: Index) -> DataFrame:
    """Edges with the nodes of both ends and, where an end is a symbol, what is known of it."""
    shown = {"qualified_name": "qualified_name", "name": "symbol_name", "kind": "symbol_kind", "module": "module", "signature": "signature", "line_start": "line_start", "line_end": "line_end"}
    # nodes and symbols meet first, so that edges, which are more, are joined once a side
    nodes = index.nodes.select("key", "label", F.col("type").alias("node_kind"), F.col("file_path").alias("node_path"))
    known = index.symbols.select(F.concat(F.lit("symbol:"), "qualified_name").alias("key"), *[F.col(f).alias(n) for f, n in shown.items()])
    ends = nodes.join(known, "key", "full")
    names = {"label": "label", "node_kind": "kind", "node_path": "path"} | {n: n for n in shown.values()}
    end = lambda side: ends.select(F.col("key").alias(f"{side}_key"), *[F.col(c).alias(f"{side}_{n}") for c, n in names.items()])
    wide = index.edges.join(end("source"), "source_key", "left").join(end("target"), "target_key", "left")
    given = [c for c in index.edges.columns if c not in ("source_key", "target_key")]
    sides = [f"{side}_{n}" for part in (["label", "kind", "path"], list(shown.values())) for side in ("source", "target") for n in part]
    return wide.select("target_key", "source_key", *given, *sides)


def diagnostics(index: Index, *, indexed_hours_ago: float | None = None, skipped: int = 0, component_edges: int = 0, components: int = 0) -> DataFrame:
    """metric, value, suggestion: languages, files without symbols, unresolved calls, external dependencies, parse errors, symbols a file, density, staleness."""
    count = lambda df, metric, what=None: df.agg(F.lit(metric).alias("metric"), (F.count_distinct(what) if what is not None else F.count(F.lit(1))).cast("double").alias("value"))
    bare = count(index.files.join(index.symbols, "path", "left_anti"), "files_without_symbols")
    seen = graph.edge_view(index.edges, index.nodes).where("target_path is null")
    lost = count(seen.where("edge_type = 'CALLS'"), "unresolved_calls")
    outside = count(seen, "external_dependencies", F.nullif(F.coalesce(F.nullif(F.col("target_label"), F.lit("")), F.col("target_key")), F.lit("")))
    broken = count(index.errors, "parse_errors")
    languages = index.files.groupBy(F.concat(F.lit("language:"), F.coalesce("language", F.lit("unknown"))).alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    files, symbols = index.files.agg(F.count(F.lit(1)).alias("_f")), index.symbols.agg(F.count(F.lit(1)).alias("_s"))
    each = files.join(F.broadcast(symbols)).select(F.lit("symbols_per_file").alias("metric"), F.when(F.col("_f") > 0, F.round(F.col("_s") / F.col("_f"), 2)).otherwise(0.0).alias("value"))
    stale = indexed_hours_ago is not None and indexed_hours_ago > 24
    given = [("files_skipped", float(skipped)), ("graph_density", round(component_edges / max(components, 1), 2)), ("stale", float(stale)), ("large_graph", float(components > 180 or component_edges > 280))]
    rows = reduce(DataFrame.union, [languages, bare, lost, outside, broken, each, index.files.sparkSession.createDataFrame(given, "metric string, value double")])
    number = F.col("value").cast("long").cast("string")
    advice = reduce(lambda a, kv: F.when((F.col("metric") == kv[0]) & (F.col("value") > 0), kv[1](number)).otherwise(a), SUGGESTIONS.items(), F.lit(None).cast("string"))
    return rows.withColumn("suggestion", advice)
