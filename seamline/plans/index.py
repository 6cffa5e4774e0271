"""From parsed files to the graph: structure first, then names resolved against all symbols, as joins."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import infer
from ..operators import compare, graph, search
from ..operators.lineage import kept
from ..sources import artifacts, parsers

#: Verbs of HTTP calls, and what tells routes in decorators, names and signatures.
HTTP_METHODS = ["get", "post", "put", "patch", "delete", "head", "options"]
DECORATED = r"(?i)(?:route|api_route|get|post|put|patch|delete|head|options)\s*\(\s*['\"]([^'\"]+)['\"]"
DECORATED_VERB = r"(?i)\.(get|post|put|patch|delete|head|options|route|api_route)\s*\("
LISTED_VERBS = r"(?i)methods\s*=\s*\[[^\]'\"]*['\"]([A-Za-z]+)['\"]"
NAMED_VERB = r"^route_(get|post|put|patch|delete|use|head|options)_.+"
SIGNED_PATH = r"\.\w+\s*\(\s*['\"]([^'\"]+)['\"]"


@dataclass
class Index:
    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    calls: DataFrame
    nodes: DataFrame
    edges: DataFrame
    errors: DataFrame


def _node(key: Column, kind: str | Column, label: Column, path: Column, seq: int) -> list[Column]:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return [key.alias("key"), kind.alias("type"), label.alias("label"), path.cast("string").alias("file_path"), F.lit(None).cast("long").alias("symbol_id"), F.lit("{}").alias("metadata"), F.struct(path.alias("p"), F.lit(seq).alias("s")).alias("write_seq")]


def _edge(source: Column, target: Column, kind: str | Column, metadata: Column, seq: Column, weight: Column | None = None) -> list[Column]:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return [source.alias("source_key"), target.alias("target_key"), kind.alias("edge_type"), metadata.alias("metadata"), (F.lit(1.0) if weight is None else weight).alias("weight"), seq.alias("write_seq")]


def _nodes(writes: DataFrame) -> DataFrame:
    """upsert_nodes of writes with few rows a key: they meet by it before they are sorted, once."""
    return graph.upsert_nodes(writes.repartition("key"))


def _edges(writes: DataFrame) -> DataFrame:
    """insert_edges; writes meet by their source, which few share, while a target may be popular."""
    return graph.insert_edges(writes.repartition("source_key"))


def _meta(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in sorted(fields.items())]))


def last_symbols(parsed: DataFrame) -> DataFrame:
    """Symbols of parsed rows, the last of each qualified name by path and line."""
    # few write a name again, so rows meet by it before they are sorted, once
    writes = parsers.exploded(parsed, "symbols").repartition("qualified_name")
    return graph.upsert_last(writes.withColumn("write_seq", F.struct("path", "line_start")), ["qualified_name"])


def errors(parsed: DataFrame) -> DataFrame:
    """path, error of the files that did not parse."""
    return parsed.where("error is not null").select("path", "error")


def _used(parsed: DataFrame) -> DataFrame:
    """path, source, name, line_number, edge_type, metadata, source_module of every use of a name."""
    placed = parsed.withColumn("source_module", infer.module_name(F.col("path")))  # once a file, not once a use
    records = lambda n: placed.select("path", "source_module", F.explode(n).alias("_r")).select("path", "source_module", "_r.*")
    imports, calls, inherits, refs = (records(n) for n in ("imports", "calls", "inherits", "refs"))
    line = F.col("line_number")
    shown = F.concat(F.when(F.col("module") != "", F.concat("module", F.lit("."), "name")).otherwise(F.col("name")), F.when(F.col("alias").isNotNull(), F.concat(F.lit(" as "), "alias")).otherwise(""))
    use = lambda df, kind, source, name, metadata: df.select("path", source.alias("source"), F.col(name).alias("name"), "line_number", F.lit(kind).alias("edge_type"), metadata.alias("metadata"), "source_module")
    uses = [
        use(calls, "CALLS", schema.symbol_key(F.col("caller")), "target", _meta(arguments=F.col("arguments"), display=F.col("display"), line=line)),
        use(inherits, "INHERITS", schema.symbol_key(F.col("child")), "parent", _meta(line=line)),
        use(refs, "REFERENCES", schema.symbol_key(F.col("source")), "name", _meta(line=line)),
        use(imports.where("name <> ''"), "REFERENCES", schema.file_key(F.col("path")), "name", F.to_json(F.struct(shown.alias("import"), line.alias("line")))),
    ]
    return reduce(DataFrame.unionByName, uses)


def wanted_names(parsed: DataFrame) -> DataFrame:
    """name, source_module, called (by more than references): names once for each module that uses one, so that a
    popular name is looked up as often as there are modules."""
    return _used(parsed).groupBy("name", "source_module").agg(F.max(F.col("edge_type") != "REFERENCES").alias("called"))


def known_names(wanted: DataFrame, symbols: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """wanted names with the qualified_name that each resolves to, or null. others: as for build()."""
    among = symbols.select("name", "qualified_name", "module")
    if others is not None:
        among = among.unionByName(others.select("name", "qualified_name", "module"))
    return search.resolve(wanted, among)


def build(files: DataFrame, parsed: DataFrame, others: DataFrame | None = None, symbols: DataFrame | None = None, known: DataFrame | None = None) -> Index:
    """The whole index of files and their parsed rows (give parsed written or cached: it is read several times).

    others: symbols of further files, which names resolve to as well. symbols: last_symbols(parsed), and known:
    known_names() of them, if written already.
    """
    none = F.lit(None).cast("string")
    imports, calls = (parsers.exploded(parsed, n) for n in ("imports", "calls"))
    symbols = last_symbols(parsed) if symbols is None else symbols
    modules = parsed.where("error is null").select("path", infer.module_name(F.col("path")).alias("module"))
    path, q, line = F.col("path"), F.col("qualified_name"), F.col("line_number")
    empty = F.lit("{}")
    nodes = [
        files.select(*_node(schema.file_key(path), "FILE", path, path, 0)),
        modules.select(*_node(schema.module_key(F.col("module")), "MODULE", F.col("module"), path, 1)),
        symbols.select(*_node(schema.symbol_key(q), F.col("kind"), F.col("name"), path, 2)),
        imports.select("module").distinct().select(*_node(schema.module_key(F.col("module")), "MODULE", F.col("module"), none, 3)),
    ]
    order = F.struct(path.alias("p"), F.lit(0).alias("s"))
    at = lambda line: F.struct(path.alias("p"), F.col(line).alias("s"))
    edges = [
        modules.select(*_edge(schema.file_key(path), schema.module_key(F.col("module")), "CONTAINS", empty, order)),
        symbols.select(*_edge(schema.file_key(path), schema.symbol_key(q), "DEFINES", empty, at("line_start"))),
        symbols.select(*_edge(F.when(F.col("parent").isNotNull(), schema.symbol_key(F.col("parent"))).otherwise(schema.module_key(F.col("module"))), schema.symbol_key(q), "CONTAINS", empty, at("line_start"))),
        imports.select(*_edge(schema.file_key(path), schema.module_key(F.col("module")), "IMPORTS", _meta(alias=F.col("alias"), line=F.col("line_number"), name=F.col("name")), at("line_number"))),
    ]
    used = _used(parsed)
    known = known_names(wanted_names(parsed), symbols, others) if known is None else known
    resolved = used.join(known.drop("called"), ["name", "source_module"], "left").where((F.col("edge_type") != "REFERENCES") | q.isNotNull())
    target = F.coalesce(schema.symbol_key(q), schema.unresolved_key(F.col("name")))
    edges.append(resolved.select(*_edge(F.col("source"), target, F.col("edge_type"), F.col("metadata"), at("line_number"))))
    nodes.append(known.where(F.col("called") & q.isNull()).select("name").distinct().select(*_node(schema.unresolved_key(F.col("name")), "SYMBOL", F.col("name"), none, 4)))
    made = routes(symbols)
    route = F.concat(F.lit("route:"), q)
    about = _meta(confidence=F.lit(0.95), method=F.col("verb"), path=F.col("url"))
    nodes.append(made.select(*_node(route, "ROUTE", F.concat_ws(" ", "verb", "url"), path, 5)))
    edges.append(made.select(*_edge(route, schema.symbol_key(q), "HANDLES", about, at("line_start"), F.lit(0.95))))
    requests = http_calls(calls)
    about = _meta(confidence=F.col("confidence"), display=F.col("display"), line=line, method=F.col("verb"), target=F.col("url"))
    addressed = requests.groupBy("route_key").agg(F.max_by(F.concat_ws(" ", "verb", "url"), path).alias("label"))
    nodes.append(addressed.select(*_node(F.col("route_key"), "ROUTE", F.col("label"), none, 6)))
    edges.append(requests.select(*_edge(schema.symbol_key(F.col("caller")), F.col("route_key"), "HTTP_CALLS", about, at("line_number"), F.col("confidence"))))
    return Index(files, symbols, imports, calls, _nodes(reduce(DataFrame.unionByName, nodes)), _edges(reduce(DataFrame.unionByName, edges)), errors(parsed))


def update(index: Index, current: DataFrame) -> tuple[Index, DataFrame]:
    """An index after its tree changed, and path, status (new, dirty, deleted, clean) of all files. current: the tree's files.

    Only new and dirty files are parsed. Their nodes and edges replace the old ones, deleted files' go; edges into what
    a file writes again stay, and what clean files could not resolve is not tried again.
    """
    state = kept(compare.changed_files(index.files, current))
    touched = state.where("status in ('new', 'dirty')").select("path")
    changed = current.join(touched, "path", "left_semi")
    parsed = kept(parsers.parse_files(changed))
    gone = state.where("status in ('deleted', 'dirty')").select("path")
    old = lambda df: df.join(gone, "path", "left_anti")
    new = build(changed, parsed, old(index.symbols))
    again = new.nodes.where("file_path is not null").select("key")
    nodes, edges = graph.delete_files(index.nodes, index.edges, gone, again)
    first = F.lit(-1)
    was_node = nodes.withColumn("write_seq", F.struct(F.lit(None).cast("string").alias("p"), first.alias("s")))
    is_node = new.nodes.withColumn("write_seq", F.struct(F.lit("").alias("p"), F.lit(0).alias("s")))
    was_edge = edges.withColumn("write_seq", F.struct(F.lit(None).cast("string").alias("p"), first.alias("s")))
    both = Index(
        old(index.files).unionByName(changed, allowMissingColumns=True),
        old(index.symbols).unionByName(new.symbols, allowMissingColumns=True),
        old(index.imports).unionByName(new.imports),
        old(index.calls).unionByName(new.calls),
        _nodes(was_node.unionByName(is_node)),
        _edges(was_edge.unionByName(new.edges)),
        index.errors.join(state.where("status <> 'clean'"), "path", "left_anti").unionByName(new.errors),
    )
    return both, state


def saved(index: Index, path: str) -> Index:
    """The index written as a folder of tables and read back, so that questions don't build it anew."""
    tables = dict(vars(index))
    artifacts.export_tables(tables, path, overwrite=True)
    return Index(**artifacts.import_tables(index.files.sparkSession, path, list(tables)))


def routes(symbols: DataFrame) -> DataFrame:
    """symbols that handle a route, with its verb and url: by their name, else by their first decorator that tells one."""
    name, signature = F.col("name"), F.coalesce("signature", F.lit(""))
    signed = F.regexp_extract(signature, SIGNED_PATH, 1)
    rest = F.regexp_replace("name", "^route_", "")
    by_name = F.struct(
        F.when(name.rlike(NAMED_VERB), F.upper(F.regexp_extract("name", NAMED_VERB, 1))).otherwise("ROUTE").alias("verb"),
        F.when(signed != "", signed).otherwise(F.concat(F.lit("/"), F.regexp_replace(rest, "^[^_]*_", ""))).alias("url"),
    )
    verb = lambda d: F.upper(F.regexp_extract(d, DECORATED_VERB, 1))
    listed = lambda d: F.upper(F.regexp_extract(d, LISTED_VERBS, 1))
    any_verb = lambda d: F.when((verb(d) == "") | verb(d).isin("ROUTE", "API_ROUTE"), F.when(listed(d) != "", listed(d)).when(verb(d) == "", "ROUTE").otherwise(verb(d))).otherwise(verb(d))
    told = F.filter(F.transform("decorators", lambda d: F.struct(any_verb(d).alias("verb"), F.regexp_extract(d, DECORATED, 1).alias("url"))), lambda r: r["url"] != "")
    found = symbols.withColumn("_route", F.when(name.startswith("route_"), by_name).otherwise(F.get(told, F.lit(0))))
    return found.where("_route is not null").select("*", "_route.verb", "_route.url").drop("_route")


def http_calls(calls: DataFrame) -> DataFrame:
    """Calls named like an HTTP verb, fetch or request, with a literal first argument: verb, url, confidence, route_key."""
    first = F.regexp_replace(F.trim(F.get("arguments", F.lit(0))), "^[rubfRUBF]+|[rubfRUBF]+$", "")
    quoted = first.rlike(r"(?s)^'.*'$") & (F.length(first) > 1) | first.rlike(r'(?s)^".*"$') & (F.length(first) > 1)
    addressed = first.startswith("http://") | first.startswith("https://") | first.startswith("/")
    url = F.when(quoted, F.substr(first, F.lit(2), F.length(first) - 2)).when(addressed, first)
    name, method = F.lower("target"), F.lower(F.element_at(F.split("display", r"\."), -1))
    verb = F.upper(F.when(method.isin(HTTP_METHODS), method).when(name == "fetch", "get").otherwise(name))
    found = calls.where(name.isin([*HTTP_METHODS, "fetch", "request"]) | method.isin(HTTP_METHODS)).withColumns({"url": url, "verb": verb}).where("url <> ''")
    sure = F.col("url").startswith("http://") | F.col("url").startswith("https://") | F.col("url").startswith("/")
    return found.select("path", "caller", "display", "line_number", "verb", "url", F.when(sure, 0.78).otherwise(0.52).alias("confidence"), schema.external_route_key(F.col("verb"), F.trim("url")).alias("route_key"))


def status(previous: DataFrame, current: DataFrame) -> DataFrame:
    """path, status of an index's files against the tree's, both with path and sha256."""
    return compare.changed_files(previous, current)
