"""Looking at a component graph: traces, lenses, limits with what they hide, comparisons of two states.

Nodes have id, label and, where a function needs them, category, risk, size, files, functions, methods, classes, change.
Edges have edge_id, source, target, type, weight and, where needed, examples and reasons (numbers), change.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import infer
from . import components, graph
from .lineage import kept

CATEGORIES = ["owned", "team", "third_party", "docs_config", "tests", "generated"]
CONNECTIONS = ["api", "functions", "graphql", "database", "component", "projects", "tests", "git", "custom"]


@dataclass(frozen=True)
class Lens:
    node_budget: int
    categories: tuple[str, ...]
    connections: tuple[str, ...]
    min_weight: float = 1
    connected_only: bool = True


_OURS, _BROAD = ("owned", "team", "tests"), ("api", "functions", "graphql", "database", "component", "projects", "tests", "custom")
#: What each lens shows, and sizes beyond which a graph starts under the overview.
LENSES = {
    "overview": Lens(180, _OURS, _BROAD),
    "subway": Lens(12, _OURS, _BROAD),
    "apis": Lens(220, _OURS, ("api", "functions", "graphql", "projects", "custom")),
    "data": Lens(220, _OURS, ("database", "functions", "projects", "custom")),
    "tests": Lens(180, _OURS, ("tests", "functions", "component")),
    "external": Lens(220, ("owned", "team", "third_party"), ("api", "projects", "component", "custom")),
    "git": Lens(260, _OURS, ("git",), min_weight=2),
    "full": Lens(0, tuple(CATEGORIES), tuple(CONNECTIONS), connected_only=False),
}
LARGE = {"components": 350, "component_edges": 1200, "files": 3000, "symbols": 50_000}
GUARDED_BUDGET = (180, 240)


def lens_table(spark) -> DataFrame:
    rows = [(name, x.node_budget, float(x.min_weight), x.connected_only, sorted(x.categories), sorted(x.connections)) for name, x in LENSES.items()]
    return spark.createDataFrame(rows, "lens string, node_budget int, min_weight double, connected_only boolean, categories array<string>, connections array<string>")


def large_graph_guard(sizes: DataFrame, node_budget: int = 220) -> DataFrame:
    """sizes (one row: components, component_edges, files, symbols) with large and the node budget that then holds."""
    large = reduce(lambda a, kv: a | (F.col(kv[0]) > kv[1]), LARGE.items(), F.lit(False))
    low, high = GUARDED_BUDGET
    return sizes.withColumns({"large": large, "node_budget": F.when(large, F.lit(min(max(node_budget or 220, low), high))).otherwise(node_budget)})


# -- traces -----------------------------------------------------------------------


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with source_* and target_* label, category and risk, null where an end has no node."""
    known = [c for c in ("label", "category", "risk") if c in nodes.columns]
    end = lambda side: nodes.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in known])
    return edges.join(end("source"), "source", "left").join(end("target"), "target", "left")


def matches_mode(mode: str) -> Column:
    """Whether an edge with_ends belongs to a trace mode."""
    of = infer.connections(F.col("type"), F.col("source_category"), F.col("target_category"))
    has = lambda *names: reduce(lambda a, n: a | F.array_contains(of, n), names, F.lit(False))
    if mode in ("callers", "callees"):
        return has("functions", "api")
    if mode == "api":
        return has("api", "functions", "graphql", "projects")
    if mode == "data":
        return has("database") | F.lower("type").rlike("db|sql|model|schema|store")
    if mode == "tests":
        return has("tests") | F.lower(F.concat_ws(" ", "source_label", "target_label")).rlike("test|spec")
    if mode == "git":
        return has("git")
    return F.lit(True)


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("source_key"), F.col("target").alias("target_key"))


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """id of what seeds (id) reach in 1 to 3 hops either way."""
    return graph.traverse(_pairs(edges), seeds.select(F.col("id").alias("key")), max(1, min(3, hops))).select(F.col("key").alias("id"))


def directional(edges: DataFrame, seeds: DataFrame, hops: int, incoming: bool) -> tuple[DataFrame, DataFrame]:
    """id of what 1 to 4 hops along (or against) edges reach, and the edges walked, once for each step that walks them (step)."""
    here, there = ("target", "source") if incoming else ("source", "target")
    reached = graph.traverse(_pairs(edges), seeds.select(F.col("id").alias("key")), max(1, min(4, hops)), "in" if incoming else "out")
    depth = max(1, min(4, hops))
    walked = edges.join(reached.where(F.col("dist") < depth), F.col(here) == F.col("key")).withColumn("step", F.col("dist") + 1).drop("key", "dist")
    return reached.select(F.col("key").alias("id")), walked


def inside(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose ends are both among ids (id)."""
    return edges.join(ids, F.col("source") == F.col("id"), "left_semi").join(ids, F.col("target") == F.col("id"), "left_semi")


def trace(edges: DataFrame, seeds: DataFrame, mode: str | None = None, hops: int = 1) -> tuple[DataFrame, DataFrame]:
    """id and edges of a trace from seeds (id); edges are with_ends, and callers and callees have a step."""
    if not mode or mode == "neighbors":
        ids = kept(expand(edges, seeds, hops))
        return ids, inside(edges, ids)
    of = kept(edges.where(matches_mode(mode)))
    if mode in ("callers", "callees"):
        return directional(of, seeds, hops, mode == "callers")
    ids = kept(expand(of, seeds, hops))
    return ids, inside(of, ids)


def unique_edges(*parts: DataFrame) -> DataFrame:
    """The union of edges; of one id the last part's counts, with its last row by weight."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("write_seq", F.struct(F.lit(i).alias("part"), F.coalesce("weight", F.lit(1.0)).cast("double").alias("weight"))) for i, p in enumerate(parts)])
    key = F.coalesce("edge_id", F.concat("source", F.lit("->"), "target", F.lit(":"), "type"))
    return graph.upsert_last(rows.withColumn("edge_id", key), ["edge_id"]).drop("write_seq")


def limit_graph(
    nodes: DataFrame, edges: DataFrame, *, categories: list[str] | None = None, hidden: list[str] = (), min_weight: float = 1, connections: list[str] | None = None, connected_only: bool = False,
    focus: DataFrame | None = None, mode: str | None = None, hops: int = 1, pinned: tuple[DataFrame, str, int] | None = None, budget: int = 0, by_edges: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and hidden (stage, n) after all filters in order: categories and hidden ids, edge weight and
    connections, connections that restrict nodes, connected nodes, a focused trace with a pinned one, the node budget."""
    left = nodes.where(~F.col("id").isin(list(hidden)))
    if categories is not None:
        left = left.where(F.col("category").isin(categories))
    left = kept(left)
    seen = with_ends(edges, nodes).where(F.coalesce("weight", F.lit(1.0)) >= min_weight)
    if connections is not None:
        seen = seen.where(F.arrays_overlap(F.array(infer.connection(F.col("type"))), F.array(*map(F.lit, connections))))
    seen = kept(inside(seen, left.select("id")))
    counts: list[DataFrame] = []

    def shrink(stage: str, now: DataFrame) -> DataFrame:
        now = kept(now)
        counts.append(left.agg(F.count(F.lit(1)).alias("_b")).join(F.broadcast(now.agg(F.count(F.lit(1)).alias("_a")))).select(F.lit(stage).alias("stage"), (F.col("_b") - F.col("_a")).alias("n")))
        return now

    ends = lambda: seen.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    if connections is not None and "component" not in connections and set(connections) != set(CONNECTIONS):
        left = shrink("connection", left.join(ends(), "id", "left_semi"))
    if connected_only:
        left = shrink("connected", left.join(ends(), "id", "left_semi"))
    if focus is not None:
        pin = trace(seen, *pinned) if pinned else None
        ids, walked = trace(seen, focus, mode, hops)
        walked = walked.drop("step") if "step" in walked.columns else walked
        if pin:
            ids = ids.union(pin[0]).distinct()
            walked = unique_edges(walked, pin[1].drop("step"))
        ids = kept(ids)
        left = shrink("focus", left.join(ids, "id", "left_semi"))
        seen = kept(inside(walked, ids))
    if budget > 0 and left.limit(budget + 1).count() > budget:
        first = [r["id"] for r in focus.collect()] if focus is not None else []
        chosen = components.budget_by_edges(left, seen, budget, first) if by_edges else components.budget_by_nodes(left, seen, budget)
        chosen = kept(chosen.select("id"))
        left = shrink("budget", left.join(chosen, "id", "left_semi"))
        seen = inside(seen, chosen)
    none = nodes.sparkSession.createDataFrame([], "stage string, n long")
    return left, seen, reduce(DataFrame.union, counts, none)


def detail_rank() -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in {"calls": 4, "references": 3, "imports": 2, "inherits": 2, "cochange": 1}.items() for x in kv])
    return F.coalesce(F.element_at(kinds, F.col("type")), F.lit(0)) * 1000 + F.least(F.coalesce("examples", F.lit(0)), F.lit(50))


def timeline(edges: DataFrame, node: str, mode: str = "neighbors", limit: int = 8) -> DataFrame:
    """A node's edges (with_ends) of a mode, by type and examples, then weight."""
    mine = edges.where(((F.col("source") == node) | (F.col("target") == node)) & matches_mode(mode))
    return mine.withColumn("rank", detail_rank()).orderBy(F.desc("rank"), F.desc(F.coalesce("weight", F.lit(1.0))), "edge_id").limit(limit)


def risk_status() -> Column:
    """What an edge with_ends says of risk."""
    either = lambda risk: F.col("source_risk").eqNullSafe(risk) | F.col("target_risk").eqNullSafe(risk)
    return (
        F.when(either("high"), "Touches a high-risk component; inspect exact proofs before editing.")
        .when(either("medium"), "Touches a medium-risk component; review related callers, callees, and tests.")
        .when(F.col("type") == "cochange", "Treat this as historical coupling unless exact code evidence also appears below.")
        .when(F.coalesce("examples", F.lit(0)) > 0, "Exact source examples are available below.")
        .otherwise("Use this as a lead and inspect nearby evidence before relying on it.")
    )


# -- lists ------------------------------------------------------------------------


def category_counts(nodes: DataFrame) -> DataFrame:
    """category, n for every category, also those without nodes."""
    every = nodes.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    return every.join(nodes.groupBy("category").agg(F.count(F.lit(1)).alias("n")), "category", "left").fillna(0, ["n"])


def connection_counts(edges: DataFrame) -> DataFrame:
    """connection, n of edges with_ends for every connection; an edge may count for two."""
    every = edges.sparkSession.createDataFrame([(c,) for c in CONNECTIONS], "connection string")
    held = edges.select(F.explode(infer.connections(F.col("type"), F.col("source_category"), F.col("target_category"))).alias("connection"))
    return every.join(held.groupBy("connection").agg(F.count(F.lit(1)).alias("n")), "connection", "left").fillna(0, ["n"])


def page(rows: DataFrame, order: list[Column], number: int, size: int = 120) -> DataFrame:
    """The rows that page `number` (from 0) adds to a list which grows by `size`."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def palette(actions: DataFrame, query: str, selected: bool = False) -> DataFrame:
    """actions (seq, label, kind, keywords, disabled) that hold all words of the query, with score, best first."""
    terms = query.lower().split()
    if not terms:
        return actions.withColumn("score", F.lit(0)).orderBy("seq")
    label, kind = F.lower("label"), F.lower("kind")
    held = F.lower(F.concat_ws(" ", "label", "kind", "keywords"))
    all_terms = reduce(lambda a, t: a & F.contains(held, F.lit(t)), terms, F.lit(True))
    one = lambda t: F.when(label == t, 80).when(label.startswith(t), 45).when(F.contains(label, F.lit(" " + t)), 24).when(F.contains(kind, F.lit(t)), 18).otherwise(8)
    score = reduce(lambda a, t: a + one(t), terms, F.lit(1))
    asks = lambda words: any(w in " ".join(terms) for w in words)
    if selected:
        score = score + F.when((F.col("kind") == "trace") | label.rlike("fit|pin|selection"), 14).otherwise(0)
    else:
        score = score + F.when(F.col("kind") == "share", 4).otherwise(0)
    for words, name, more in ((("copy", "link", "share", "url"), "share", 18), (("trace", "flow", "call", "api", "test"), "trace", 18), (("agent", "context"), "agent", 22)):
        if asks(words):
            score = score + F.when(F.col("kind") == name, more).otherwise(0)
    score = score - F.when(F.col("disabled"), 12).otherwise(0)
    return actions.where(all_terms).withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "seq")


# -- two states -------------------------------------------------------------------


def node_signature(tags: str = "tags", metrics: list[str] = ()) -> Column:
    """Of a node: type, sorted tags, metrics, risk."""
    return F.sha2(F.to_json(F.struct("type", F.sort_array(tags).alias("tags"), *sorted(metrics), "risk"), {"ignoreNullFields": "false"}), 256)


def edge_signature(examples: str = "examples") -> Column:
    """Of an edge: ends, type, weight and its first 20 examples."""
    return F.sha2(F.to_json(F.struct("source", "target", "type", "weight", F.slice(examples, 1, 20).alias("examples")), {"ignoreNullFields": "false"}), 256)


def annotated(base: DataFrame, head: DataFrame, key: str, signature: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides with change (added, removed, changed, unchanged), and (change, n) counts."""
    side = lambda df, name: df.select(F.col(key).alias("_key"), signature.alias(f"_{name}"))
    both = side(base, "base").join(side(head, "head"), "_key", "full")
    change = F.when(F.col("_base").isNull(), "added").when(F.col("_head").isNull(), "removed").when(F.col("_base") == F.col("_head"), "unchanged").otherwise("changed")
    told = kept(both.select("_key", change.alias("change")))
    mark = lambda df: df.join(told, F.col(key) == F.col("_key")).drop("_key")
    return mark(base), mark(head), told.where("change <> 'unchanged'").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def change_rank() -> Column:
    return F.when(F.col("change").isin("added", "removed"), 3).when(F.col("change") == "changed", 2).otherwise(0)


def merged_nodes(base: DataFrame, head: DataFrame) -> DataFrame:
    """Each id once: the row of the higher change, the base's where both are equal; by label."""
    rows = base.withColumn("_side", F.lit(0)).unionByName(head.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    first = Window.partitionBy("id").orderBy(F.desc(change_rank()), "_side")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_side").orderBy("label", "id")


def change_gate(nodes: DataFrame, edges: DataFrame, any_change: bool = True) -> tuple[DataFrame, DataFrame]:
    """What has changed: changed nodes, ends of changed edges, and changed edges between them.

    Where nothing shown has changed, nothing is left if the comparison has changes at all, else everything.
    """
    changed = edges.where("change <> 'unchanged'")
    ids = kept(nodes.where("change <> 'unchanged'").select("id").union(changed.select(F.explode(F.array("source", "target")).alias("id"))).distinct())
    if not ids.limit(1).count() and not any_change:
        return nodes, edges
    return nodes.join(ids, "id", "left_semi"), inside(changed, ids)


def delta_lines(before: DataFrame, after: DataFrame, metrics: list[str], limit: int = 8) -> DataFrame:
    """id, lines ("metric: before -> after"): of both sides' nodes the first metrics that differ."""
    side = lambda df, name: df.select("id", F.struct(*[F.coalesce(F.col(m), F.lit(0)).cast("long").alias(m) for m in metrics]).alias(name))
    both = side(before, "_b").join(side(after, "_a"), "id")
    line = lambda m: F.when(F.col(f"_b.{m}") != F.col(f"_a.{m}"), F.concat(F.lit(f"{m}: "), F.col(f"_b.{m}").cast("string"), F.lit(" -> "), F.col(f"_a.{m}").cast("string")))
    return both.select("id", F.slice(F.array_compact(F.array(*map(line, metrics))), 1, limit).alias("lines"))


def overlay(nodes: DataFrame, edges: DataFrame, more_nodes: DataFrame, more_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph with added nodes of new ids (each once) and added edges between nodes that are there."""
    new = more_nodes.dropDuplicates(["id"]).join(nodes.select("id"), "id", "left_anti")
    every = kept(nodes.unionByName(new, allowMissingColumns=True))
    return every, edges.unionByName(inside(more_edges, every.select("id")), allowMissingColumns=True)


# -- component edges from code edges ------------------------------------------------


def component_of(path: Column, label: Column) -> Column:
    """An edge end's component: its path's, else the root of its label unless that is relative."""
    text = F.trim(F.coalesce(label, F.lit("")))
    return F.when(F.coalesce(path, F.lit("")) != "", infer.component(path)).when((text != "") & ~text.startswith("."), F.element_at(F.split(text, r"\."), 1))


def import_targets(wide: DataFrame) -> DataFrame:
    """path, alias, component: what a file's imports call the component they lead to, the last of an alias by line."""
    rows = wide.where((F.upper("edge_type") == "IMPORTS") & (F.coalesce("source_path", F.lit("")) != ""))
    meta = lambda name: F.trim(F.get_json_object("metadata", f"$.{name}"))
    module = F.trim(F.coalesce("target_label", F.lit("")))
    names = F.array(F.element_at(F.split(module, r"\."), 1), meta("alias"), meta("name"))
    found = rows.select(F.col("source_path").alias("path"), component_of(F.col("target_path"), module).alias("component"), F.get_json_object("metadata", "$.line").cast("int").alias("_line"), F.posexplode(names).alias("_at", "alias"))
    found = found.where("component is not null and alias <> ''").withColumn("write_seq", F.struct("_line", "_at", "component"))
    return graph.upsert_last(found.select("path", "alias", "component", "write_seq"), ["path", "alias"]).drop("write_seq")


def component_links(wide: DataFrame) -> DataFrame:
    """source_component, target_component, edge_type, example, reason of code edges (api.wide_edges) across components.

    A call to a name outside leads to the component that its file imports the name's root from.
    """
    meta = lambda name: F.get_json_object("metadata", f"$.{name}")
    outside = F.col("target_path").isNull()
    root = F.element_at(F.split(F.trim(F.coalesce(meta("display"), F.lit(""))), r"\."), 1)
    named = import_targets(wide).select(F.col("path").alias("_path"), F.col("alias").alias("_alias"), F.col("component").alias("_imported"))
    # what stays in a component goes before symbols are joined, but for calls whose target their file's imports tell
    source, met = component_of(F.col("source_path"), F.col("source_label")), component_of(F.col("target_path"), F.col("target_label"))
    rows = wide.where((F.upper("edge_type") == "CALLS") & outside | (source != met))
    rows = rows.withColumn("_root", root).join(named, (F.col("source_path") == F.col("_path")) & (F.col("_root") == F.col("_alias")), "left")
    kind = F.upper("edge_type")
    target = F.when((kind == "CALLS") & outside, F.col("_imported")).otherwise(met)
    rows = rows.withColumns({"source_component": source, "target_component": target})
    rows = rows.where("source_component is not null and target_component is not null and source_component <> target_component")
    return rows.select("source_component", "target_component", F.lower("edge_type").alias("edge_type"), example().alias("example"), F.coalesce(F.nullif(F.col("source_label"), F.lit("")), F.col("source_key")).alias("reason"))


def edge_display() -> Column:
    """What an edge of api.wide_edges reads like: an import with its alias, else what its metadata shows, else its target."""
    meta = lambda name: F.nullif(F.coalesce(F.get_json_object("metadata", f"$.{name}"), F.lit("")), F.lit(""))
    module = F.nullif(F.coalesce("target_label", F.lit("")), F.lit(""))
    named = F.coalesce(F.when(module.isNotNull() & meta("name").isNotNull(), F.concat(module, F.lit("."), meta("name"))), module, meta("name"), F.lit(""))
    imported = F.when(meta("alias").isNotNull(), F.concat(named, F.lit(" as "), meta("alias"))).otherwise(named)
    return F.when(F.lower("edge_type") == "imports", imported).otherwise(F.coalesce(meta("display"), meta("import"), F.nullif(F.col("target_qualified_name"), F.lit("")), module, F.lit("")))


def example() -> Column:
    """An edge as an example: display, file and line, as one string."""
    line = F.coalesce(F.get_json_object("metadata", "$.line"), F.col("source_line_start").cast("string"), F.lit(""))
    return F.concat_ws("@", edge_display(), F.concat_ws(":", F.coalesce("source_path", "target_path", F.lit("")), line))
