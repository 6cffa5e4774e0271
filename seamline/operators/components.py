"""The component graph: aggregation, filters, budgets, bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from ..functions import infer

#: How an edge's type weighs when a node budget admits edges.
BUDGET_BOOST = {"api_call": 80, "function_call": 70, "calls": 70, "graphql": 65, "database": 60, "test_covers": 48, "imports": 42, "references": 38, "inherits": 34, "depends_on": 30, "custom": 90}
OTHER_BOOST = 24


def of_type(kind: Column, table: dict[str, float], otherwise: float) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.lower(kind)), F.lit(otherwise))


def component_nodes(files: DataFrame, symbols: DataFrame, commit_files: DataFrame) -> DataFrame:
    """A row a component: files, lines, kinds of symbols, commits (once a file touched), authors, service tag, size, risk."""
    own = files.groupBy("component").agg(F.count(F.lit(1)).alias("files"), F.sum("line_count").alias("lines"))
    kind = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0))
    parts = symbols.groupBy("component").agg(F.count(F.lit(1)).alias("symbols"), kind("CLASS").alias("classes"), kind("FUNCTION").alias("functions"), kind("METHOD").alias("methods"), F.max(F.lower("name").endswith("service")).alias("is_service"))
    touched = commit_files.groupBy("component").agg(F.count(F.lit(1)).alias("commits"), F.count_distinct("author").alias("authors"))
    all_ = own.join(parts, "component", "full").join(touched, "component", "full").fillna(0).fillna(False)
    size = 12 + F.least(F.lit(30), 3 * F.col("files") + F.col("symbols"))
    return all_.withColumns({"size": size, "risk": infer.component_risk(F.col("commits"), F.col("authors"), F.col("files"), F.coalesce("is_service", F.lit(False)))})


def component_edges(links: DataFrame, examples: int = 10, reasons: int = 5) -> DataFrame:
    """source, target, edge_type, weight, and the first examples and reasons of links, joined by |.

    links: source_component, target_component, edge_type, example and, if known, reason. One pass over the links: tasks
    hold a group's number and its first examples and reasons, no more, and only those are shuffled.
    """
    keys = ["source_component", "target_component", "edge_type"]
    first = lambda column, many: F.array_join(F.sort_array(InternalFunction.collect_top_k(F.col(column), many, True)), "|")
    listed = [first(c, many).alias(name) for c, many, name in (("example", examples, "examples"), ("reason", reasons, "reasons")) if c in links.columns]
    made = links.where("source_component <> target_component").groupBy(*keys).agg(F.count(F.lit(1)).alias("weight"), *listed)
    return made.withColumnsRenamed({"source_component": "source", "target_component": "target"})


def node_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id, size, functions, methods, classes, files) with their budget score."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"), F.coalesce("weight", F.lit(1)).alias("w")).groupBy("id").agg(F.sum("w").alias("_degree"))
    score = F.coalesce("_degree", F.lit(0)) + F.col("size") * 0.05 + (F.col("functions") + F.col("methods") + F.col("classes")) * 0.2 + F.col("files") * 0.6
    return nodes.join(ends, "id", "left").withColumn("score", F.round(score.cast("double"), 6)).drop("_degree")


def budget_by_nodes(nodes: DataFrame, edges: DataFrame, budget: int) -> DataFrame:
    """The nodes of the best scores, ties by id."""
    return node_scores(nodes, edges).orderBy(F.desc("score"), "id").limit(budget)


def budget_by_edges(nodes: DataFrame, edges: DataFrame, budget: int, seeds: list[str] = ()) -> DataFrame:
    """Ids that a budget of nodes keeps: seeds, then ends of the best edges while both fit, then the best nodes.

    The greedy fold runs in rounds: each takes the best 200 * budget edges, of all, that add a node and fit. What does
    neither at a round's start never will, and a round keeps an end at least, so there are budget rounds at most.
    """
    scored = node_scores(nodes, edges).select("id", "score")
    a, b = scored.select(F.col("id").alias("source"), F.col("score").alias("_a")), scored.select(F.col("id").alias("target"), F.col("score").alias("_b"))
    rank = F.round(F.coalesce("weight", F.lit(1)) * 100 + of_type(F.col("type"), BUDGET_BOOST, OTHER_BOOST) + (F.col("_a") + F.col("_b")) * 0.05, 6)
    best = edges.join(a, "source").join(b, "target").select((-rank).alias("r"), "edge_id", "source", "target")
    ids, most = list(seeds), 200 * budget
    while len(ids) < budget:
        more = F.size(F.array_except(F.array("source", "target"), F.array(*map(F.lit, ids)).cast("array<string>")))
        found = best.where((more > 0) & (more <= budget - len(ids))).orderBy("r", "edge_id", "source", "target").limit(most).collect()
        for e in found:
            added = [i for i in dict.fromkeys((e["source"], e["target"])) if i not in ids]
            if len(ids) + len(added) <= budget:
                ids += added
        if len(found) < most:
            break
    kept = nodes.sparkSession.createDataFrame([(i,) for i in ids], "id string")
    first = kept.withColumn("_tier", F.lit(0)).join(scored, "id", "left")
    rest = scored.join(kept, "id", "left_anti").withColumn("_tier", F.lit(1)).select("id", "_tier", "score")
    return first.unionByName(rest).orderBy("_tier", F.desc("score"), "id").limit(budget).select("id")


def filter_graph(nodes: DataFrame, edges: DataFrame, *, hidden_categories: list[str] = (), hidden_ids: list[str] = (), min_weight: float = 1.0, connections: list[str] | None = None, connected_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """nodes (id, category) and edges (source, target, type, weight) that the filters leave."""
    kept = nodes.where(~F.col("category").isin(list(hidden_categories)) & ~F.col("id").isin(list(hidden_ids)))
    seen = edges.where(F.coalesce("weight", F.lit(1.0)) >= min_weight)
    if connections is not None:
        seen = seen.where(infer.connection(F.col("type")).isin(connections))
    ids = kept.select("id")
    seen = seen.join(ids, F.col("source") == F.col("id"), "left_semi").join(ids, F.col("target") == F.col("id"), "left_semi")
    restrict = connections is not None and "component" not in connections
    if connected_only or restrict:
        ends = seen.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        kept = kept.join(ends, "id", "left_semi")
    return kept, seen


def bundles(edges: DataFrame, low_detail: bool = False) -> DataFrame:
    """kind (bundle or edge), key, type, n, weight of edges (edge_id, source, target, type, weight, source_category, target_category).

    Edges from or to tests, docs, generated and third-party nodes go together by the other end, type and category;
    in low detail also edges of equal ends and type. Small groups stay single edges.
    """
    grouped = ["third_party", "docs_config", "tests", "generated"]
    s, t = F.col("source_category").isin(grouped), F.col("target_category").isin(grouped)
    key = (
        F.when(t & ~s, F.concat_ws("|", F.lit("out"), "source", "type", "target_category"))
        .when(s & ~t, F.concat_ws("|", F.lit("in"), "target", "type", "source_category"))
        .when(F.lit(low_detail) & (F.col("source") != F.col("target")), F.concat_ws("|", F.lit("pair"), "source", "target", "type"))
    )
    keyed = edges.withColumn("key", key)
    many = keyed.where("key is not null").groupBy("key", "type").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    large = many.where(F.col("n") >= (2 if low_detail else 3))
    single = keyed.join(large.select("key"), "key", "left_anti")
    made = large.select(F.lit("bundle").alias("kind"), F.concat(F.lit("bundle:"), "key").alias("key"), "type", "n", "weight")
    return made.union(single.select(F.lit("edge"), F.col("edge_id"), "type", F.lit(1).cast("long"), "weight"))


def top_connections(edges: DataFrame, limit: int = 10) -> DataFrame:
    change = F.when(F.col("change").isin("added", "removed"), 3).when(F.col("change") == "changed", 2).otherwise(0)
    return edges.withColumn("change_rank", change).orderBy(F.desc("change_rank"), F.desc("weight"), "edge_id").limit(limit)


def counterparts(edges: DataFrame, node: str) -> DataFrame:
    """other, weight, edges: a node's edges by their other end, heaviest first."""
    mine = edges.where((F.col("source") == node) | (F.col("target") == node)).withColumn("other", F.when(F.col("source") == node, F.col("target")).otherwise(F.col("source")))
    return mine.groupBy("other").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("edges")).orderBy(F.desc("weight"), "other")
