"""The property graph: maintenance of nodes and edges, views of edges, traversals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import infer
from .lineage import kept

#: What an edge adds to the rank of its ends.
EDGE_BONUS = {"CALLS": 28.0, "INHERITS": 24.0, "REFERENCES": 20.0, "CONTAINS": 10.0, "IMPORTS": 8.0, "DEFINES": 6.0}
OTHER_BONUS = 4.0
USES = ["CALLS", "REFERENCES", "HANDLES"]


def upsert_nodes(writes: DataFrame) -> DataFrame:
    """One row a key: the last write's values, but the last known file_path and symbol_id. writes have write_seq."""
    last = F.max_by(F.struct("type", "label", "metadata"), "write_seq").alias("_last")
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("write_seq"))).alias(c)
    return writes.groupBy("key").agg(last, known("file_path"), known("symbol_id")).select("key", "_last.*", "file_path", "symbol_id")


def upsert_last(writes: DataFrame, keys: list[str]) -> DataFrame:
    """The last write of each key."""
    rest = [c for c in writes.columns if c not in keys]
    return writes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "write_seq").alias("_row")).select(*keys, "_row.*")


def insert_edges(writes: DataFrame) -> DataFrame:
    """The first write of each (source, target, type, metadata)."""
    keys = ["source_key", "target_key", "edge_type", "metadata"]
    rest = [c for c in writes.columns if c not in keys]
    return writes.groupBy(*keys).agg(F.min_by(F.struct(*rest), "write_seq").alias("_row")).select(*keys, "_row.*")


def upsert_entities(writes: DataFrame) -> DataFrame:
    """The last write of each key, with the greatest confidence of all."""
    last = upsert_last(writes.drop("confidence"), ["key"])
    return last.join(writes.groupBy("key").agg(F.max("confidence").alias("confidence")), "key")


def delete_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame, replaced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those files' (paths: path). Edges into a key stay if replaced (key) writes it again."""
    gone = nodes.join(paths, nodes.file_path == paths.path, "left_semi").select("key")
    kept_edges = edges.join(gone, edges.source_key == gone.key, "left_anti")
    lost = gone.join(replaced, "key", "left_anti")
    return nodes.join(gone, "key", "left_anti"), kept_edges.join(lost, kept_edges.target_key == lost.key, "left_anti")


def edge_view(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the labels, types and files of their ends, null where an end has no node."""
    end = lambda side: nodes.select(F.col("key").alias(f"{side}_key"), F.col("label").alias(f"{side}_label"), F.col("type").alias(f"{side}_kind"), F.col("file_path").alias(f"{side}_path"))
    return edges.join(end("source"), "source_key", "left").join(end("target"), "target_key", "left")


def callers(edges: DataFrame, keys: DataFrame, edge_type: str = "CALLS") -> DataFrame:
    """Edges of the type into any of the keys (key)."""
    return edges.where(F.col("edge_type") == edge_type).join(keys, edges.target_key == keys.key, "left_semi")


def callees(edges: DataFrame, keys: DataFrame, edge_type: str = "CALLS") -> DataFrame:
    return edges.where(F.col("edge_type") == edge_type).join(keys, edges.source_key == keys.key, "left_semi")


def dependencies(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """A row for each of the keys: sorted callers, callees, parents and referrers."""
    into = edges.join(keys, edges.target_key == keys.key).select("key", "edge_type", F.col("source_key").alias("other"), F.lit("in").alias("way"))
    out = edges.join(keys, edges.source_key == keys.key).select("key", "edge_type", F.col("target_key").alias("other"), F.lit("out").alias("way"))
    pick = lambda way, kind, name: F.sort_array(F.collect_set(F.when((F.col("way") == way) & (F.col("edge_type") == kind), F.col("other")))).alias(name)
    return into.union(out).groupBy("key").agg(pick("in", "CALLS", "callers"), pick("out", "CALLS", "callees"), pick("out", "INHERITS", "parents"), pick("in", "REFERENCES", "referrers"), pick("in", "IMPORTS", "importers"))


def traverse(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """key, dist of what seeds (key) reach within depth hops, along edges (out), against them (in) or both.

    The pairs are computed once. A hop joins the frontier, which is small and often broadcast, with the pairs on the
    sides that the direction asks for, and only what it meets is made distinct and compared with what is reached.
    """
    pairs = kept(edges.select("source_key", "target_key"))
    reached = seeds.select("key").distinct().withColumn("dist", F.lit(0))
    sides = {"both": [("source_key", "target_key"), ("target_key", "source_key")], "out": [("source_key", "target_key")], "in": [("target_key", "source_key")]}[direction]
    for hop in range(1, depth + 1):
        frontier = reached.where(F.col("dist") == hop - 1).select(F.col("key").alias("_at"))
        met = reduce(DataFrame.union, [pairs.join(frontier, F.col(here) == F.col("_at"), "left_semi").select(F.col(there).alias("key")) for here, there in sides])
        new = met.distinct().join(reached, "key", "left_anti").withColumn("dist", F.lit(hop))
        reached = kept(reached.unionByName(new))
    return reached


def incident_edges(edges: DataFrame, reached: DataFrame, depth: int) -> DataFrame:
    """Edges at any key nearer than depth."""
    inner = reached.where(F.col("dist") < depth).select("key")
    return edges.join(inner, F.col("source_key") == F.col("key"), "left_semi").union(edges.join(inner, F.col("target_key") == F.col("key"), "left_semi")).distinct()


def dead_code(symbols: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Functions and methods that nothing uses and that are no entry points, by path and line."""
    used = edges.where(F.col("edge_type").isin(USES)).select(F.col("target_key").alias("key"))
    found = symbols.where(F.col("kind").isin("FUNCTION", "METHOD")).withColumn("key", F.concat(F.lit("symbol:"), "qualified_name"))
    found = found.join(used, "key", "left_anti").where(~infer.is_entrypoint(F.col("name"), F.col("path"))).withColumn("confidence", F.lit(0.62))
    found = found.orderBy("path", "line_start", "qualified_name")
    return found.limit(limit) if limit else found


def edge_bonus(edges: DataFrame) -> DataFrame:
    """key, bonus, edge_types: each edge adds its type's bonus to both of its ends."""
    bonus = reduce(lambda a, kv: F.when(F.col("edge_type") == kv[0], kv[1]).otherwise(a), EDGE_BONUS.items(), F.lit(OTHER_BONUS))
    ends = edges.select(F.explode(F.array("source_key", "target_key")).alias("key"), bonus.alias("bonus"), F.lower("edge_type").alias("edge_type"))
    return ends.groupBy("key").agg(F.sum("bonus").alias("bonus"), F.array_join(F.sort_array(F.collect_set("edge_type")), ", ").alias("edge_types"))


def weighted_degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("source_key", "target_key")).alias("key"), F.coalesce("weight", F.lit(1.0)).alias("w"))
    return ends.groupBy("key").agg(F.sum("w").alias("degree"), F.count(F.lit(1)).alias("edges"))


def stats(files: DataFrame, symbols: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """metric, value rows; each table is counted once, in parallel."""
    count = lambda df, *pairs: df.agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in pairs]).select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.coalesce(F.col(n), F.lit(0)).alias("value")) for n, _ in pairs])))
    kind = F.col("kind")
    parts = [count(files, ("files", F.lit(True))), count(symbols, ("symbols", F.lit(True)), ("classes", kind == "CLASS"), ("functions", kind == "FUNCTION"), ("methods", kind == "METHOD")), count(nodes, ("nodes", F.lit(True))), count(edges, ("edges", F.lit(True)), ("calls", F.col("edge_type") == "CALLS"))]
    return reduce(DataFrame.union, parts)


def routes(urls: DataFrame, url_col: str, method: Column | None = None) -> DataFrame:
    """urls with http_confidence and route_key of the request each stands for."""
    url = F.col(url_col)
    sure = url.startswith("http://") | url.startswith("https://") | url.startswith("/")
    verb = method if method is not None else F.lit("GET")
    path = F.regexp_extract(url, r"^(?:https?://[^/?#]+)?([^?#]*)", 1)
    return urls.withColumns({"http_confidence": F.when(sure, 0.78).otherwise(0.52), "route_key": F.concat(F.lit("route:external:"), F.upper(verb), F.lit(":"), F.regexp_replace(path, r"[^A-Za-z0-9_./:-]+", "_"))})


def last_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")
