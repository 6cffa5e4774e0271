"""Answers made of several: context for a question or a task, packs, maps, comparisons, measurements.

Each part is a DataFrame of bounded size (the first so many rows of a ranking); only texts that are rendered, and the
token estimates of what is shown, come to the driver.
"""

from __future__ import annotations

import json
import math
import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import infer
from ..functions import text as tx
from ..operators import components, explore, rank, rules, search
from ..operators.lineage import kept, kept_groups
from . import api, memory_index, reports
from .index import Index, status
from .memory_index import Memory

SNIPPET = ["path", "qualified_name", "kind", "line_start", "line_end", "score", "reason", "tokens", "code"]


# -- retrieval ----------------------------------------------------------------------


def text_search(index: Index, query: str, *, max_tokens: int = 8000, limit: int = 8) -> DataFrame:
    """Snippets of files whose text or path holds the query's terms, best first, under a token budget.

    Full-text hits (prefixes, over path, language and content) are looked at alone if there are any, else all files.
    """
    terms = tx.ranking_terms(query)
    if not terms:
        return index.files.limit(0).select("path", *[F.lit(None).cast("string").alias(c) for c in ("reason", "code")], *[F.lit(0).alias(c) for c in ("line_start", "line_end", "tokens")], F.lit(0.0).alias("score"))
    intent = infer.intent(F.lit(query))
    prefixes = tx.file_query_terms(query)
    files = index.files
    if prefixes:
        ranked = search.bm25(files, "path", ["path", "language", "content"], prefixes, prefix=True, limit=30)
        ranked = kept(ranked.select(F.col("id").alias("_id"), "rank"))
        if ranked.limit(1).count():
            files = files.join(ranked, F.col("path") == F.col("_id")).drop("_id")
    if "rank" not in files.columns:
        files = files.withColumn("rank", F.lit(None).cast("double"))
    low = F.lower("path")
    on_path = reduce(lambda a, t: a + F.when(F.contains(low, F.lit(t)), 1).otherwise(0), terms, F.lit(0))
    best = rank.best_lines(files, "path", "content", terms).withColumnRenamed("id", "_id")
    rows = files.withColumn("_p", on_path).join(best, F.col("path") == F.col("_id"), "left").fillna(0, ["hits"]).where("_p > 0 or hits > 0")
    score = 18 * F.col("_p") + 12 * F.col("hits") + F.when((F.col("_p") > 0) & (F.col("hits") > 0), 4).otherwise(0)
    score = score + F.when(F.col("rank").isNotNull(), 40 + F.least(F.lit(20.0), F.abs("rank"))).otherwise(0.0)
    score = score + F.when((intent == "test") & infer.is_test_for_ranking(low), 35).otherwise(0) + F.when((intent == "architecture") & infer.is_document(low), 30).otherwise(0)
    why = F.array_compact(F.array(F.when(F.col("rank").isNotNull(), "full-text match"), F.when(F.col("_p") > 0, "file path contains query terms"), F.when(F.col("hits") > 0, "file text contains query terms"), F.when(intent != "general", F.concat(F.lit("intent: "), intent))))
    lines = F.size(tx.split_lines(F.col("content")))
    start = F.when(F.col("best_line").isNotNull(), F.greatest(F.col("best_line") - 6, F.lit(1))).otherwise(1)
    end = F.least(lines, F.when(F.col("best_line").isNotNull(), F.col("best_line") + 8).otherwise(28))
    rows = rows.select("path", score.cast("double").alias("score"), F.array_join(why, ", ").alias("reason"), start.alias("line_start"), end.alias("line_end"), tx.line_range(F.col("content"), start, end).alias("code"))
    rows = kept(rows.withColumn("tokens", tx.estimate_tokens(F.col("code"))))
    ordered = rows.select(F.lit(0).alias("_all"), (-F.col("score")).alias("order"), "path", "tokens")
    chosen = rank.greedy_kept(ordered, "_all", ["order", "path"], "tokens", max_tokens, "path", cut_first=True).select(F.posexplode("names").alias("_n", "path")).where(F.col("_n") < limit).drop("_n")
    return rows.join(chosen, "path", "left_semi").withColumn("code", tx.trim_to_tokens(F.col("code"), max_tokens)).orderBy(F.desc("score"), "path")


def retrieve(index: Index, query: str, *, depth: int = 2, max_tokens: int = 8000) -> DataFrame:
    """Ranked snippets of symbols or, where there are none, of texts (kind FILE)."""
    code = kept(api.retrieve(index, query, depth=depth, max_tokens=max_tokens))
    if code.limit(1).count():
        return code
    texts = text_search(index, query, max_tokens=max_tokens)
    return texts.withColumns({"qualified_name": F.col("path"), "kind": F.lit("FILE")}).select(*SNIPPET)


def token_report(index: Index, snippets: DataFrame) -> DataFrame:
    """baseline_tokens (of the files in the snippets' folders), optimized_tokens, savings_percent."""
    used = snippets.agg(F.coalesce(F.sum(tx.estimate_tokens(F.col("code"))), F.lit(0)).alias("_t")).first()["_t"]
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    folders = [r[0] for r in snippets.select(folder.alias("f")).distinct().collect()]  # of a few snippets
    files = api.files_in_directories(index.files, folders)
    base = files.agg(F.coalesce(F.sum(F.ceil(F.col("size_bytes") / 4)), F.lit(0)).cast("long").alias("_b"))
    out = base.select(F.greatest("_b", F.lit(int(used))).alias("baseline_tokens"), F.lit(int(used)).cast("long").alias("optimized_tokens"))
    return out.withColumn("savings_percent", F.when(F.col("baseline_tokens") > 0, F.round((1 - F.col("optimized_tokens") / F.col("baseline_tokens")) * 100, 4)).otherwise(0.0))


# -- context ------------------------------------------------------------------------


def compressed_context(m: Memory, index: Index, query: str, *, max_tokens: int = 4000) -> dict[str, DataFrame]:
    """history, decisions, ownership, architecture, snippets, critical_files, related_changes, evidence, estimate."""
    history, decisions = kept(memory_index.history(m, query, 5)), kept(memory_index.decisions(m, query, 3))
    ownership, architecture = kept(memory_index.ownership(m, query, 3)), kept(memory_index.architecture(m, query, 4))
    snippets = kept(retrieve(index, query, depth=2, max_tokens=max_tokens))
    ids = reduce(DataFrame.union, [history.select("source_id"), decisions.select(F.explode("evidence")), ownership.select(F.explode("evidence")), architecture.select("evidence")])
    evidence = memory_index.shown(m.evidence.join(ids.where("source_id is not null").distinct(), "source_id", "left_semi"))
    told = {"history": (history, "summary"), "decisions": (decisions, "answer"), "ownership": (ownership, "developer"), "architecture": (architecture, "summary")}
    payload: dict = {name: [r[0] for r in df.select(column).collect()] for name, (df, column) in told.items()}
    first = snippets.groupBy("path").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "path")
    payload |= {"query": query, "critical_files": [r["path"] for r in first.collect()]}
    size = math.ceil(len(json.dumps(payload, sort_keys=True)) / 4)
    changes = history.where(F.col("entity_key").startswith("commit:")).select(F.regexp_replace("entity_key", "^commit:", "").alias("sha"))
    estimate = index.files.sparkSession.createDataFrame([(size,)], "estimated_tokens int")
    return {"history": history, "decisions": decisions, "ownership": ownership, "architecture": architecture, "snippets": snippets, "critical_files": first.select("path"), "related_changes": changes, "evidence": evidence, "estimate": estimate}


def context_pack(m: Memory, index: Index, task: str, current: DataFrame, changed: DataFrame, *, max_tokens: int = 6000) -> dict[str, DataFrame]:
    """The ten parts of a pack for a task; current: the tree's files, changed: path, status."""
    if not task.strip():
        raise ValueError("a pack needs a task")
    context = compressed_context(m, index, task, max_tokens=max_tokens)
    snippets = context["snippets"].limit(10).withColumn("code", tx.redact(F.col("code")))
    tests = index.files.where(infer.is_test_for_verification(F.col("path"))).select("path")
    return {
        "task": index.files.sparkSession.createDataFrame([(task.strip(),)], "task string"),
        "status": status_report(index, current),
        "recommended_files": context["critical_files"].limit(10),
        "snippets": snippets,
        "evidence": context["evidence"].limit(10),
        "ownership": context["ownership"],
        "verification": reports.verification_plan(changed, tests),
        "rule_findings": rules.findings(index.files, limit=20),
        "source_outline": api.outline(index, task.strip(), 8),
        "token_report": token_report(index, context["snippets"]),
    }


def ask(m: Memory, index: Index, question: str, *, max_tokens: int = 3000) -> dict:
    """The parts of an answer and its text; where no symbol matches the question, its words are tried in turn."""
    query = question.strip()
    if not query:
        raise ValueError("a question must not be empty")
    context = compressed_context(m, index, query, max_tokens=max_tokens)
    code = context["snippets"].collect()
    if all(r["kind"] == "FILE" for r in code):
        found: dict[str, object] = {}
        for term in tx.chat_terms(query):
            for r in retrieve(index, term, depth=2, max_tokens=max_tokens).where("kind <> 'FILE'").collect():
                found.setdefault(r["qualified_name"], r)
            if len(found) >= 5:
                break
        code = [*found.values(), *code]
    code = [r.asDict() for r in code[:5]]
    rows = {name: [r.asDict(recursive=True) for r in context[name].limit(n).collect()] for name, n in (("history", 5), ("architecture", 4), ("decisions", 3), ("ownership", 3), ("evidence", 8))}
    rows["architecture"] = [r for r in rows["architecture"] if r["confidence"] > 0]
    rows["decisions"] = [r for r in rows["decisions"] if r["confidence"] > 0]
    return {"question": query, "answer": answer_text(query, code, rows), "code": code, **rows, "token_report": token_report(index, context["snippets"]).first().asDict(), "estimated_tokens": context["estimate"].first()[0]}


def _where(r: dict) -> str:
    return f"{r['path']}:{r['line_start']}-{r['line_end']}"


def answer_text(query: str, code: list[dict], rows: dict[str, list[dict]]) -> str:
    sections = [("Code context", [f"{r['qualified_name']} in {_where(r)} ({r['reason']})" for r in code[:3]] or ["no matching symbols"])]
    sections += [("History", [f"{r['date'] or 'unknown date'}: {r['title']}" for r in rows["history"][:3]]), ("Architecture", [r["summary"] for r in rows["architecture"][:3]])]
    sections += [("Decisions", [r["answer"] for r in rows["decisions"][:2]]), ("Likely owners", [f"{r['developer']} ({r['commits']} commits, {r['files']} files)" for r in rows["ownership"][:3]])]
    return "\n\n".join([f"Question: {query}", *[f"{name}:\n" + "\n".join(f"- {x}" for x in items) for name, items in sections if items]])


def agent_context(m: Memory, index: Index, task: str, *, max_tokens: int = 5000) -> dict:
    """Files, snippets, evidence and owners for a task, and the same as markdown."""
    if not task.strip():
        raise ValueError("a task must not be empty")
    context = compressed_context(m, index, task.strip(), max_tokens=max_tokens)
    take = lambda name, n: [r.asDict(recursive=True) for r in context[name].limit(n).collect()]
    code, evidence, owners = take("snippets", 8), take("evidence", 8), take("ownership", 5)
    report = token_report(index, context["snippets"]).first().asDict()
    lines = [f"# Context for: {task.strip()}", "", "## Files", *([f"- {_where(r)} {r['qualified_name']} ({r['reason']})" for r in code] or ["- none found"]), "", "## Snippets"]
    for r in code[:5]:
        lines += [f"### {r['qualified_name']} ({_where(r)})", "```" + ("python" if r["path"].endswith(".py") else ""), r["code"], "```"]
    lines += ["", "## Evidence", *([f"- {r['source_type']} {r['path'] or r['source_id'][:12]}: {r['title']}" for r in evidence] or ["- none found"])]
    lines += ["", "## Owners", *([f"- {r['developer']}: {r['commits']} commits, {r['files']} files" for r in owners] or ["- none found"])]
    lines += ["", "## Tokens", f"- {report['optimized_tokens']} of {report['baseline_tokens']} ({report['savings_percent']:.0f}% saved)"]
    return {"task": task.strip(), "code": code, "evidence": evidence, "ownership": owners, "token_report": report, "markdown": "\n".join(lines)}


# -- status, inventories, maps --------------------------------------------------------


def status_report(index: Index, current: DataFrame) -> DataFrame:
    """metric, value: what the tree has changed since the index, and the index's sizes."""
    state = kept(status(index.files.select("path", "sha256"), current.select("path", "sha256")))
    of = lambda name, kind: state.where(F.col("status") == kind).agg(F.lit(name).alias("metric"), F.count(F.lit(1)).alias("value"))
    size = lambda name, df: df.agg(F.lit(name).alias("metric"), F.count(F.lit(1)).alias("value"))
    stale = state.agg(F.lit("stale").alias("metric"), F.max(F.when(F.col("status") != "clean", 1).otherwise(0)).cast("long").alias("value"))
    return reduce(DataFrame.union, [of("dirty_files", "dirty"), of("new_files", "new"), of("deleted_files", "deleted"), stale, size("files_indexed", index.files), size("symbols", index.symbols), size("graph_nodes", index.nodes), size("graph_edges", index.edges), size("parser_errors", index.errors)])


def file_inventory(files: DataFrame) -> DataFrame:
    return files.select("path", infer.component(F.col("path")).alias("component"), F.coalesce("language", F.lit("")).alias("language"), F.col("line_count").cast("long").alias("lines"), "size_bytes").orderBy("path")


def symbol_inventory(symbols: DataFrame) -> DataFrame:
    return symbols.select("name", "qualified_name", "kind", "module", F.col("path").alias("file_path"), infer.component(F.col("path")).alias("component"), "line_start", "line_end", F.coalesce("signature", F.lit("")).alias("signature")).orderBy("qualified_name", "file_path")


def commit_inventory(evidence: DataFrame | Memory, limit: int = 2000) -> DataFrame:
    """Newest commits first."""
    rows = memory_index.newest_commits(Memory(evidence, None, None) if isinstance(evidence, DataFrame) else evidence, limit)
    return rows.select(F.col("source_id").alias("sha"), F.substring("source_id", 1, 12).alias("short_sha"), "title", F.coalesce("author", F.lit("Unknown")).alias("author"), F.coalesce("ts", F.lit("")).alias("timestamp"), F.size("files").alias("files"), F.coalesce("risk", F.lit("low")).alias("risk"), F.coalesce("impact", F.lit("low")).alias("impact"))


def cochange_edges(m: Memory) -> DataFrame:
    """Edges of components whose files changed together, as component_graph() takes them."""
    key = lambda path: F.concat(F.lit("file:"), path)
    pairs = memory_index.cochanged(memory_index.commits_of(m))
    links = pairs.select(F.col("a_component").alias("source_component"), F.col("b_component").alias("target_component"), F.lit("cochange").alias("edge_type"), F.concat_ws("|", key("a"), key("b"), "sha").alias("example"), F.substring("sha", 1, 12).alias("reason"))
    return components.component_edges(links)


def code_edges(index: Index) -> DataFrame:
    """Edges of components whose code uses each other's, as component_graph() takes them."""
    return components.component_edges(explore.component_links(api.wide_edges(index)))


def component_graph(index: Index, m: Memory, newest: int = 2000, *, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of components: of code, of the newest commits, and of files that changed together.

    edges: code_edges(index) and cochange_edges(m), if they are kept already: nodes read their ends, too.
    """
    placed = lambda df: df.withColumn("component", infer.component(F.col("path")))
    recent = memory_index.commits_of(m).orderBy(F.desc(F.coalesce("ts", F.lit(""))), F.desc("sha")).limit(newest)
    touched = recent.select("author", F.explode("files").alias("path"))
    nodes = components.component_nodes(placed(index.files), placed(index.symbols), placed(touched))
    edges = code_edges(index).unionByName(cochange_edges(m)) if edges is None else edges
    outside = edges.select(F.explode(F.array("source", "target")).alias("component")).distinct().join(nodes, "component", "left_anti")
    tags = F.when(F.col("is_service"), F.array(F.lit("service"))).otherwise(F.array().cast("array<string>"))
    known = nodes.select(F.col("component").alias("id"), F.col("component").alias("label"), F.lit("component").alias("type"), tags.alias("tags"), "risk", "size", "files", "lines", "symbols", "classes", "functions", "methods", "commits", "authors")
    empty = {c: F.lit(0).cast("long") for c in ("files", "lines", "symbols", "classes", "functions", "methods", "commits", "authors")}
    external = outside.select(F.col("component").alias("id"), F.col("component").alias("label"), F.lit("external").alias("type"), F.array(F.lit("external")).alias("tags"), F.lit("low").alias("risk"), F.lit(12).cast("long").alias("size"), *[v.alias(k) for k, v in empty.items()])
    edges = edges.withColumnRenamed("edge_type", "type").withColumn("edge_id", F.concat_ws("|", "source", "target", F.upper("type")))
    return known.unionByName(external), edges


def component_graphs(indexes: list[Index], m: Memory) -> list[dict[str, DataFrame]]:
    """nodes and edges of component_graph() of each index, kept; what the memory alone tells is made once for all."""
    together = kept_groups(cochange_edges(m))
    graphs = [component_graph(index, m, edges=together.unionByName(kept_groups(code_edges(index)))) for index in indexes]
    return [{"nodes": kept(nodes), "edges": edges} for nodes, edges in graphs]


def build_map(index: Index, m: Memory, **about) -> dict[str, DataFrame]:
    """nodes, edges, commit_graph, files, symbols, commits, stats, diagnostics of a repository."""
    nodes, edges = component_graphs([index], m)[0].values()
    history = memory_index.commits_of(m)
    commits = history.select("sha", "author", "ts")
    touched = history.select("sha", F.explode("files").alias("path")).withColumn("component", infer.component(F.col("path")))
    sizes = {"files": index.files, "symbols": index.symbols, "components": nodes, "component_edges": edges, "commits": commits}
    stats = kept(reduce(DataFrame.union, [df.agg(F.lit(name).alias("metric"), F.count(F.lit(1)).alias("value")) for name, df in sizes.items()]))
    counted = {r["metric"]: r["value"] for r in stats.collect()}
    return {
        "nodes": nodes, "edges": edges, "commit_graph": reports.commit_graph(commits, touched), "files": file_inventory(index.files), "symbols": symbol_inventory(index.symbols), "commits": commit_inventory(m), "stats": stats,
        "diagnostics": api.diagnostics(index, component_edges=counted["component_edges"], components=counted["components"], **about),
    }


METRICS = ["files", "lines", "symbols", "classes", "functions", "methods", "commits", "authors"]


def build_compare(base: dict[str, DataFrame], head: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Both maps' nodes and edges with change, merged nodes, what a node's metrics went from and to, and counts of changes."""
    b_nodes, h_nodes, node_counts = explore.annotated(base["nodes"], head["nodes"], "id", explore.node_signature(metrics=METRICS))
    listed = lambda df: df.withColumn("_shown", F.split(F.coalesce("examples", F.lit("")), r"\|"))
    b_edges, h_edges, edge_counts = explore.annotated(listed(base["edges"]), listed(head["edges"]), "edge_id", explore.edge_signature("_shown"))
    summary = node_counts.select(F.lit("nodes").alias("part"), "change", "n").union(edge_counts.select(F.lit("edges"), "change", "n"))
    return {"base_nodes": b_nodes, "head_nodes": h_nodes, "base_edges": b_edges.drop("_shown"), "head_edges": h_edges.drop("_shown"), "merged": explore.merged_nodes(b_nodes, h_nodes), "deltas": explore.delta_lines(base["nodes"], head["nodes"], ["size", *METRICS]), "summary": summary}


def benchmark(make, query: str | None = None) -> dict:
    """Seconds and sizes of building an index (make()) and of a retrieval from it."""
    began = time.perf_counter()
    index = make()
    files, symbols = index.files.count(), index.symbols.count()
    indexed = time.perf_counter() - began
    first = api.all_symbols(index).limit(1).collect()
    asked = query or (first[0]["name"] if first else "")
    began = time.perf_counter()
    reached = api.neighborhood(index, asked, 2).count() if asked else 0
    walked = time.perf_counter() - began
    began = time.perf_counter()
    found = retrieve(index, asked).collect() if asked else []
    took = time.perf_counter() - began
    exact = sum(r["qualified_name"].rpartition(".")[2] == asked for r in found)
    label = "not measured: no symbols" if not asked else f"{len(found)} snippets returned, {exact} exact symbol matches" if found else "0 matched snippets"
    return {"files_scanned": files, "symbols": symbols, "indexing_seconds": indexed, "traversal_seconds": walked, "keys_reached": reached, "retrieval_seconds": took, "files_returned": len({r["path"] for r in found}), "accuracy": label, "query": asked}

