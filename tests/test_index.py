"""A small repository, from files and git to answers."""

import json
import os
import random
import re
import subprocess

import pytest
from pyspark.sql import functions as F

from seamline.functions import infer, text as tx
from seamline.operators import compare, components, graph, memory, rank, rules, search
from seamline.plans import adapters, api, catalog as queries, index as plan
from seamline.sources import artifacts, external, gitlog, parsers, scan
from seamline.streaming import watch

FILES = {
    "app/__init__.py": "",
    "app/payments.py": 'class PaymentService:\n    """Takes payments."""\n\n    def charge(self, total):\n        return total\n',
    "app/orders.py": "from app.payments import PaymentService\n\n\n@service\nclass OrderService:\n    def create_order(self, total):\n        processor = PaymentService()\n        return processor.charge(total)\n",
    "app/api.py": "@app.get('/orders')\ndef list_orders():\n    return client.get('https://example.com/items')\n\n\ndef unused_helper():\n    return 1\n",
    "app/broken.py": "def f(:\n",
    "web/client.ts": "import { api as call } from './api'\n\nclass Client extends Base {\n  load(id) {\n    return fetchOrders(id)\n  }\n}\n\nconst go = async (x) => {\n  return helper(x)\n}\n\nrouter.get('/items', go)\n",
    "node_modules/ignored.py": "x = 1\n",
    "docs/adr/0001-cache.md": "# Use a cache\n\nBecause of retries.\n",
    "README.md": "# Shop\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("shop")
    for path, content in FILES.items():
        os.makedirs(os.path.dirname(base / path), exist_ok=True)
        (base / path).write_text(content)
    return str(base)


@pytest.fixture(scope="module")
def index(spark, root, tmp_path_factory):
    files = scan.source_files(spark, root).cache()
    return plan.saved(plan.build(files, parsers.parse_files(files).cache()), str(tmp_path_factory.mktemp("index")))


def names(df, column):
    return sorted(r[0] for r in df.select(column).collect())


def test_scan(spark, root):
    rows = {r.path: r for r in scan.source_files(spark, root).collect()}
    assert sorted(rows) == sorted(p for p in FILES if p.endswith((".py", ".ts")) and "node_modules" not in p)
    assert rows["app/payments.py"].line_count == 5 and rows["app/__init__.py"].line_count == 0
    assert names(scan.source_files(spark, root, ignore_globs=["app/*"]), "path") == ["web/client.ts"]
    docs = {r.path: r.title for r in scan.document_files(spark, root).collect()}
    assert docs == {"docs/adr/0001-cache.md": "Use a cache", "README.md": "Shop"}


def test_symbols_calls_and_edges(index):
    found = names(index.symbols, "qualified_name")
    assert {"app.payments.PaymentService", "app.payments.PaymentService.charge", "app.orders.OrderService.create_order", "web.client.Client.load", "web.client.go", "web.client.route_get_items"} <= set(found)
    calls = {(r.target, r.display, tuple(r.arguments)) for r in index.calls.where("path = 'app/orders.py'").collect()}
    assert calls == {("PaymentService", "PaymentService", ()), ("charge", "processor.charge", ("total",))}
    edges = {(r.source_key, r.edge_type, r.target_key) for r in index.edges.collect()}
    assert ("symbol:app.orders.OrderService.create_order", "CALLS", "symbol:app.payments.PaymentService") in edges
    assert ("symbol:app.orders.OrderService.create_order", "CALLS", "symbol:app.payments.PaymentService.charge") in edges
    assert ("route:app.api.list_orders", "HANDLES", "symbol:app.api.list_orders") in edges
    assert any(s == "symbol:app.api.list_orders" and t == "HTTP_CALLS" for s, t, _ in edges)
    assert names(index.errors, "path") == ["app/broken.py"]


def test_queries_on_the_index(index):
    assert "symbol:app.orders.OrderService.create_order" in names(api.structural_query(index, "callers:charge"), "source_key")
    assert "symbol:app.payments.PaymentService.charge" in names(api.structural_query(index, "calls:create_order"), "target_key")
    assert names(api.structural_query(index, "imports:payments"), "module") == ["app.payments"]
    assert names(api.structural_query(index, "route:orders"), "label") == ["GET /orders"]
    assert "app.api.unused_helper" in names(api.structural_query(index, "dead:"), "qualified_name")
    assert api.structural_query(index, "http:example").count() == 1
    assert sorted(names(api.structural_query(index, "http:"), "edge_type")) == ["HANDLES", "HANDLES", "HTTP_CALLS"]
    assert names(api.structural_query(index, "create_order"), "name") == ["create_order"]
    snippets = api.retrieve(index, "create_order").collect()
    assert snippets[0].qualified_name == "app.orders.OrderService.create_order" and "processor.charge" in snippets[0].code
    assert any(s.qualified_name == "app.payments.PaymentService" for s in snippets)
    assert api.retrieve(index, "create_order", max_tokens=3).count() == 1
    assert api.outline(index, "orders").count() >= 1 and api.neighborhood(index, "charge").count() > 1
    assert {r.metric: r.value for r in api.diagnostics(index).collect()}["parse_errors"] == 1
    assert api.explain(index, "charge").first().callers == ["symbol:app.orders.OrderService.create_order"]


def test_tokens_and_text(spark):
    row = spark.createDataFrame([("abcd", "abcde", "", "a\nb\n")], "a string, b string, c string, d string")
    got = row.select(tx.estimate_tokens(F.col("a")), tx.estimate_tokens(F.col("b")), tx.estimate_tokens(F.col("c")), tx.line_count(F.col("d")), tx.split_lines(F.col("d")), tx.line_range(F.col("d"), 2, 9)).first()
    assert list(got) == [1, 2, 0, 2, ["a", "b"], "b"]
    assert tx.file_query_terms("how to find the Auth-Service/login.py") == ["find", "auth", "service", "login"]
    assert tx.ranking_terms("auth-flow in my_module") == ["auth-flow", "module"]
    assert tx.evidence_terms("Auth.py a b/c") == ["auth.py", "b/c"]
    assert tx.chat_terms("where is PaymentService used by orders")[0] == "PaymentService"


def test_rules(spark):
    lines = "API_KEY = 'abcd1234efgh'\npassword = 'CHANGE_ME_NOW'\nrequests.get(url)\nrequests.get(url, timeout=3)\neval(x)\n"
    files = spark.createDataFrame([("app/s.py", "python", lines), ("tests/test_s.py", "python", "eval(x)\n"), ("none.py", "python", None)], "path string, language string, content string")
    got = [(r.path, r.line_number, r.rule, r.severity) for r in rules.findings(files).collect()]
    assert got == [("app/s.py", 1, "possible-secret", "high"), ("app/s.py", 3, "python-requests-without-timeout", "medium"), ("app/s.py", 5, "dynamic-code-execution", "high"), ("tests/test_s.py", 1, "dynamic-code-execution", "medium")]
    assert "abcd1234" not in rules.findings(files).first().code
    config = rules.RuleConfig(suppressions=[{"rule": "*", "path": "app/*"}], tests_lower=False)
    assert [(r.path, r.severity) for r in rules.findings(files, config=config).collect()] == [("tests/test_s.py", "high")]


def test_git(spark, tmp_path):
    def git(*args, when="2024-01-01T12:00:00+00:00", who="Alice"):
        env = os.environ | {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when, "GIT_AUTHOR_NAME": who, "GIT_AUTHOR_EMAIL": "x@example.com", "GIT_COMMITTER_NAME": who, "GIT_COMMITTER_EMAIL": "x@example.com"}
        subprocess.run(["git", "-C", str(tmp_path), *args], check=True, env=env, capture_output=True)

    assert gitlog.commits(spark, str(tmp_path)).count() == 0
    git("init")
    (tmp_path / "a.py").write_text("x = 1\n")
    git("add", "."), git("commit", "-m", "Add payment service")
    (tmp_path / "b.py").write_text("y = 1\n")
    git("add", "."), git("commit", "-m", "Introduce Redis cache (#12)", who="Bob", when="2025-02-01T12:00:00+00:00")
    rows = gitlog.commits(spark, str(tmp_path)).collect()
    assert [(r.author, r.subject, r.files) for r in rows] == [("Alice", "Add payment service", ["a.py"]), ("Bob", "Introduce Redis cache (#12)", ["b.py"])]
    (tmp_path / "a.py").write_text("x = 2\n")
    (tmp_path / "c.py").write_text("")
    assert {tuple(r) for r in gitlog.changed_files(spark, str(tmp_path)).collect()} == {("a.py", "M"), ("c.py", "A")}
    gitlog.snapshot(str(tmp_path), "HEAD~1", str(tmp_path / "old"))
    assert os.listdir(tmp_path / "old") == ["a.py"]
    df = spark.createDataFrame([(r.subject, r.files) for r in rows], "subject string, files array<string>")
    got = df.select(infer.purpose(F.col("subject")), infer.pull_request(F.col("subject")), infer.risk_level(F.col("subject"), F.col("files")), infer.feature_terms(F.col("subject"))).collect()
    assert list(got[1]) == ["Introduced Redis cache (#12)", 12, "medium", ["cache", "redis"]] and got[0][2] == "high"


def test_external_indexes(spark, tmp_path):
    generic = {"symbols": [{"qualified_name": "m.f", "name": "f", "kind": "function", "file_path": "m.py", "line_start": 3}], "edges": [{"source": "m.f", "target": "m.g", "type": "calls"}]}
    (tmp_path / "g.json").write_text(json.dumps(generic))
    raw = external.read(spark, str(tmp_path / "g.json"))
    assert [tuple(r)[:3] for r in external.symbols(raw).select("qualified_name", "name", "kind").collect()] == [("m.f", "f", "FUNCTION")]
    assert [tuple(r) for r in external.edges(raw).collect()] == [("m.f", "m.g", "CALLS")]
    scip = {"documents": [{"relative_path": "a.py", "language": "python", "symbols": [{"symbol": "pkg/A#run().", "kind": "Method", "relationships": [{"symbol": "pkg/B#", "type": "inheritance"}]}], "occurrences": [{"symbol": "pkg/C#", "symbol_roles": 1, "range": [4, 2, 9]}]}]}
    (tmp_path / "s.json").write_text(json.dumps(scip))
    raw = external.read(spark, str(tmp_path / "s.json"))
    got = {r.qualified_name: (r.name, r.kind, r.line_start, r.line_end) for r in external.symbols(raw).collect()}
    assert got["pkg/C#"] == ("C", "FUNCTION", 5, 10) and got["pkg/A#run()."][1] == "METHOD"
    assert external.edges(raw).first().edge_type == "INHERITS"


def test_maintenance(spark):
    writes = spark.createDataFrame([("k", "MODULE", "a", "{}", "p.py", 1, 1), ("k", "MODULE", "b", '{"external":true}', None, None, 2)], "key string, type string, label string, metadata string, file_path string, symbol_id long, write_seq long")
    row = graph.upsert_nodes(writes).first()
    assert (row.label, row.file_path, row.symbol_id) == ("b", "p.py", 1)
    edges = spark.createDataFrame([("a", "b", "CALLS", "{}", 1.0, 1), ("a", "b", "CALLS", "{}", 5.0, 2)], "source_key string, target_key string, edge_type string, metadata string, weight double, write_seq long")
    assert graph.insert_edges(edges).first().weight == 1.0
    nodes = spark.createDataFrame([("a", "x.py"), ("b", "y.py"), ("c", "y.py")], "key string, file_path string")
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c")], "source_key string, target_key string")
    kept, left = graph.delete_files(nodes, links, spark.createDataFrame([("y.py",)], "path string"), spark.createDataFrame([("b",)], "key string"))
    assert names(kept, "key") == ["a"] and [tuple(r) for r in left.select("source_key", "target_key").collect()] == [("a", "b")]
    old, new = (spark.createDataFrame(x, "path string, sha256 string") for x in ([("a", "1"), ("b", "1"), ("c", "1")], [("a", "1"), ("b", "2"), ("d", "1")]))
    assert dict(compare.changed_files(old, new).collect()) == {"a": "clean", "b": "dirty", "c": "deleted", "d": "new"}
    entities = spark.createDataFrame([("e", "x", 0.9, 1), ("e", "y", 0.5, 2)], "key string, name string, confidence double, write_seq long")
    row = graph.upsert_entities(entities).first()
    assert (row.name, row.confidence) == ("y", 0.9)


@pytest.mark.parametrize("seed", range(3))
def test_traverse_against_python(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(40)]
    want, frontier = {"n0": 0}, ["n0"]
    for hop in (1, 2, 3):
        frontier = [b for x, y in pairs for a, b in ((x, y), (y, x)) if a in frontier and b not in want]
        want |= {b: hop for b in frontier}
    edges = spark.createDataFrame(pairs, "source_key string, target_key string")
    got = dict(graph.traverse(edges, spark.createDataFrame([("n0",)], "key string"), 3).collect())
    assert got == want


def test_budgets(spark):
    rows = spark.createDataFrame([("q", 1, 50), ("q", 2, 60), ("q", 3, 40)], "q string, rank int, cost int")
    assert tuple(rank.greedy_budget(rows, "q", ["rank"], "cost", 100).first()) == ("q", 2, 90)
    nodes = spark.createDataFrame([(x, 0, 0, 0, 0, 0) for x in "abcd"], "id string, size int, functions int, methods int, classes int, files int")
    edges = spark.createDataFrame([("e1", "a", "b", "calls", 5), ("e2", "b", "c", "calls", 1), ("e3", "c", "d", "calls", 1)], "edge_id string, source string, target string, type string, weight int")
    assert names(components.budget_by_edges(nodes, edges, 2), "id") == ["a", "b"]
    assert names(components.budget_by_nodes(nodes, edges, 2), "id") == ["a", "b"]


def test_budget_behind_many_edges(spark):
    nodes = spark.createDataFrame([(x, 0, 0, 0, 0, 0) for x in "abcdefz"], "id string, size int, functions int, methods int, classes int, files int")
    rows = [(f"e{i:04}", "a", "b", "calls", 9) for i in range(700)] + [(f"f{i:04}", "d", "e", "calls", 8) for i in range(700)] + [("g", "a", "z", "calls", 1)]
    edges = spark.createDataFrame(rows, "edge_id string, source string, target string, type string, weight int")
    assert names(components.budget_by_edges(nodes, edges, 3), "id") == ["a", "b", "z"]


def test_related_tests_and_entities(spark):
    changed = spark.createDataFrame([("app/auth.py",), ("tests/test_x.py",)], "path string")
    tests = spark.createDataFrame([("tests/test_auth.py",), ("tests/app/test_auth_flow.py",), ("other/test_z.py",)], "path string")
    got = [(r.path, r.test, r.score) for r in memory.related_tests(changed, tests).orderBy("path", "rank").collect()]
    assert got == [("app/auth.py", "tests/test_auth.py", 8), ("app/auth.py", "tests/app/test_auth_flow.py", 4), ("tests/test_x.py", "tests/test_x.py", 0)]
    commits = spark.createDataFrame([("s1", "Bob", "Add redis cache (#7)", ["app/auth.py"])], "sha string, author string, subject string, files array<string>")
    keys = names(memory.entities_of_commits(commits), "key")
    assert keys == ["commit:s1", "developer:Bob", "feature:cache", "feature:redis", "file:app/auth.py", "module:auth.py", "pull_request:7"]
    found = search.search_entities(memory.entities_of_commits(commits).withColumns({"summary": F.lit(""), "updated_at": F.lit("")}), "redis")
    assert names(found, "name") == ["redis"]


def related_by_force(paths, tests, k=8):
    def parts(p):
        name = p.split("/")[-1]
        root = p.split("/")[0]
        return name.rsplit(".", 1)[0].removeprefix("test_").removesuffix("_test"), p.split("/")[1] if root in infer.SOURCE_ROOTS and "/" in p else root, p.split("/")[-2] if "/" in p else ""

    for p in paths:
        (stem, component, folder), found = parts(p), []
        for t in tests:
            s, c, _ = parts(t)
            score = 5 * (s == stem) + 3 * (stem != "" and stem in s) + 2 * (c == component) + (folder != "" and folder in t.split("/"))
            found += [(-score, t)] * (score > 0)
        yield from ((p, t, -score, rank) for rank, (score, t) in enumerate(sorted(found)[:k], 1))


def test_related_tests_of_a_hot_component(spark):
    rng = random.Random(4)
    paths = sorted({f"src/{rng.choice('xxxy')}/{rng.choice('pqr')}/{rng.choice('abc')}_{rng.choice('abc')}.py" for _ in range(40)} | {"src/x/p/a.py"})
    tests = sorted({f"{rng.choice(['src/x', 'src/x', 'src/y', 'tests'])}/{rng.choice('pqr')}/{'_'.join(rng.choices('abcd', k=rng.randrange(1, 4)))}_{i}_test.py" for i in range(150)} | {f"src/{x}/p/{y}_test.py" for x in "xy" for y in ("a", "a_b", "c_a_b")})
    one = lambda values: spark.createDataFrame([(v,) for v in values], "path string")
    got = memory.related_tests(one(paths), one(tests)).select("path", "test", "score", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(related_by_force(paths, tests))


def test_related_tests_of_every_file(spark):
    data = "/root/testdata/sf0.001"
    files = [r.path for r in adapters.files(spark, data).collect()]
    tests = [p for p in files if p.endswith("_test.py")]
    want = list(related_by_force([p for p in files if p not in set(tests)], tests))
    got = queries.QUERIES["related_tests"](spark, data).select("path", "test", "score", "rank").collect()
    assert {r.path for r in got} == {w[0] for w in want}
    assert sorted(map(tuple, got)) == sorted(want)


def test_stems_inside_words(spark):
    paths = ["src/user.py", "lib/api.py", "a/.x"]
    tests = ["tests/test_users.py", "tests/test_apigateway.py", "tests/superuser_test.py", "tests/test_.py", "tests/other_test.py"]
    one = lambda values: spark.createDataFrame([(v,) for v in values], "path string")
    got = memory.related_tests(one(paths), one(tests)).select("path", "test", "score").collect()
    assert sorted(map(tuple, got)) == [("a/.x", "tests/test_.py", 5), ("lib/api.py", "tests/test_apigateway.py", 3), ("src/user.py", "tests/superuser_test.py", 3), ("src/user.py", "tests/test_users.py", 3)]


def terms_by_force(text):
    words = set(re.findall(r"[a-z][a-z0-9_]{3,}", text.lower())) - set(infer.PLAIN_WORDS)
    return {t for t in infer.ARCHITECTURE_TERMS if t in text.lower()} | {w.replace("_", " ") for w in words if w.endswith(("ing", "tion")) or w in infer.ARCHITECTURE_TERMS}


def features_by_force(commits):
    spaced = lambda p: re.sub("[-_]", " ", p)
    return {t for subject, files in commits for text in [subject, *(spaced(part) for f in files for part in f.split("/"))] for t in terms_by_force(text)}


def test_features_of_subjects_and_paths(spark):
    rows = [("s1", "Bob", "Add cache", ["app/user_auth.py", "lib/rate-limiting/x.py"]), ("s2", "Al", "Tune caching", ["src/data_migration/kafka.ts"]), ("s3", "Al", "Drop", [])]
    commits = spark.createDataFrame(rows, "sha string, author string, subject string, files array<string>")
    got = names(memory.entities_of_commits(commits, path_features=True).where("kind = 'feature'"), "name")
    assert got == sorted(features_by_force([r[2:] for r in rows])) == ["auth", "cache", "caching", "kafka", "limiting", "migration"]


def test_commit_entities_of_every_kind(spark):
    data = "/root/testdata/sf0.001"
    subjects, paths = [r.subject for r in adapters.commits(spark, data).collect()], [r.path for r in adapters.commit_files(spark, data).select("path").distinct().collect()]
    got = queries.QUERIES["commit_entities"](spark, data).where("kind = 'feature'")
    assert names(got, "name") == sorted(features_by_force([*((s, []) for s in subjects), ("", paths)]))


def test_dead_code_minds_light_edges(spark):
    data = "/root/testdata/sf0.001"
    used = {r.target_key for r in adapters.edges(spark, data).where("edge_type in ('CALLS', 'REFERENCES')").collect()}
    want = sorted(r.qualified_name for r in adapters.symbols(spark, data).where("kind <> 'CLASS'").where(~infer.is_entrypoint(F.col("name"), F.col("path"))).collect() if f"symbol:{r.qualified_name}" not in used)
    assert names(queries.QUERIES["dead_code"](spark, data), "qualified_name") == want


def test_rule_findings_of_every_rule(spark, tmp_path):
    lines = ["api_key = 'abcd1234efgh'", "requests.get(url)", "subprocess.run(x, shell=True)", "eval(x)", "execute(f'select')", "fetch(url)", "fetch(url, {signal})"]
    spark.createDataFrame([(1, "\n".join(lines), "en", "web")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.line_number, r.rule) for r in queries.QUERIES["rule_findings"](spark, str(tmp_path)).orderBy("line_number").collect()]
    assert got == [(1, "possible-secret"), (2, "python-requests-without-timeout"), (3, "shell-true"), (4, "dynamic-code-execution"), (5, "sql-string-interpolation"), (6, "fetch-without-abort")]


def test_artifacts(spark, tmp_path):
    artifacts.export_tables({"t": spark.range(3).toDF("x")}, str(tmp_path / "a"))
    assert artifacts.import_tables(spark, str(tmp_path / "a"), ["t"])["t"].count() == 3
    assert artifacts.cache_key("f", "n", {"a": 1}) != artifacts.cache_key("g", "n", {"a": 1})


def test_watch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text("x = 1\n")
    (tmp_path / "in" / "a.txt").write_text("x\n")
    seen = []
    events = watch.relevant(watch.source_events(spark, str(tmp_path / "in")))
    watch.watch(events, lambda batch, n: seen.extend(r.path for r in batch.collect()), str(tmp_path / "ck"), once=True).awaitTermination(60)
    assert [os.path.basename(p) for p in seen] == ["a.py"]


def test_scan_lists_below_two_levels_in_tasks(spark, tmp_path):
    paths = ["a.py", "x/b.py", "x/y/c.py", "x/y/z/w/d.py", "x/_hidden/.e.py", "node_modules/q/r/f.py", "u/v/w/é.py"]
    for p in paths:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    (tmp_path / "x" / "link.py").symlink_to(tmp_path / "a.py")
    rows = {r.path: r.content for r in scan.source_files(spark, "file://" + str(tmp_path)).collect()}
    assert rows == {p: p for p in paths if "node_modules" not in p}
    assert names(scan.source_files(spark, str(tmp_path)), "path") == sorted(rows)
    (tmp_path / "empty").mkdir()
    assert scan.source_files(spark, str(tmp_path / "empty")).count() == 0


@pytest.mark.parametrize("cut_first", [False, True])
def test_greedy_budget_in_rounds(spark, cut_first):
    rng = random.Random(3)
    rows = [(g, i, rng.choice([0, 1, 2, 5, 9, 30, 60]), f"n{i}") for g in range(6) for i in rng.sample(range(100), rng.randrange(1, 60))]
    want = {}
    for g in range(6):
        used, names, free = 0, [], 0
        for _, i, cost, name in sorted(r for r in rows if r[0] == g):
            if cost == 0:
                free += 1
            elif used + cost <= 40 or (cut_first and not names and cost > 40):
                used, names = min(40, used + cost), names + [name]
        want[g] = (len(names) + free, used, names)
    df = spark.createDataFrame(rows, "g int, i int, cost int, name string").repartition(3)
    got = rank.greedy_kept(df, "g", ["i"], "cost", 40, "name", cut_first=cut_first, chunk=4)
    assert {r.g: (r.kept, r.used, r.names) for r in got.collect()} == want


def test_resolution_prefers_module_then_length(spark):
    symbols = spark.createDataFrame([("run", "a.b.run", "a.b"), ("run", "c.run", "c"), ("go", "x.y.Thing.go", "x.y"), ("load", "zz.load", "zz")], "name string, qualified_name string, module string")
    refs = spark.createDataFrame([(1, "run", "a.b"), (2, "run", "q"), (3, "Thing.go", "q"), (4, "none", "q"), (5, "run", None), (6, "c.run", "a.b")], "ref_id int, name string, source_module string")
    got = {r.ref_id: r.qualified_name for r in search.resolve(refs, symbols).collect()}
    assert got == {1: "a.b.run", 2: "c.run", 3: "x.y.Thing.go", 4: None, 5: "c.run", 6: "c.run"}
    many = spark.createDataFrame([("n", f"m{'x' * i}.k.n{i}.end", "far" if i == 20 else "m") for i in range(30)], "name string, qualified_name string, module string")
    one = spark.createDataFrame([(1, "end", "far")], "ref_id int, name string, source_module string")
    assert search.resolve(one, many).first().qualified_name == "m.k.n0.end"  # the module's own is not among the ten shortest


def test_artifacts_are_checked(spark, tmp_path):
    table = spark.createDataFrame([(i, {"a": str(i)}) for i in range(20)], "i int, m map<string,string>")
    path = str(tmp_path / "out")
    artifacts.export_index({"t": table}, path)
    assert artifacts.import_index(spark, path, ["t"])["t"].count() == 20
    into = str(tmp_path / "in")
    assert artifacts.import_index(spark, path, ["t"], into)["t"].count() == 20
    with pytest.raises(FileExistsError):
        artifacts.import_index(spark, path, ["t"], into)
    assert artifacts.import_index(spark, path, ["t"], into, overwrite=True)["t"].count() == 20
    table.limit(19).write.mode("overwrite").parquet(f"{path}/t")
    with pytest.raises(ValueError):
        artifacts.import_index(spark, path, ["t"])
    with pytest.raises(FileNotFoundError):
        artifacts.import_index(spark, str(tmp_path / "nothing"), ["t"])


def test_streamed_batches_are_taken_once(spark, index, tmp_path):
    from seamline.streaming import index as stream

    folder = str(tmp_path / "followed")
    stream.begin(index, folder)
    change = spark.createDataFrame([("app/new.py", "python", "def fresh():\n    return charge(1)\n", 0), ("app/api.py", "python", None, 1)], stream.CHANGE)
    for _ in range(2):
        stream.take(spark, folder, change, 0)
    now = stream.current(spark, folder)
    assert "app.new.fresh" in names(now.symbols, "qualified_name") and "app/api.py" not in names(now.files, "path")
    assert artifacts.read_json(spark, f"{folder}/current.json") == {"version": 1, "batch": 0}
    found = {(r.source_key, r.target_key) for r in now.edges.where("edge_type = 'CALLS'").collect()}
    assert ("symbol:app.new.fresh", "symbol:app.payments.PaymentService.charge") in found
    assert not any("app.api" in s for s, _ in found)


def test_classification_moves_packages(tmp_path):
    from seamline import config

    (tmp_path / ".repolens.json").write_text(json.dumps({"classification": {"owned_prefixes": ["Six", "a"]}, "other": 1}))
    assert config.classify(str(tmp_path), "six", "third-party").classification.third_party_packages == ("six",)
    raw = json.loads((tmp_path / ".repolens.json").read_text())
    assert raw["other"] == 1 and raw["classification"]["owned_prefixes"] == ["a"]
    assert config.restore_classification(str(tmp_path), {"hide_packages": ["b", "B", " "]}).classification.hide_packages == ("b",)
    for bad in (("", "owned"), ("x", "nothing")):
        with pytest.raises(ValueError):
            config.classify(str(tmp_path), *bad)
