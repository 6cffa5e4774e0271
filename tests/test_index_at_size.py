"""How often an index's plans read, spread and sort their rows, and that what they leave out changes no result."""

import ast

from pyspark.sql import functions as F

from seamline.operators import search
from seamline.plans import api, code_tables, index
from seamline.sources import parsers

DATA = "/root/testdata/sf0.001"
FILES = [("a.py", "python", "import os\ndef f():\n    return g() + h()\n"), ("b.py", "python", "import os\nclass K:\n    def g(self):\n        return h()\n")]


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sources_are_spread_before_anything_is_made(spark):
    made = code_tables.sources(spark, DATA).where(F.col("path").endswith(".py"))
    plan = _optimized(made)
    assert "Join" not in plan and "EndsWith" not in plan[plan.index("RepartitionByExpression") :]
    assert made.count() == sum(r["path"].endswith(".py") for r in code_tables.sources(spark, DATA).collect())


def test_spread_files_are_not_spread_again(spark):
    files = code_tables.sources(spark, DATA)
    once, twice = parsers.parse_files(files, spread=True), parsers.parse_files(files)
    assert _executed(once).count("Exchange") == 1
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_statements_come_in_the_order_of_a_walk():
    text = "try:\n    import a\nexcept E:\n    if x:\n        import b\nelse:\n    import c\nfinally:\n    import d\nmatch m:\n    case 1:\n        import e\nasync def f():\n    with g:\n        from h import i\n    x = lambda: [j for j in k if j]\nwhile l:\n    import n\nelse:\n    import o\n"
    tree = ast.parse(text)
    assert list(parsers._statements(tree)) == [n for n in ast.walk(tree) if isinstance(n, (ast.mod, ast.stmt, ast.ExceptHandler, ast.match_case))]
    assert [r["module"] for r in parsers.parse_python("p.py", text)["imports"]] == [a.name if isinstance(n, ast.Import) else n.module for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names]
    for node in ast.walk(tree):
        assert parsers._children(node) == [c for c in ast.iter_child_nodes(node) if not isinstance(c, (ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop))]


def test_symbols_are_sorted_once(spark):
    files = spark.createDataFrame([*FILES, ("b.ts", "javascript", "class K {\n}\n")], "path string, language string, content string")
    made = index.last_symbols(parsers.parse_files(files).cache())
    assert _executed(made).split("InMemoryTableScan")[0].count("Sort [") == 1
    assert {r["qualified_name"]: r["path"] for r in made.collect()} == {"a.f": "a.py", "b.K": "b.ts", "b.K.g": "b.py"}


def test_popular_keys_are_written_once(spark):
    files = spark.createDataFrame(FILES, "path string, language string, content string")
    made = index.build(files, parsers.parse_files(files).cache())
    assert "RepartitionByExpression [key" in _optimized(made.nodes) and "RepartitionByExpression [source_key" in _optimized(made.edges)
    assert sorted(r["key"] for r in made.nodes.collect() if r["type"] in ("MODULE", "SYMBOL")) == ["module:a", "module:b", "module:os", "symbol_ref:h"]
    used = _optimized(index.wanted_names(parsers.parse_files(files).cache()))
    assert all("regexp_replace" not in line for line in used.splitlines() if "_r#" in line and "Project" in line)  # modules go by files, not by uses


def test_names_with_more_parts_than_asked_are_not_keys(spark):
    symbols = spark.createDataFrame([("g", "b.K.g", "b"), ("g", "a.g", "a"), ("n", "n", None)], "name string, qualified_name string, module string")
    asked = lambda rows: search.resolve(spark.createDataFrame(rows, "name string, source_module string"), symbols)
    assert {(r["name"], r["source_module"]): r["qualified_name"] for r in asked([("g", "b"), ("g", "z"), ("g", None), ("n", None)]).collect()} == {("g", "b"): "b.K.g", ("g", "z"): "a.g", ("g", None): "a.g", ("n", None): "n"}
    assert {r["name"]: r["qualified_name"] for r in asked([("b.K.g", "z"), ("K.g", "z")]).collect()} == {"b.K.g": "b.K.g", "K.g": "b.K.g"}
    assert "isnotnull(module" not in _optimized(asked([("g", "b")]))  # else both uses of the keys would be made


def test_wide_edges_join_a_side_once(spark):
    frame = spark.createDataFrame
    symbols = frame([("K.g", "g", "METHOD", "K", "def g", 1, 2), ("x", "x", "CLASS", "m", None, 3, 4)], "qualified_name string, name string, kind string, module string, signature string, line_start int, line_end int")
    nodes = frame([("symbol:K.g", "METHOD", "g", "k.py"), ("module:m", "MODULE", "m", None)], "key string, type string, label string, file_path string")
    edges = frame([("module:m", "symbol:K.g", "CONTAINS", "{}", 1.0), ("symbol:K.g", "symbol:x", "CALLS", "{}", 1.0), ("symbol:K.g", "symbol_ref:z", "CALLS", "{}", 1.0)], "source_key string, target_key string, edge_type string, metadata string, weight double")
    made = api.wide_edges(index.Index(None, symbols, None, None, nodes, edges, None))
    seen = {r["target_key"]: (r["source_label"], r["source_symbol_kind"], r["target_label"], r["target_path"], r["target_qualified_name"], r["target_line_start"]) for r in made.collect()}
    assert seen == {"symbol:K.g": ("m", None, "g", "k.py", "K.g", 1), "symbol:x": ("g", "METHOD", None, None, "x", 3), "symbol_ref:z": ("g", "METHOD", None, None, None, None)}
    assert _optimized(made).count("Join LeftOuter") == 2
