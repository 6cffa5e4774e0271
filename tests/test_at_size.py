"""What plans do once, in all tasks or on few columns, where larger tables would not let them do otherwise."""

from pyspark.sql import functions as F

from seamline.functions import infer
from seamline.operators import components, search
from seamline.plans import code_tables, index, reports
from seamline.sources import parsers

DATA = "/root/testdata/sf0.001"
FILES = [("a.py", "python", "def f():\n    return g() + h()\n"), ("b.py", "python", "class K:\n    def g(self):\n        return f()\n"), ("c.py", "python", "class K:\n    def g(self):\n        return 1\n")]


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_made_in_all_tasks(spark):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert code_tables.sources(spark, DATA).rdd.getNumPartitions() == parts


def test_names_resolved_once_serve_nodes_and_edges(spark):
    files = spark.createDataFrame(FILES, "path string, language string, content string")
    parsed = parsers.parse_files(files).cache()
    symbols = index.last_symbols(parsed)
    known = index.known_names(index.wanted_names(parsed), symbols).cache()
    given, made = index.build(files, parsed, symbols=symbols, known=known), index.build(files, parsed)
    rows = lambda df: sorted(map(str, df.drop("write_seq").collect()))
    assert rows(given.nodes) == rows(made.nodes) and rows(given.edges) == rows(made.edges)
    assert "symbol_ref:h" in {r["key"] for r in given.nodes.collect()}
    assert {r["name"]: r["qualified_name"] for r in known.where("source_module = 'a'").collect()} == {"g": "b.K.g", "h": None}


def test_endings_meet_names_of_several_parts(spark):
    symbols = spark.createDataFrame([("g", "b.K.g", "b"), ("g", "c.x.K.g", "c"), ("other", "d.K.named", "d")], "name string, qualified_name string, module string")
    asked = lambda *names: {r["name"]: r["qualified_name"] for r in search.resolve(spark.createDataFrame([(n, "z") for n in names], "name string, source_module string"), symbols).collect()}
    assert asked("g", "K.g", "x.K.g", "named", "none") == {"g": "b.K.g", "K.g": "b.K.g", "x.K.g": "c.x.K.g", "named": "d.K.named", "none": None}
    assert asked("named") == {"named": "d.K.named"}
    assert "_most" in _plan(search.resolve(spark.createDataFrame([("g", "z")], "name string, source_module string"), symbols))


def test_component_edges_pass_once(spark):
    links = spark.createDataFrame([("a", "b", "calls", f"e{i % 13:02}", f"r{i % 7}") for i in range(40)] + [("a", "a", "calls", "x", "y"), ("b", "a", "calls", "x", None)], "source_component string, target_component string, edge_type string, example string, reason string")
    made = components.component_edges(links, 3, 2)
    assert sorted(map(tuple, made.collect())) == [("a", "b", "calls", 40, "e00|e00|e00", "r0|r0"), ("b", "a", "calls", 1, "x", "")]
    assert "Window" not in _plan(made) and "Join" not in _plan(made)


def test_texts_are_lower_cased_once(spark):
    rows = spark.createDataFrame([("Caching the API: load_ing Tests, Migration; file",)], "t string").select(infer.feature_terms(F.col("t")).alias("f"))
    assert rows.first()["f"] == ["api", "caching", "load ing", "migration"]
    assert _plan(rows).count("lower(") == 1


def test_evidence_is_ranked_without_its_texts(spark):
    rows = [("commit", str(i), "", "redis" if i % 3 else "plain", "timeout " * (i % 5), f"2024-01-{i % 28 + 1:02}") for i in range(60)]
    evidence = spark.createDataFrame(rows, "source_type string, source_id string, path string, title string, snippet string, ts string")
    found = [r["source_id"] for r in reports.search_evidence(evidence, "timeout", 7).collect()]
    order = search.phrase_bm25(evidence, "source_id", reports.EVIDENCE_TEXT, "timeout").join(evidence, F.col("id") == F.col("source_id")).orderBy(F.desc("rank"), F.desc("ts"), "source_id")
    assert found == [r["source_id"] for r in order.limit(7).collect()]
    assert _plan(reports.search_evidence(evidence, "timeout", 7)).count("GlobalLimit") == 3  # of the best ids, of what holds words within others, of both
