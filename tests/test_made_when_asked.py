"""Index and memory of the driver's tables: files are parsed in all tasks, and only what a question reads is made."""

from pyspark.sql import functions as F

from seamline.plans import api, code_queries, composites, memory_index, memory_queries
from seamline.sources import parsers

DATA = "/root/testdata/sf0.001"


def made(tables) -> set[str]:
    return {name for name in tables._written if name in vars(tables)}


def test_files_of_one_part_are_parsed_in_all_tasks(spark):
    files = code_queries._sources(spark, DATA).coalesce(1)
    parts = parsers.parse_files(files).select(F.spark_partition_id().alias("part")).distinct().count()
    assert parts == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_an_index_makes_what_is_asked(spark, monkeypatch):
    monkeypatch.setattr(code_queries, "_INDEXES", {})
    index = code_queries.index_of(spark, DATA)
    index.files.count()
    assert made(index) == set()
    code_queries.all_symbols(spark, DATA).count()
    assert made(index) == {"parsed", "symbols"}
    code_queries.index_edges(spark, DATA).count()
    assert made(index) == {"parsed", "symbols", "edges"}


def test_a_memory_makes_what_is_asked(spark, monkeypatch):
    monkeypatch.setattr(memory_queries, "_MEMORIES", {})
    memory = memory_queries.memory_of(spark, DATA)
    memory_queries.evidence_refs(spark, DATA).count()
    assert made(memory) == {"evidence"}
    memory_queries.relationship_evidence(spark, DATA).count()
    assert made(memory) == {"commits_read", "documents_read", "evidence"}


def test_questions_that_no_symbol_answers_need_no_graph(spark, monkeypatch):
    monkeypatch.setattr(code_queries, "_INDEXES", {})
    monkeypatch.setattr(memory_queries, "_MEMORIES", {})
    index, memory = code_queries.index_of(spark, DATA), memory_queries.memory_of(spark, DATA)
    assert composites.compressed_context(memory, index, "migrate")["snippets"].count() == 0
    assert made(index) == {"parsed", "symbols"}
    assert made(memory) == {"evidence"}
    none, some = (api.retrieve(index, word, max_tokens=300) for word in ("migrate", "unused_16"))
    assert none.count() == 0 < some.count()
    assert [(f.name, f.dataType) for f in none.schema] == [(f.name, f.dataType) for f in some.schema]


def test_decisions_are_the_entities_of_their_kind(spark):
    commits = [("ab" * 20, "a", "a@b.c", "2024-01-01", "Migrate database schema", ["src/api/x.py"]), ("ab" * 20, "a", "a@b.c", "2024-01-02", "Migrate auth", ["src/api/y.py"]), ("cd" * 20, "a", None, "2024-01-01", "Fix typo", ["src/x/z.py"])]
    documents = [("docs/adr/1.md", "# Use queues"), ("docs/adr/1.md", "# Use queues"), ("docs/release.md", "# One")]
    m = memory_index.build(spark.createDataFrame(commits, "sha string, author string, email string, ts string, subject string, files array<string>"), spark.createDataFrame(documents, "path string, content string"))
    rows = lambda df: sorted(map(str, df.select("key", "kind", "name", "summary", "confidence").collect()))
    assert rows(m.decided) == rows(m.entities.where(F.col("kind") == memory_index.DECISION)) and m.decided.count() == 2


def test_evidence_is_made_of_what_is_written(spark, monkeypatch):
    monkeypatch.setattr(memory_queries, "_MEMORIES", {})
    used = []
    made_of = memory_index.evidence_of
    monkeypatch.setattr(memory_index, "evidence_of", lambda c, d: used.append((c, d)) or made_of(c, d))
    memory = memory_queries.memory_of(spark, DATA)
    assert memory_index.relationship_evidence(memory).count() == memory.relationships.count()
    assert [(c is memory.commits_read, d is memory.documents_read) for c, d in used] == [(True, True)]
