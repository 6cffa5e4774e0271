"""What a map and a comparison of maps read, shuffle and leave behind, and that it changes no edge."""

import duckdb
from pyspark.sql import functions as F

from seamline.functions import infer
from seamline.operators import components, lineage
from seamline.plans import code_queries, composites, context_queries, memory_index, memory_queries, scratch
from seamline.sources import parsers

DATA = "/root/testdata/sf0.001"
MANY = [f"src/m{i}/x.py" for i in range(40)]
COMMITS = [
    ("a", "n", "2024-01-01", "Fix one", ["src/api/x.py", "src/db/y.py", "src/db/y.py", "z.py"]),
    ("b", "n", "2024-01-02", "Fix two", ["src/api/x.py", "src/db/y.py"]),
    ("b", "o", "2024-01-03", "Fix two", ["src/db/y.py", "src/api/x.py", "src/ui/w.py"]),
    ("c", "o", "2024-01-04", "Fix three", MANY),
    ("d", "o", "2024-01-05", "Fix four", []),
    (None, "o", "2024-01-06", "Fix five", ["src/api/x.py", "src/db/y.py"]),
    (None, "o", "2024-01-07", "Fix six", ["src/api/x.py", "src/db/y.py"]),
]


def _memory(spark):
    commits = spark.createDataFrame(COMMITS, "sha string, author string, ts string, subject string, files array<string>").withColumn("email", F.lit(None).cast("string"))
    return commits, memory_index.build(commits, spark.createDataFrame([], "path string, content string"))


def _rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def _executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cochange_of_components_is_that_of_relationships(spark):
    commits, m = _memory(spark)
    end = lambda c: infer.component(F.regexp_replace(c, "^file:", ""))
    links = m.relationships.where("cochange").select(end("source_key").alias("source_component"), end("target_key").alias("target_component"), F.lit("cochange").alias("edge_type"), F.concat_ws("|", "source_key", "target_key", "evidence_id").alias("example"), F.substring("evidence_id", 1, 12).alias("reason"))
    want = _rows(components.component_edges(links))
    assert _rows(composites.cochange_edges(m)) == want and len(want) > 870
    m.history = commits
    assert _rows(composites.cochange_edges(m)) == want


def test_pairs_of_files_are_not_shuffled(spark):
    _, m = _memory(spark)
    once = memory_index.cochanged(memory_index.commits_of(m).where("sha in ('a', 'c')"))
    assert "Exchange" not in _executed(once) and once.count() == 6 + 30 * 29


def test_a_map_makes_no_evidence(spark, monkeypatch):
    monkeypatch.setattr(memory_queries, "_MEMORIES", {})
    memory = memory_queries.memory_of(spark, DATA)
    assert context_queries.build_map(spark, DATA).count() == 4
    made = lambda: {name for name in memory._written if name in vars(memory)}
    assert made() == {"history"}
    newest = _rows(composites.commit_inventory(memory))
    assert made() == {"history"}
    assert newest == _rows(composites.commit_inventory(memory.evidence)) and len(newest) == memory.history.count()


def test_a_comparison_parses_no_file_again(spark, monkeypatch):
    index = code_queries.index_of(spark, DATA)
    index.parsed.count()
    monkeypatch.setattr(parsers, "parse_files", lambda *a, **b: 1 / 0)
    part = code_queries.part_of(spark, DATA, "file_id % 9 = 4")
    paths = lambda df: sorted(r["path"] for r in df.select("path").collect())
    assert paths(part.parsed) == paths(part.files) and 0 < part.files.count() < index.files.count()
    assert context_queries.build_compare(spark, DATA).first()["n"] > 0
    monkeypatch.setattr(code_queries, "LEFT_OUT", 0)
    shuffled = code_queries.part_of(spark, DATA, "file_id % 9 = 4")
    assert paths(shuffled.parsed) == paths(part.parsed)


def test_written_tables_leave_no_shuffle(spark):
    statuses = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    tables = scratch.Tables(spark, "some", {"t": lambda: spark.range(1000).repartition(3, "id")}, {})
    before = statuses()
    assert tables.t is not None and statuses() <= before  # not counting on what the driver's collector frees
    tables._written["t"]().write.mode("overwrite").parquet(f"{tables._folder}/u")
    assert statuses() == before + 1
    assert tables.t.count() == 1000


def test_groups_that_hold_lists_stay_hashed(spark):
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    was, seen = spark.conf.get(name), []
    make = lineage.kept
    try:
        lineage.kept = lambda df: seen.append(spark.conf.get(name)) or make(df)
        assert lineage.kept_groups(spark.range(3)).count() == 3
    finally:
        lineage.kept = make
    assert seen == [str(lineage.GROUPS)] and spark.conf.get(name) == was


def test_files_of_commits_are_the_sql_s(spark, tmp_path):
    con = duckdb.connect()
    con.execute("create table orders as select * from (values (1, 1, date '2024-01-01'), (1, 2, date '2024-01-02'), (2, 1, date '2024-01-03'), (3, 9, date '2024-01-03'), (NULL, 1, date '2024-01-04')) t(o_orderkey, o_custkey, o_orderdate)")
    con.execute("create table customer as select * from (values (1, 'A#1'), (2, 'B#2')) t(c_custkey, c_name)")
    con.execute("create table lineitem as select * from (values (1, 1), (1, 1), (1, 2), (2, 2), (2, NULL), (NULL, 1), (7, 1), (3, 1)) t(l_orderkey, l_partkey)")
    con.execute("create table part as select * from (values (1, 'a b', 'Brand#1', 'T', 2), (2, 'c', 'Brand#2', 'T', 1), (2, 'd', 'Brand#2', 'T', 1)) t(p_partkey, p_name, p_brand, p_type, p_size)")
    for table in ("orders", "customer", "lineitem", "part"):
        con.execute(f"copy {table} to '{tmp_path}/{table}.parquet' (format parquet)")
    from seamline.plans import adapters as ad

    want = con.execute(f"with {ad.SQL.split(', uses AS')[0]}, cf as (select sha, list_sort(list(path)) as files from commit_files group by sha) select c.sha, author, coalesce(files, []) from commits c left join cf on cf.sha = c.sha").fetchall()
    got = [(r["sha"], r["author"], r["files"]) for r in memory_queries._commits(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 4
