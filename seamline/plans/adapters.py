"""Canonical tables from the driver's tables, as DataFrames and as the same SQL.

A part is a source file with one symbol, an order a commit, a line item a changed file; suppliers are modules that use
symbols. Documents are files with content. See README for the mapping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What commit subjects are made of.
VERBS = ["Add", "Fix", "Refactor", "Remove", "Update", "Migrate", "Introduce", "Tune"]
TOPICS = ["auth cache", "payment retry", "database schema", "api gateway", "queue service", "redis timeout", "docs layout", "build script", "routing tests"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _component() -> Column:
    return F.lower(F.replace("p_brand", F.lit("#")))


def _path() -> Column:
    size = F.col("p_size") % 5
    ending = F.when(size == 0, "_test.py").when(size == 1, ".ts").otherwise(".py")
    return F.concat(F.lit("src/"), _component(), F.lit("/"), F.lower("p_type"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"), ending)


def file_columns() -> list[Column]:
    """A file's columns, of the row of part that it stands for."""
    language = F.when(F.col("p_size") % 5 == 1, "javascript").otherwise("python")
    return [F.col("p_partkey").alias("file_id"), _path().alias("path"), _component().alias("component"), language.alias("language"), (F.col("p_size") * 100).cast("long").alias("size_bytes"), (F.col("p_size") * 3).cast("long").alias("line_count")]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(*file_columns())


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    module = F.concat(_component(), F.lit("."), F.lower("p_type"))
    kind = F.when(F.col("p_size") % 3 == 0, "CLASS").when(F.col("p_size") % 3 == 1, "FUNCTION").otherwise("METHOD")
    qualified = F.concat(module, F.lit("."), name, F.lit("_"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol_id"), name.alias("name"), qualified.alias("qualified_name"), kind.alias("kind"), module.alias("module"), _component().alias("component"), _path().alias("path"), F.col("p_size").alias("line_start"), F.lit(None).cast("string").alias("docstring"))


def _subject(key: Column) -> Column:
    verb = F.get(F.array(*map(F.lit, VERBS)), (key % len(VERBS)).cast("int"))
    topic = F.get(F.array(*map(F.lit, TOPICS)), (key % len(TOPICS)).cast("int"))
    return F.concat(verb, F.lit(" "), topic, F.lit(" (#"), key.cast("string"), F.lit(")"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("o_orderkey").alias("sha"), F.col("c_name").alias("author"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ts"), _subject(F.col("o_orderkey")).alias("subject"))


def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sha, author, ts, path, component: each file of a commit once."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("file_id")).distinct()
    return commits(spark, sf_dir).drop("subject").join(items, "sha").join(files(spark, sf_dir).select("file_id", "path", "component"), "file_id").drop("file_id")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module (supplier) to symbol (part) edges, typed by return flag (calls and references by large quantities alone) and weighted by quantity, and CONTAINS edges above modules."""
    large = F.col("l_quantity") >= 45
    kind = F.when(large & (F.col("l_returnflag") == "R"), "CALLS").when(large & (F.col("l_returnflag") == "N"), "REFERENCES").otherwise("IMPORTS")
    uses = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey", kind.alias("edge_type")).agg(F.sum("l_quantity").alias("weight"))
    target = symbols(spark, sf_dir).select(F.col("symbol_id"), F.concat(F.lit("symbol:"), "qualified_name").alias("target_key"))
    uses = uses.join(target, F.col("l_partkey") == F.col("symbol_id")).select(F.concat(F.lit("module:supplier_"), F.col("l_suppkey").cast("string")).alias("source_key"), "target_key", "edge_type", "weight")
    nation, region, supplier = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    inside = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("module:"), "r_name").alias("source_key"), F.concat(F.lit("module:"), "n_name").alias("target_key"))
    below = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("module:"), "n_name").alias("source_key"), F.concat(F.lit("module:supplier_"), F.col("s_suppkey").cast("string")).alias("target_key"))
    contains = inside.union(below).select("source_key", "target_key", F.lit("CONTAINS").alias("edge_type"), F.lit(1.0).alias("weight"))
    return uses.unionByName(contains)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    parts = [
        symbols(spark, sf_dir).select(F.concat(F.lit("symbol:"), "qualified_name").alias("key"), F.col("kind").alias("type"), F.col("name").alias("label"), F.col("path").alias("file_path")),
        table(spark, sf_dir, "supplier").select(F.concat(F.lit("module:supplier_"), F.col("s_suppkey").cast("string")), F.lit("MODULE"), F.col("s_name"), none),
        table(spark, sf_dir, "nation").select(F.concat(F.lit("module:"), "n_name"), F.lit("MODULE"), F.col("n_name"), none),
        table(spark, sf_dir, "region").select(F.concat(F.lit("module:"), "r_name"), F.lit("MODULE"), F.col("r_name"), none),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, language, content."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.col("lang").alias("language"), F.coalesce("text", F.lit("")).alias("content"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: The same tables as common table expressions.
SQL = f"""
files AS (
  SELECT p_partkey AS file_id, lower(replace(p_brand, '#', '')) AS component,
         'src/' || lower(replace(p_brand, '#', '')) || '/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || '_' || p_partkey ||
         CASE p_size % 5 WHEN 0 THEN '_test.py' WHEN 1 THEN '.ts' ELSE '.py' END AS path,
         CASE p_size % 5 WHEN 1 THEN 'javascript' ELSE 'python' END AS language, (p_size * 100)::BIGINT AS size_bytes, (p_size * 3)::BIGINT AS line_count
  FROM part
), symbols AS (
  SELECT p_partkey AS symbol_id, replace(p_name, ' ', '_') AS name, lower(replace(p_brand, '#', '')) || '.' || lower(p_type) AS module,
         lower(replace(p_brand, '#', '')) || '.' || lower(p_type) || '.' || replace(p_name, ' ', '_') || '_' || p_partkey AS qualified_name,
         CASE p_size % 3 WHEN 0 THEN 'CLASS' WHEN 1 THEN 'FUNCTION' ELSE 'METHOD' END AS kind, f.component, f.path, p_size AS line_start
  FROM part JOIN files f ON f.file_id = p_partkey
), commits AS (
  SELECT o_orderkey AS sha, c_name AS author, strftime(o_orderdate, '%Y-%m-%d') AS ts,
         ({_list(VERBS)})[o_orderkey % {len(VERBS)} + 1] || ' ' || ({_list(TOPICS)})[o_orderkey % {len(TOPICS)} + 1] || ' (#' || o_orderkey || ')' AS subject
  FROM orders JOIN customer ON o_custkey = c_custkey
), commit_files AS (
  SELECT c.sha, c.author, c.ts, f.path, f.component FROM commits c
  JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l ON l.l_orderkey = c.sha JOIN files f ON f.file_id = l.l_partkey
), uses AS (
  SELECT l_suppkey, l_partkey, CASE WHEN l_returnflag = 'R' AND l_quantity >= 45 THEN 'CALLS' WHEN l_returnflag = 'N' AND l_quantity >= 45 THEN 'REFERENCES' ELSE 'IMPORTS' END AS edge_type, sum(l_quantity) AS weight
  FROM lineitem GROUP BY ALL
), edges AS (
  SELECT 'module:supplier_' || l_suppkey AS source_key, 'symbol:' || s.qualified_name AS target_key, edge_type, weight FROM uses JOIN symbols s ON s.symbol_id = l_partkey
  UNION ALL SELECT 'module:' || r_name, 'module:' || n_name, 'CONTAINS', 1.0::DOUBLE FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'module:' || n_name, 'module:supplier_' || s_suppkey, 'CONTAINS', 1.0::DOUBLE FROM supplier JOIN nation ON s_nationkey = n_nationkey
), nodes AS (
  SELECT 'symbol:' || qualified_name AS key, kind AS type, name AS label, path AS file_path FROM symbols
  UNION ALL SELECT 'module:supplier_' || s_suppkey, 'MODULE', s_name, NULL FROM supplier
  UNION ALL SELECT 'module:' || n_name, 'MODULE', n_name, NULL FROM nation
  UNION ALL SELECT 'module:' || r_name, 'MODULE', r_name, NULL FROM region
), docs AS (
  SELECT doc_id, concat_ws('/', source, lang, doc_id || '.txt') AS path, lang AS language, coalesce(text, '') AS content FROM documents
)
"""
