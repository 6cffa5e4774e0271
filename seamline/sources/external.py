"""Indexes that other tools made: generic JSON, and JSON of documents with symbols and occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def symbol_kind(kind: Column) -> Column:
    low = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(low.contains("class") | low.contains("interface"), "CLASS").when(low.contains("method"), "METHOD").otherwise("FUNCTION")


def edge_type(kind: Column) -> Column:
    low = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(low.contains("call"), "CALLS").when(low.contains("inherit") | low.contains("implement"), "INHERITS").when(low.contains("import"), "IMPORTS").otherwise("REFERENCES")


def display_name(symbol: Column) -> Column:
    """The last part of an id at #, /, . or a space, without what ends it."""
    plain = F.regexp_replace(symbol, r"[.#/ ]+$", "")
    return F.element_at(F.split(plain, r"[#/. ]"), -1)


def is_definition(roles: Column) -> Column:
    return F.when(roles.cast("int").isNotNull(), roles.cast("int").bitwiseAND(1) == 1).otherwise(F.lower(roles).contains("definition"))


def lines_of_range(span: Column) -> tuple[Column, Column]:
    """First and last line (from 1): of [line, ..., line, ...] at places 0 and 2 where there are three numbers or more, as the format's readers do."""
    first = F.coalesce(F.get(span, F.lit(0)) + 1, F.lit(1))
    return first, F.coalesce(F.get(span, F.lit(2)) + 1, first)


def read(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """An index in one JSON object a file or, with lines, in one a line, which large files are split at."""
    return spark.read.option("multiLine", str(not lines).lower()).json(path)


def detected_format(raw: DataFrame) -> str:
    return "scip-json" if "documents" in raw.columns else "generic-json"


def _field(struct: T.StructType, base: str, names: list[str], kind: str) -> Column:
    """The first of the names that the JSON has."""
    known = [F.col(f"{base}.{n}").cast(kind) for n in names if n in struct.fieldNames()]
    return F.coalesce(*known) if known else F.lit(None).cast(kind)


def symbols(raw: DataFrame) -> DataFrame:
    """qualified_name, name, kind, path, line_start, line_end; the last of a qualified name counts."""
    if detected_format(raw) == "generic-json":
        rows = raw.select(F.posexplode("symbols").alias("seq", "s"))
        of = raw.schema["symbols"].dataType.elementType
        get = lambda names, kind="string": _field(of, "s", names, kind)
        qualified = get(["qualified_name", "symbol", "id", "name"])
        made = rows.select("seq", qualified.alias("qualified_name"), F.coalesce(get(["name", "display_name"]), display_name(qualified)).alias("name"), symbol_kind(get(["kind", "type"])).alias("kind"), get(["file_path", "path", "file", "relative_path"]).alias("path"), F.coalesce(get(["line_start", "line", "start_line"], "int"), F.lit(1)).alias("line_start"), get(["line_end", "end_line"], "int").alias("line_end"))
    else:
        docs = raw.select(F.explode("documents").alias("d")).select("d.*")
        of = docs.schema["symbols"].dataType.elementType
        rows = docs.select("relative_path", F.explode("symbols").alias("s"))
        get = lambda names, kind="string": _field(of, "s", names, kind)
        qualified = get(["symbol", "qualified_name", "name"])
        listed = rows.select(F.lit(1).alias("seq"), qualified.alias("qualified_name"), F.coalesce(get(["name", "display_name"]), display_name(qualified)).alias("name"), symbol_kind(get(["kind"])).alias("kind"), F.col("relative_path").alias("path"), F.coalesce(get(["line_start"], "int"), F.lit(1)).alias("line_start"), get(["line_end"], "int").alias("line_end"))
        made = listed
        if "occurrences" in docs.columns:
            seen = docs.select("relative_path", F.explode("occurrences").alias("o")).where(is_definition(F.col("o.symbol_roles").cast("string")))
            first, last = lines_of_range(F.col("o.range"))
            made = seen.select(F.lit(0).alias("seq"), F.col("o.symbol").alias("qualified_name"), display_name(F.col("o.symbol")).alias("name"), F.lit("FUNCTION").alias("kind"), F.col("relative_path").alias("path"), first.cast("int").alias("line_start"), last.cast("int").alias("line_end")).unionByName(listed)
    made = made.withColumn("line_end", F.coalesce("line_end", "line_start"))
    rest = [c for c in made.columns if c not in ("seq", "qualified_name")]
    return made.groupBy("qualified_name").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("qualified_name", "r.*")


def edges(raw: DataFrame) -> DataFrame:
    """source, target, edge_type, each once."""
    if detected_format(raw) == "generic-json":
        if "edges" not in raw.columns:
            return raw.sparkSession.createDataFrame([], "source string, target string, edge_type string")
        of = raw.schema["edges"].dataType.elementType
        rows = raw.select(F.explode("edges").alias("e"))
        get = lambda names: _field(of, "e", names, "string")
        return rows.select(get(["source", "from", "source_symbol"]).alias("source"), get(["target", "to", "target_symbol"]).alias("target"), edge_type(get(["type", "edge_type", "kind"])).alias("edge_type")).distinct()
    rows = raw.select(F.explode("documents").alias("d")).select(F.explode("d.symbols").alias("s")).select(F.col("s.symbol").alias("source"), F.explode("s.relationships").alias("r"))
    of = rows.schema["r"].dataType
    kind = F.coalesce(_field(of, "r", ["type"], "string"), F.lit("reference"))
    return rows.select("source", F.col("r.symbol").alias("target"), edge_type(kind).alias("edge_type")).distinct()


def stub_files(index: DataFrame, files: DataFrame) -> DataFrame:
    """path, language of files that only the index knows."""
    return index.select("path").where("path is not null").distinct().join(files, "path", "left_anti").withColumn("language", F.lit("external"))
