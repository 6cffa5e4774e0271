"""Canonical tables of a repository and the names of their keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILES = "path string, language string, size_bytes bigint, mtime_ns bigint, sha256 string, line_count int"
SYMBOLS = "qualified_name string, name string, kind string, module string, path string, line_start int, line_end int, col_start int, col_end int, docstring string, decorators array<string>, signature string, parent_qualified_name string"
IMPORTS = "path string, module string, name string, alias string, line_number int, is_from boolean"
CALLS = "path string, caller string, target string, display string, arguments array<string>, line_number int"
INHERITS = "path string, child string, parent string, line_number int"
REFERENCES = "path string, source string, name string, line_number int"
NODES = "key string, type string, label string, file_path string, symbol_id bigint, metadata string"
EDGES = "source_key string, source_type string, target_key string, target_type string, edge_type string, weight double, metadata string"
COMMITS = "sha string, author string, email string, ts string, subject string, files array<string>"
EVIDENCE = "source_type string, source_id string, path string, title string, snippet string, author string, ts string"
#: Node and edge types.
NODE_TYPES = ["FILE", "MODULE", "CLASS", "FUNCTION", "METHOD", "SYMBOL", "ROUTE"]
EDGE_TYPES = ["CONTAINS", "IMPORTS", "CALLS", "REFERENCES", "DEFINES", "INHERITS", "HANDLES", "HTTP_CALLS"]


def file_key(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def module_key(module: Column) -> Column:
    return F.concat(F.lit("module:"), module)


def symbol_key(qualified_name: Column) -> Column:
    return F.concat(F.lit("symbol:"), qualified_name)


def unresolved_key(name: Column) -> Column:
    return F.concat(F.lit("symbol_ref:"), name)


def external_route_key(method: Column, target: Column) -> Column:
    """A route outside the repository; what isn't a letter, digit or one of _./:- becomes an underscore."""
    return F.concat(F.lit("route:external:"), F.upper(method), F.lit(":"), F.regexp_replace(target, r"[^A-Za-z0-9_./:-]+", "_"))
