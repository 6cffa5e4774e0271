"""Where queries and their SQL are put by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import adapters as ad

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *, recursive: bool = False, canonical: bool = True, tables: str = ad.SQL):
    """Registers a function under its name, with the SQL of the same result.

    The SQL sees the canonical tables as common table expressions; a leading + says that more of them follow.
    """

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            more = sql.lstrip().startswith("+")
            head = f"WITH {'RECURSIVE ' * recursive}{tables}" if canonical else ""
            SQL[f.__name__] = f"{head}{', ' if canonical and more else ''}{sql.lstrip().removeprefix('+')}"
        return f

    return register
