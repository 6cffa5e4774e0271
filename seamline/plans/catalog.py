"""All queries and their SQL."""

from __future__ import annotations

from . import code_queries, context_queries, explore_queries, memory_queries, queries, source_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
