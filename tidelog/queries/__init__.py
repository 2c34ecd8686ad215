"""The engine's queries by operator id, each with its SQL where SQL can express it."""

from __future__ import annotations

from . import capture_queries, client_queries, filter_queries, function_queries, log_queries, source_queries, table_queries
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "capture_queries", "client_queries", "filter_queries", "function_queries", "log_queries", "source_queries", "table_queries"]
