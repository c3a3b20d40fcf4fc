"""All queries of the audit engine by name, and their SQL."""

from __future__ import annotations

from . import file_queries, manifest_queries, similarity_queries, text_queries

_MODULES = (similarity_queries, text_queries, manifest_queries, file_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
