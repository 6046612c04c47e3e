"""All queries of the library's own operators, with their SQL for DuckDB."""

from __future__ import annotations

from . import effect_queries, map_queries, structure_queries

_MODULES = (structure_queries, map_queries, effect_queries)

QUERIES: dict = {name: run for m in _MODULES for name, run in m.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
