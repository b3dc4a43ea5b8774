"""The registered queries: each operator applied to the standard tables, with a DuckDB twin where SQL can say it."""

from __future__ import annotations

from ranksmith.queries import aggregating, preparing, ranking, vectors

MODULES = (ranking, vectors, preparing, aggregating)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
