"""All registered queries of the core library and their SQL."""

from __future__ import annotations

from weftline.plans import queries, sql, stateful

QUERIES = queries.QUERIES | stateful.QUERIES
ORACLE_SQL = sql.ORACLE_SQL | stateful.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
