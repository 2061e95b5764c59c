"""Registered queries over the given tables, and the SQL that must give the same rows."""

from __future__ import annotations

from . import compare_queries, profile_queries, source_queries

PARTS = (compare_queries, profile_queries, source_queries)


def queries() -> dict:
    return {k: f for p in PARTS for k, f in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: f for p in PARTS for k, f in p.SQL.items()}
