"""Queries by name, each with SQL of the same meaning where there is any."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def queries() -> dict:
    from ledgerlink.plans import decisions, extractions, lookups, runs, scalars, searching, shapes  # noqa: F401

    return QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return SQL
