"""Registration of queries and of the SQL that defines their results."""

from __future__ import annotations

from collections.abc import Callable

from motefield.catalog.tables import SQL_TABLES

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def _closure(uses: list[str]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for parent in SQL_TABLES[name][0]:
            visit(parent)
        ordered.append(name)

    for name in uses:
        visit(name)
    return ordered


def with_tables(sql: str, uses: list[str]) -> str:
    """Put the derived tables a query uses in front of it as common table expressions."""
    body = sql.strip()
    ctes = [f"{name} AS ({SQL_TABLES[name][1].strip()})" for name in _closure(uses)]
    if not ctes:
        return body
    head = "WITH RECURSIVE " + ",\n".join(ctes)
    if body.upper().startswith("WITH "):
        return head + ",\n" + body[5:]
    return head + "\n" + body


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a query; without ``sql`` the result is checked by tests instead."""

    def register(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_tables(sql, list(uses))
        return fn

    return register


def rounded(df, digits: int = 6):
    """Round every double column, so that results do not depend on summation order."""
    from pyspark.sql import functions as F

    return df.select([F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
