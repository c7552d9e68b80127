"""Registered queries of the library: name, DataFrame query, SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with the DuckDB SQL that gives the same rows."""

    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    from colloquy.plans import catalog  # noqa: F401  registers on import

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from colloquy.plans import catalog  # noqa: F401

    return dict(_SQL)
