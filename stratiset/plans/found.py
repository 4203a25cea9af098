"""The table of queries that modules of this package add theirs to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL counterpart if there is one."""

    def add(f: Query) -> Query:
        FOUND[f.__name__] = (f, sql)
        return f

    return add
