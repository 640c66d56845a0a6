"""Registry of queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] | list[str] = (), same_as: str | None = None):
    """Register a query; ``sql`` is its check over the given tables and views, or the check is that of another query."""
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = with_views(sql, *views)
        elif same_as:
            ORACLES[name] = ORACLES[same_as]
        return fn
    return keep
