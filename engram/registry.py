"""All queries of the engine: name -> (Spark query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; `sql` may name the model views of engram.views as tables."""

    def add(function: Query) -> Query:
        from engram.views import with_views

        QUERIES[name] = (function, with_views(sql) if sql else None)
        return function

    return add
