"""Every registered query of the library, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidepool.sources.fixtures import duck

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Enters a query under its name; `sql` may use the fixture views."""

    def enter(query: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = query
        if sql:
            ORACLE_SQL[name] = duck(sql)
        return query

    return enter


from tidepool.plans import corpus_queries, memory_queries, predicate_queries, stats_queries, stream_queries, table_queries, text_queries  # noqa: E402, F401  they register themselves
