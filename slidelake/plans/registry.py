"""Where queries and their equivalent SQL are put down."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, with SQL for those that SQL can express."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Decorator that enters a query."""

        def enter(f: Query) -> Query:
            self.queries[name] = f
            if sql is not None:
                self.oracle[name] = sql
            return f

        return enter
