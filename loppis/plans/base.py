"""A book of queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle_sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a function under its own name."""

        def put(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracle_sql[f.__name__] = sql
            return f

        return put

    def add(self, name: str, f: Query, sql: str | None = None) -> None:
        self.queries[name] = f
        if sql is not None:
            self.oracle_sql[name] = sql
