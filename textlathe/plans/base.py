"""A registry of queries that keeps each query beside its SQL."""

from __future__ import annotations

from collections.abc import Callable


class Plans:
    """Queries by name; a query without SQL is tested by pytest instead."""

    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable] = {}
        self.ORACLES: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(f):
            self.QUERIES[f.__name__] = f
            if sql:
                self.ORACLES[f.__name__] = sql
            return f

        return add
