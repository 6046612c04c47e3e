"""Registers a query: a function of the fixture tables, and its SQL."""

from __future__ import annotations

from .fixtures import Tables


class Queries:
    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def put(f):
            self.queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.sql[name] = sql
            return f

        return put
