"""Queries and their SQL under one name."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries = {}
        self.sql = {}

    def entry(self, name: str, statement: str | None = None):
        """Register a query; without SQL its rows are only counted."""

        def register(query):
            self.queries[name] = query
            if statement is not None:
                self.sql[name] = statement
            return query

        return register
