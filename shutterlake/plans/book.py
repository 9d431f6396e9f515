"""A book of queries: each function with the SQL that says the same, if SQL can."""

from __future__ import annotations


class Book:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, sql: str | None = None):
        def note(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return note
