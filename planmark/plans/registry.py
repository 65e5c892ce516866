"""Registration of named queries."""

from __future__ import annotations


def registry():
    """(queries, oracle SQL, decorator) of one module."""
    queries: dict = {}
    oracle: dict = {}

    def register(name: str, sql: str | None = None):
        def add(fn):
            queries[name] = fn
            if sql is not None:
                oracle[name] = sql
            return fn

        return add

    return queries, oracle, register
