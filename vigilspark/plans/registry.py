"""Query and oracle registry filled by the modules of this package."""

from __future__ import annotations

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add
