"""Registered queries and their SQL twins, filled by the modules of plans."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a query f(spark, sf_dir) under a name, with SQL that DuckDB runs."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep
