"""Registration of queries with their SQL."""

from __future__ import annotations

from .views import rounded


def registry():
    """(QUERIES, ORACLES, query): ``query(sql)`` registers a function by its name; doubles of its result are rounded."""
    queries, oracles = {}, {}

    def query(sql: str | None = None, digits: int = 6):
        def keep(f):
            queries[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
            if sql:
                oracles[f.__name__] = sql
            return f

        return keep

    return queries, oracles, query
