"""Registered queries of the library."""

from __future__ import annotations


def all_queries() -> tuple[dict, dict]:
    """(queries, SQL twins) of all registered plans."""
    from aerolith.plans import details, flights, sky

    queries, sql = {}, {}
    for module in (flights, sky, details):
        queries |= module.R.queries
        sql |= module.R.sql
    return queries, sql
