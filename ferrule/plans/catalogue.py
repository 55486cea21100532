"""Registry of the queries over the provided tables and their SQL twins."""

from __future__ import annotations

from ferrule.plans import graphs, mining, recommend, relational

MODULES = (relational, mining, recommend, graphs)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
