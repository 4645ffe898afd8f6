"""All registered queries of the core and the SQL they are checked against."""

from __future__ import annotations

from vigil.plans import datasets, problems, records, rules, sources, stream

MODULES = [rules, records, datasets, sources, stream, problems]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
