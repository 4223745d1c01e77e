"""All queries of the library by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from . import queries as q


def queries() -> dict:
    return dict(q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(q.SQL)
