"""All queries of the library by name, and the SQL that must give the same rows."""

from __future__ import annotations

from .catalogue import base, frozen, jobs, layouts, reports  # noqa: F401  each registers its queries


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
