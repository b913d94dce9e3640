"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from boxloom.plans import catalog, dataset, intake  # noqa: F401  the others add their queries to the catalog


def queries() -> dict[str, Callable]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)
