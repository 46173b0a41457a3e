"""All queries of the core and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from siltstone.plans import data, parsing, relational, reports, small, views

MODULES = (data, views, reports, relational, parsing, small)


def queries() -> dict[str, Callable]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
