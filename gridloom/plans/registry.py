"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from gridloom.plans import contract_sql, domain, evaluation, io, repair, reports, review, windows

MODULES = [domain, windows, evaluation, reports, review, io, repair]


def queries() -> dict[str, Callable]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in [*MODULES, contract_sql] for k, v in m.SQL.items()}
