"""Queries over the test tables, one for each family of operators, with equivalent SQL."""

from __future__ import annotations

from . import assembly, authors, lists, lookups, metrics, names, scalars, search, trees, usages

_MODULES = (assembly, authors, search, trees, lookups, metrics, scalars, names, lists, usages)


def queries() -> dict:
    return {name: run for m in _MODULES for name, (run, _) in m.REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.REGISTRY.items() if sql}
