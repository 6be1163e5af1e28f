"""The registered queries and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["relational", "operations", "learning", "models", "files_and_streams"]


def _registries():
    return [import_module(f"{__name__}.{name}").registry for name in _MODULES]


def all_queries() -> dict:
    return {name: build for registry in _registries() for name, build in registry.queries.items()}


def all_sql() -> dict:
    return {name: sql for registry in _registries() for name, sql in registry.sql.items()}
