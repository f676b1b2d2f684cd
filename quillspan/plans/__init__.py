"""Adapters over the given tables and the registered queries of the operators."""

from __future__ import annotations

from importlib import import_module

#: Modules that register queries.
MODULES = ("near", "reports", "learner", "concepts", "structure", "corpora", "inputs", "catalog")


def _load() -> None:
    for name in MODULES:
        import_module(f"quillspan.plans.{name}")


def queries() -> dict:
    from quillspan.plans.registry import QUERIES

    _load()
    return QUERIES


def oracle_sql() -> dict:
    from quillspan.plans.registry import SQL

    _load()
    return SQL
