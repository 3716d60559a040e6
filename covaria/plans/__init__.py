"""Registered queries: operators applied to the test tables, each beside the SQL that it is held against."""

from __future__ import annotations

import importlib

from covaria.plans import registry

MODULES = ("dynamics", "cohorts", "statistics", "modelling", "suites", "coupling", "storage")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"covaria.plans.{name}")


def queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
