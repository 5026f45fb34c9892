"""All queries and their SQL, by name."""

from __future__ import annotations

import importlib

MODULES = ("pairlens.plans.q_records", "pairlens.plans.q_selection", "pairlens.plans.q_evaluation", "pairlens.plans.q_data")


def _modules():
    yield from map(importlib.import_module, MODULES)


def queries() -> dict:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in _modules() for name, text in m.SQL.items()}
