"""All queries of the engine with their SQL, gathered from the plan modules."""

from __future__ import annotations

from . import findings, library, packages, texts, trees

MODULES = [findings, texts, packages, library, trees]


def queries() -> dict:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
