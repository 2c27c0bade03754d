"""Named queries, one module per part of the engine."""

from __future__ import annotations

from importlib import import_module

MODULES = ("nexmark", "dataflow", "joins", "aggs", "stats", "ordering", "sql", "windows", "words", "apps", "io", "streams")


def load_all() -> None:
    for name in MODULES:
        import_module(f"tidegate.plans.{name}")
