"""Registered queries: DataFrame plans over the driver's tables, each with its SQL twin; and rules over given rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("rollups", "aggregates", "relational", "rules", "rule_views", "chains", "commands", "selection", "catalogue", "ledgers", "reviews", "intake", "views")


def load_all() -> None:
    """Import every module that registers queries or rules."""
    for m in MODULES:
        import_module(f"{__name__}.{m}")
