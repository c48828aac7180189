"""Registered queries and the carriers that shape the given tables for them."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> tuple[dict, dict]:
    """Every registered query and every oracle, after importing the modules that declare them."""

    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("queries_"):
            importlib.import_module(f"{__name__}.{module.name}")
    from stopscan.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
