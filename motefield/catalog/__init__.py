"""Named queries and their SQL counterparts over the driver's tables."""

from __future__ import annotations

import importlib

MODULES = ("similarity", "embeddings", "clean", "joins", "sampling", "volumes", "poses", "classification", "logs", "sources")


def load() -> tuple[dict, dict]:
    """Import all query modules and return the registered queries and SQL texts."""
    for name in MODULES:
        importlib.import_module(f"motefield.catalog.{name}")
    registry = importlib.import_module("motefield.catalog.registry")
    return registry.QUERIES, registry.ORACLES
