"""Registered queries over the driver's tables."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("tracks", "places", "relational", "scalars", "sequences", "streams", "planner", "pois", "routes", "values", "copies", "files", "chains", "moves", "corridors")


def load_queries():
    """Imports every module of queries; returns the queries and their SQL twins by name."""
    from trekframe.plans import registry

    for name in MODULES:
        importlib.import_module(f"trekframe.plans.{name}")
    return registry.QUERIES, registry.ORACLES
