"""Registered queries over the driver tables."""

from __future__ import annotations

import importlib

SECTIONS = ("sources", "filters", "scalars", "joins", "aggregates", "windows", "assembly", "streams", "plans")


def load() -> tuple[dict, dict]:
    from spotlake.catalog import registry

    for name in SECTIONS:
        importlib.import_module(f"spotlake.catalog.{name}")
    return registry.QUERIES, registry.ORACLES
