"""Registered queries, one module per operator family."""

from __future__ import annotations

import importlib
from types import ModuleType

MODULES = (
    "cleaning",
    "scalars",
    "grouping",
    "velocity",
    "risk",
    "evaluation",
    "monitoring",
    "tables",
    "streams",
    "learning",
    "resampling",
)


def load_all() -> ModuleType:
    for module in MODULES:
        importlib.import_module(f"cardwatch.catalog.{module}")
    return importlib.import_module("cardwatch.catalog.base")
