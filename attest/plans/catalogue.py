"""Importing this module registers every query."""

from __future__ import annotations

import importlib

from attest.plans.registry import ORACLES, QUERIES

MODULES = ["coverage", "measures", "series", "signals", "audit", "retrieval", "sources"]

for _name in MODULES:
    importlib.import_module(f"attest.plans.{_name}")

__all__ = ["QUERIES", "ORACLES"]
