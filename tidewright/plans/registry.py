"""All queries and their check SQL."""

from __future__ import annotations

import importlib

FAMILIES = ("change_data", "lineage", "monitoring", "maintenance", "loading", "retention", "workload", "services")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _family in FAMILIES:
    _module = importlib.import_module(f"tidewright.plans.{_family}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
