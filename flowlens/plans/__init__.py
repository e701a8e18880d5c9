"""Registered queries: each pairs a Spark plan with the SQL that checks it."""

from __future__ import annotations

import importlib

from flowlens.plans.registry import REGISTRY

for _name in (
    "scalar", "flows", "temporal", "detection", "feedback", "prep", "metrics", "models",
    "decisions", "alerts", "storage", "streams",
):
    importlib.import_module(f"flowlens.plans.{_name}")

__all__ = ["REGISTRY"]
