"""All queries of the engine with their SQL: each plan module fills QUERIES and SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ("scalars_q", "joins_q", "aggregates_q", "spatial_q", "sources_q", "extras_q", "grid_q", "polygons_q", "splits_q")


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"gridloom.plans.{m}"), name)
    return out


def queries() -> dict[str, Callable]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
