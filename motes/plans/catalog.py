"""All registered queries."""

from __future__ import annotations

import importlib

MODULES = ["objects", "spatial_queries", "pixel_queries", "record_queries"]


def _all() -> dict:
    out: dict = {}
    for m in MODULES:
        found = importlib.import_module(f"motes.plans.{m}").QUERIES
        twice = set(out) & set(found)
        if twice:
            raise ValueError(f"registered twice: {sorted(twice)}")
        out.update(found)
    return out


def queries() -> dict:
    return {n: fn for n, (fn, _) in _all().items()}


def oracle_sql() -> dict:
    return {n: sql for n, (_, sql) in _all().items() if sql}
