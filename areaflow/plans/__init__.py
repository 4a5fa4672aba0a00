"""Composed plans and the registered queries."""

import importlib

CATALOGS = ["storeys", "features", "area", "geometry", "review"]


def all_queries() -> dict:
    """Every registered query: name -> function of (spark, folder)."""
    out: dict = {}
    for name in CATALOGS:
        out.update(importlib.import_module(f"areaflow.plans.catalog_{name}").QUERIES)
    return out
