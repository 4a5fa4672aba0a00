"""Checking SQL for DuckDB, one text per registered query."""

import importlib

from areaflow.plans import CATALOGS


def all_oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in CATALOGS:
        out.update(importlib.import_module(f"areaflow.oracle.{name}").ORACLES)
    return out
