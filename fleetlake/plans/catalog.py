"""All named queries."""

from __future__ import annotations

import importlib

from .registry import ORACLE, QUERIES

MODULES = ["scalars", "relational", "health", "lifecycle", "change", "metrics", "files"]
for _name in MODULES:
    importlib.import_module(f"{__package__}.{_name}")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
