"""Queries and SQL of this package."""

from __future__ import annotations

import importlib

MODULES = ("markup", "survivors", "score_fusion", "privacy", "near_duplicates", "language", "packing", "leaks", "stuffing")


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"gleaner.llm.{name}"), attribute)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE_SQL")
