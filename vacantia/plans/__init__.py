"""Registered queries over the given tables."""

from __future__ import annotations

import importlib

MODULES = ("scoring_queries", "pay_queries", "history_queries", "board_queries", "page_queries")


def registered():
    """The catalog with all queries loaded."""
    for name in MODULES:
        importlib.import_module(f"vacantia.plans.{name}")
    return importlib.import_module("vacantia.plans.catalog")
