"""Composed studies and the catalog of runnable queries."""

from __future__ import annotations

import importlib

AREAS = ["statistics", "curves", "records", "texts"]


def load_catalog():
    """(queries by name, SQL by name) of all areas."""
    from ragscale.plans import catalog

    for area in AREAS:
        importlib.import_module(f"ragscale.plans.{area}")
    return catalog.QUERIES, catalog.ORACLES
