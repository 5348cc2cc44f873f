"""All registered queries."""

from __future__ import annotations

import importlib

from cytoloom.catalog.registry import CHECKS, QUERIES

PARTS = ("sources", "boxes", "pixels", "stencils", "regions", "graph", "statistics", "labels", "flows", "tracing")


def _load() -> None:
    for part in PARTS:
        importlib.import_module(f"cytoloom.catalog.{part}")


def queries():
    _load()
    return dict(QUERIES)


def checks():
    _load()
    return dict(CHECKS)
