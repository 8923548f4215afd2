"""Registered queries of the engine's own operators, each with its SQL."""

from __future__ import annotations

from importlib import import_module

from .base import Query

MODULES = ("retrieval", "operations", "quality", "graph", "ingest", "telemetry")


def _registries():
    return [import_module(f".{m}", __name__).registry for m in MODULES]


def queries() -> dict[str, Query]:
    return {k: f for r in _registries() for k, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for r in _registries() for k, s in r.sql.items()}
