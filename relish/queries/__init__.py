"""Registered queries: each Spark callable stands next to its SQL oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relish.sources.warehouse import view_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_MODULES = ("sources", "cleaning", "joins", "aggregates", "ranking", "sampling", "features",
            "vectors", "models", "serving", "streams")


def oracle(*views: str, ctes: str = "", select: str) -> str:
    """SQL text with the named input views, then extra CTEs, then the final select."""
    parts = [f"fx_{v} as ({view_sql(v)})" for v in views]
    if ctes.strip():
        parts.append(ctes.strip())
    head = ("with recursive " if "recursive" in ctes else "with ") + ",\n".join(parts) if parts else ""
    return f"{head.replace('/*recursive*/', '')}\n{select.strip()}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a Spark query and, where SQL can state it, its oracle."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def load_all() -> None:
    for module in _MODULES:
        importlib.import_module(f"relish.queries.{module}")
