"""Catalogue of named queries: a Spark callable and, where SQL can state it, the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def load_all() -> None:
    import importlib
    import pkgutil

    from tidemark import plans

    for module in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"tidemark.plans.{module.name}")
