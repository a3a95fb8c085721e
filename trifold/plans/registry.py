"""Named queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
MODULES = ["health", "lookups", "scalars", "statistics", "domain", "decisions", "models", "texts", "streams"]


def query(sql: str | None = None):
    """Registers the decorated function under its name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def load() -> None:
    for m in MODULES:
        import_module(f"{__package__}.{m}")
