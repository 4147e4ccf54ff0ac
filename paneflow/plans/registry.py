"""Registry of the composed queries: name → (Spark callable, optional oracle SQL).

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame built over the
test tables (or data Spark derives from them).  Oracle texts are DuckDB SQL over
the same tables; queries without one get a row-count check only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add a query (and its oracle SQL, if it has one)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def alias(name: str, target: str) -> None:
    """Register ``name`` as another inventory row served by the query ``target``."""
    QUERIES[name] = QUERIES[target]
    if target in ORACLES:
        ORACLES[name] = ORACLES[target]
