"""Named query registry feeding ``__spark_entry__``.

Each query is ``fn(spark, sf_dir) -> DataFrame``; the optional oracle is DuckDB
SQL over the raw tables that must return the same rows and column names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views_sql import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None, views: tuple[str, ...] = ()):
    """Register a query; ``oracle`` is SQL over ``views`` (CTEs added here)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = with_views(oracle, *views)
        return fn
    return deco


def all_queries() -> dict[str, QueryFn]:
    from . import catalog  # noqa: F401  (registers on import)
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    from . import catalog  # noqa: F401
    return dict(ORACLE)
