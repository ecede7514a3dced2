"""Registry of named queries: Spark callable + DuckDB oracle text.

Every registered query reads whole driver tables (or data Spark derives from
them) under `sf_dir`; its oracle twin is written independently in SQL over
the same tables. Doubles that depend on summation order are rounded to
ORACLE_DIGITS in BOTH the Spark output and the SQL, never anything else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ORACLE_DIGITS = 6

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register `fn(spark, sf_dir) -> DataFrame` under `name` with its oracle SQL."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query name {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return deco


def _load_all() -> None:
    # import for side effects (registration)
    from roomrate.plans import (  # noqa: F401
        queries_sources, queries_scalar, queries_encode, queries_joins, queries_profile,
        queries_text, queries_models, queries_jobs,
    )


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)
