"""The catalogue of runnable queries and their check SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from understory.plans.views import with_views
from understory.sources.standin import Tables

MODULES = ["metrics", "projections", "aggregations", "joins", "textures", "windows", "neighbourhoods",
           "scalars", "sources", "streams", "models", "warps"]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; without ``sql`` only the rows are checked."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            _SQL[name] = with_views(sql)
        return fn

    return register


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"understory.plans.{module}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
