"""Queries and their oracles, registered side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricetide.session import configure

from .views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ITEMS: dict[str, str] = {}
ORACLE_VIEWS: dict[str, str] = {}


def query(name: str, item: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` for inventory ``item``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(configure(spark), folder))

        QUERIES[name] = run
        ITEMS[name] = item
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def oracle_sql() -> dict[str, str]:
    return {name: with_views(body, ORACLE_VIEWS) for name, body in ORACLES.items()}
