"""Registered queries: a callable per operator and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparsile.catalog.tables import Tables, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def register(name: str, check: str | None = None):
    """Register ``build(tables) -> DataFrame`` under ``name``."""

    def wrap(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if check is not None:
            CHECKS[name] = with_fixtures(check)
        return build

    return wrap
