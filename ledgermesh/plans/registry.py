"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgermesh.plans.bindings import Inputs, plain
from ledgermesh.plans.check_views import CHECK_VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Inputs`` under ``name``, with its check SQL."""

    def register(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Inputs(spark, folder))
        if sql is not None:
            CHECKS[name] = plain(sql, CHECK_VIEWS)
        return build

    return register
