"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgermesh.plans import (  # noqa: F401
    answer_queries, company_queries, filing_queries, graph_queries, market_queries, people_queries, projection_queries, sink_queries,
)
from ledgermesh.plans.registry import CHECKS, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def check_sql() -> dict[str, str]:
    return dict(CHECKS)
