"""All registered queries of the library with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import evidence_queries, flow_queries, queries as plans


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return plans.QUERIES | flow_queries.QUERIES | evidence_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return plans.SQL | flow_queries.SQL | evidence_queries.SQL
