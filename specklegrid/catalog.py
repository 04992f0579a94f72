"""All queries of the engine's own operators with their SQL oracles, gathered from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules():
    from .plans import engine_queries, file_queries, large_queries, pixel_queries, series_queries, wide_queries

    return [pixel_queries, series_queries, engine_queries, wide_queries, large_queries, file_queries]


def queries() -> dict[str, Query]:
    return {name: q for m in _modules() for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _modules() for name, q in m.ORACLE_SQL.items()}
