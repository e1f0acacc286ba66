"""Registry of the library's queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import domain_queries, event_queries, extra_queries, graph_queries, model_queries, plane_queries, quality_queries, relational_queries, series_queries, text_queries, warehouse_queries

_MODULES = [relational_queries, event_queries, warehouse_queries, quality_queries, text_queries, domain_queries, extra_queries, series_queries, plane_queries, graph_queries, model_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in _MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
