"""Registry of named queries and, where SQL can state them, their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citegrid.plans.views import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


class Inputs:
    """Input tables and views of one data folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, views: str = ""):
    """Register ``fn(inputs) -> DataFrame`` under ``name`` with its check over ``views``."""

    def register(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            CHECKS[name] = with_views(sql, *views.split()) if views else sql
        return fn

    return register


def load() -> None:
    """Import the modules that register queries."""
    from citegrid.plans import (  # noqa: F401
        doi_queries, graph_queries, network_queries, record_queries, report_queries, title_queries,
    )
