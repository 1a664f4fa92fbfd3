"""Named queries over the given tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callscope.plans.testdata import flat

Build = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query. Its result columns are flattened to comparable types."""
    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: flat(build(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


def load() -> tuple[dict[str, Build], dict[str, str]]:
    from callscope.plans import (  # noqa: F401
        alert_queries, metric_queries, payload_queries, report_queries, rollup_queries, session_queries, stream_queries,
    )

    return QUERIES, ORACLES
