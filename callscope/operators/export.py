"""CSV and JSON exports of the reports.

Exports are ordinary Spark writes of aggregated rows: a small report ends up
in one file, a large one in several. CSV fields are quoted when needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions.measures import bucket, call_count, error_rate, is_error
from callscope.functions.percentile import P50_95, P50_95_99, nearest_rank
from callscope.operators.metrics import TOOL, cost_by_node, cost_by_session, cost_series, cost_totals, tool_stats
from callscope.session import cut_lineage

# Column names of the exported files.
TOOL_COLUMNS = {
    "tool_name": "toolName", "server_name": "serverName", "call_count": "callCount",
    "error_rate_pct": "errorRatePct", "p50_latency_ms": "p50LatencyMs", "p95_latency_ms": "p95LatencyMs",
    "p99_latency_ms": "p99LatencyMs",
}
COST_COLUMNS = {
    "server_name": "serverName", "tool_name": "toolName", "call_count": "callCount",
    "input_tokens": "inputTokens", "output_tokens": "outputTokens", "cost_usd": "costUsd",
}

SESSION_COST_COLUMNS = {
    "session_id": "sessionId", "server_name": "serverName", "started_at": "startedAt", "label": "label",
    "call_count": "callCount", "cost_usd": "costUsd", "total_tokens": "totalTokens",
}
SERIES_COLUMNS = {"bucket": "bucket", "cost_usd": "costUsd"}
TOTAL_COLUMNS = {
    "total_cost_usd": "totalCostUsd", "total_tokens": "totalTokens", "active_nodes": "activeNodes",
    "top_server_name": "topServerName", "top_tool_name": "topToolName",
}


def _renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def _write(df: DataFrame, fmt: str, path: str) -> None:
    if fmt == "csv":
        df.write.mode("overwrite").csv(path, header=True)
    elif fmt == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}; use csv or json")


def tools_with_series(calls: DataFrame) -> DataFrame:
    """Statistics per tool and server with their nested 15-minute series. An
    array holds one entry per bucket of the window, never calls. Calling this
    starts a job."""
    # One histogram answers all of it, so calls are read once.
    histogram = cut_lineage(calls.withColumn("bucket", bucket()).groupBy(*TOOL, "bucket", "latency_ms").agg(
        call_count().alias("calls"), F.sum(is_error()).alias("errors")))
    ranks = {"sums": {"errors": F.col("errors")}, "count": F.sum("calls")}
    rate = error_rate("errors", "call_count")
    by_bucket = nearest_rank(histogram, [*TOOL, "bucket"], "latency_ms", P50_95, **ranks).groupBy(*TOOL).agg(
        F.sort_array(F.collect_list(F.struct(
            "bucket", F.col("p50_latency_ms").alias("p50"), F.col("p95_latency_ms").alias("p95")))).alias("timeseriesLatency"),
        F.sort_array(F.collect_list(F.struct("bucket", rate.alias("errorRatePct")))).alias("timeseriesErrors"))
    stats = nearest_rank(histogram, TOOL, "latency_ms", P50_95_99, **ranks).withColumn("error_rate_pct", rate)
    return _renamed(stats.join(by_bucket, [*TOOL]), {
        **TOOL_COLUMNS, "timeseriesLatency": "timeseriesLatency", "timeseriesErrors": "timeseriesErrors"})


def export_tool_stats(calls: DataFrame, fmt: str, path: str) -> None:
    """Tool statistics; the JSON form carries the series as well."""
    _write(_renamed(tool_stats(calls), TOOL_COLUMNS) if fmt == "csv" else tools_with_series(calls), fmt, path)


def cost_sections(calls: DataFrame, sessions: DataFrame) -> DataFrame:
    """The JSON form of the cost report as rows ``(section, entry)``:
    totals, nodes, sessions and the 15-minute series. A row per entry, so a
    report with many nodes is written by many tasks."""
    def section(rows: DataFrame, name: str, names: dict[str, str]) -> DataFrame:
        fields = F.to_json(F.struct(*[F.col(old).alias(new) for old, new in names.items()]), {"ignoreNullFields": "false"})
        return rows.select(F.lit(name).alias("section"), fields.alias("entry"))

    parts = [
        section(cost_totals(calls), "totals", TOTAL_COLUMNS),
        section(cost_by_node(calls), "byNode", COST_COLUMNS),
        section(cost_by_session(calls, sessions), "bySession", SESSION_COST_COLUMNS),
        section(cost_series(calls), "timeseries", SERIES_COLUMNS),
    ]
    return reduce(DataFrame.unionByName, parts)


def export_cost(calls: DataFrame, fmt: str, path: str, sessions: DataFrame | None = None) -> None:
    """CSV: cost per node, most expensive first, six decimals. JSON: all
    sections of the cost report, one line per entry; it needs the sessions."""
    if fmt == "csv":
        costs = cost_by_node(calls).withColumn("cost_usd", F.format_string("%.6f", "cost_usd"))
        _write(_renamed(costs, COST_COLUMNS), fmt, path)
    elif sessions is None:
        raise ValueError("the JSON form lists sessions; pass the sessions table")
    else:
        _write(cost_sections(calls, sessions), fmt, path)
