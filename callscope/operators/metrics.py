"""Operational questions over the calls table.

Each takes an (already filtered) calls DataFrame and returns one row per
group. All grouping is partial-aggregated before its shuffle and no payload
column is ever read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.config import (
    ERROR_CLASSES, HEALTH_DEGRADED_ERROR_PCT, HEALTH_DEGRADED_P95_MS, HEALTH_DOWN_ERROR_PCT, HEALTH_WINDOW,
)
from callscope.functions.measures import bucket, call_count, error_rate, is_error, or_zero, tokens
from callscope.functions.percentile import P50_95, P50_95_99, nearest_rank
from callscope.operators.filters import failed, since, within
from callscope.session import cut_lineage

NODE = ("server_name", "tool_name")
TOOL = ("tool_name", "server_name")


# -- overview and tools -------------------------------------------------------

def overview_of(df: DataFrame) -> DataFrame:
    """One row of headline numbers; zeros when there are no calls."""
    totals = df.agg(
        call_count().alias("total_calls"),
        or_zero(error_rate(F.sum(is_error()), F.nullif(call_count(), F.lit(0)))).alias("error_rate_pct"),
        F.floor(or_zero(F.avg("latency_ms")) + F.lit(0.5)).cast("long").alias("avg_latency_ms"),
        F.count_distinct("server_name").alias("active_servers"),
        or_zero(F.sum(tokens())).alias("total_tokens"),
        or_zero(F.sum("cost_usd")).alias("total_cost_usd"),
    )
    p95 = nearest_rank(df, [], "latency_ms", {"p95": 0.95}).select(or_zero(F.col("p95")).alias("p95"))
    return totals.withColumn("p95_latency_ms", p95.scalar())


def overview(df: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """Headline numbers of the last 24 hours."""
    return overview_of(since(df, as_of, "24h"))


def tool_stats(df: DataFrame) -> DataFrame:
    """Calls, error rate and latency percentiles per tool and server."""
    stats = nearest_rank(df, TOOL, "latency_ms", P50_95_99, sums={"errors": is_error()})
    return stats.withColumn("error_rate_pct", error_rate("errors", "call_count")).drop("errors")


def p95_by_tool(df: DataFrame) -> DataFrame:
    """P95 per tool name across servers, with the server of its fastest call
    (smallest name when several are equally fast)."""
    per_server = df.groupBy(*TOOL).agg(F.min("latency_ms").alias("fastest"))
    fastest = per_server.groupBy("tool_name").agg(F.min(F.struct("fastest", "server_name"))["server_name"].alias("server_name"))
    p95 = nearest_rank(df, ["tool_name"], "latency_ms", {"p95_latency_ms": 0.95}).drop("call_count")
    return p95.join(fastest, "tool_name")


def error_rate_by_tool(df: DataFrame) -> DataFrame:
    return df.groupBy(*TOOL).agg(error_rate(F.sum(is_error()), call_count()).alias("error_rate_pct"))


def server_health_of(df: DataFrame) -> DataFrame:
    """State per server; the thresholds look at the unrounded error rate."""
    return health(nearest_rank(
        df, ["server_name"], "latency_ms", {"p95_latency_ms": 0.95},
        sums={"errors": is_error()}, latest={"last_seen_at": "timestamp"},
    ))


def health(stats: DataFrame) -> DataFrame:
    """State per server from its calls, errors, P95 and last call."""
    stats = stats.withColumn("rate", error_rate("errors", "call_count"))
    status = (
        F.when(F.col("rate") > HEALTH_DOWN_ERROR_PCT, "down")
        .when((F.col("rate") > HEALTH_DEGRADED_ERROR_PCT) | (F.col("p95_latency_ms") > HEALTH_DEGRADED_P95_MS), "degraded")
        .otherwise("healthy")
    )
    return stats.select(
        "server_name", status.alias("status"),
        (F.floor(F.col("rate") * 100 + 0.5) / 100).alias("error_rate_pct"),
        "p95_latency_ms", F.col("call_count").alias("total_calls"), "last_seen_at",
    )


def server_health(df: DataFrame, as_of: datetime | str | Column, width: str = HEALTH_WINDOW) -> DataFrame:
    """State per server seen in the last five minutes (or ``width``)."""
    return server_health_of(within(df, as_of, width))


# -- time series --------------------------------------------------------------

def timeseries(df: DataFrame, aggs: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """15-minute buckets, in no order. Empty buckets are not filled in."""
    grouped = df.withColumn("bucket", bucket()).groupBy(*keys, "bucket")
    return grouped.agg(*[expr.alias(name) for name, expr in aggs.items()])


def tool_latency_series(df: DataFrame) -> DataFrame:
    series = nearest_rank(df.withColumn("bucket", bucket()), [*TOOL, "bucket"], "latency_ms", P50_95)
    return series.drop("call_count")


def tool_error_series(df: DataFrame) -> DataFrame:
    return timeseries(df, {"error_rate_pct": error_rate(F.sum(is_error()), call_count())}, TOOL)


def tool_volume_series(df: DataFrame) -> DataFrame:
    return timeseries(df, {"call_count": call_count()}, TOOL)


def token_series(df: DataFrame) -> DataFrame:
    return timeseries(df, {"input_tokens": F.sum("input_tokens"), "output_tokens": F.sum("output_tokens")})


def cost_series(df: DataFrame) -> DataFrame:
    return timeseries(df, {"cost_usd": F.sum("cost_usd")})


def error_class_series(df: DataFrame) -> DataFrame:
    """Failed calls per bucket, one column per class. An unclassified failure
    makes its bucket appear but has no column."""
    return timeseries(failed(df), {name: F.count_if(F.col("error_class") == name) for name in ERROR_CLASSES})


# -- tokens and cost ----------------------------------------------------------

def _usage(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        call_count().alias("call_count"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum(tokens()).alias("total_tokens"),
        F.sum("cost_usd").alias("cost_usd"),
    )


def token_usage_by_node(df: DataFrame) -> DataFrame:
    """Usage per node, a (server, tool) pair; heaviest first."""
    return _usage(df, NODE).orderBy(F.desc("total_tokens"), *NODE)


def token_usage_by_agent_type(df: DataFrame) -> DataFrame:
    return _usage(df, ["agent_type"]).orderBy(F.desc("total_tokens"), "agent_type")


def cost_by_node(df: DataFrame) -> DataFrame:
    """Cost per node, most expensive first."""
    return _usage(df, NODE).drop("total_tokens").orderBy(F.desc("cost_usd"), *NODE)


def cost_by_session(df: DataFrame, sessions: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` most expensive sessions. Calls are summed, and the top ``n``
    taken, before the session columns are joined on; the sessions table is
    first reduced to those ``n``, so it is read but not shuffled. The top
    rows are written down, since they are used twice and a second summing of
    doubles might rank a close pair differently."""
    top = cut_lineage(df.groupBy("session_id").agg(
        call_count().alias("call_count"),
        F.sum("cost_usd").alias("cost_usd"),
        F.sum(tokens()).alias("total_tokens"),
    ).orderBy(F.desc("cost_usd"), "session_id").limit(n))
    details = sessions.select(F.col("id").alias("session_id"), "server_name", "started_at", "label")
    details = details.join(top.select("session_id"), "session_id", "left_semi")
    return top.join(details, "session_id", "left").orderBy(F.desc("cost_usd"), "session_id")


def cost_totals(df: DataFrame) -> DataFrame:
    """Total cost and tokens, number of active nodes and the costliest node."""
    nodes = _usage(df, NODE)
    costliest = F.min_by(F.struct(*NODE), F.struct(-F.col("cost_usd"), *NODE))
    return nodes.agg(
        or_zero(F.sum("cost_usd")).alias("total_cost_usd"),
        or_zero(F.sum("total_tokens")).alias("total_tokens"),
        call_count().alias("active_nodes"),
        costliest.alias("top"),
    ).select("total_cost_usd", "total_tokens", "active_nodes",
             F.col("top.server_name").alias("top_server_name"), F.col("top.tool_name").alias("top_tool_name"))


# -- errors and counts --------------------------------------------------------

def errors_by_class(df: DataFrame) -> DataFrame:
    """Failed calls per class, and the class's share of them in percent."""
    label = F.coalesce(F.col("error_class"), F.lit("unclassified"))
    counts = failed(df).groupBy(label.alias("error_class")).agg(call_count().alias("count"))
    # there are as many rows as classes, four at most
    return counts.withColumn("share_pct", F.col("count") / F.sum("count").over(Window.partitionBy()) * 100)


def sessions_total(sessions: DataFrame, server_name: str | None = None) -> DataFrame:
    """Number of sessions, optionally of one server. An agent-type filter on
    the session list does not change it."""
    if server_name:
        sessions = sessions.where(F.col("server_name") == server_name)
    return sessions.agg(F.count_distinct("id").alias("total"))


def alerts_total(alerts: DataFrame) -> DataFrame:
    return alerts.agg(call_count().alias("total"))
