"""Reports from a maintained histogram instead of the calls.

The rollup has one row per node, agent type, 15-minute bucket and latency, with
how many calls there were, how many failed and how, their tokens and cost. It is
exact: a nearest rank needs no more than how often each latency occurred, and all
other measures add up. A micro-batch adds its own rows (``sources.tables``), and rows
of one key from several batches add up as well, so nothing has to be merged.

A window that begins inside a bucket takes the whole buckets from the rollup and
counts the cut bucket's calls from the calls table (:func:`rows_since`); no other calls
are read. The functions below take such rows and give what the function of the
same name in ``metrics`` gives for the calls.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.config import DEFAULT_SINCE, SINCE_WINDOWS
from callscope.functions.measures import bucket, call_count, error_rate, is_error, or_zero
from callscope.functions.percentile import P50_95, P50_95_99, nearest_rank
from callscope.operators import metrics
from callscope.operators.filters import DATE, instant, within

KEYS = ("server_name", "tool_name", "agent_type", "bucket", "latency_ms")
CLASSES = ("hallucination", "tool_failure", "timeout")
BUCKET_US = 15 * 60 * 1_000_000


def rollup(calls: DataFrame) -> DataFrame:
    """The histogram of calls."""
    failed = F.col("status") != "success"
    return calls.withColumn("bucket", bucket().cast("timestamp")).groupBy(*KEYS).agg(
        call_count().alias("calls"), F.sum(is_error()).alias("errors"), F.count_if(failed).alias("failed"),
        *[F.count_if(failed & (F.col("error_class") == name)).alias(name) for name in CLASSES],
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd"),
        F.max("timestamp").cast("timestamp").alias("last_seen_at"))


def rows_within(rolled: DataFrame, calls: DataFrame, as_of: datetime | str | Column, width: str) -> DataFrame:
    """The histogram of the calls strictly later than ``as_of`` minus ``width``."""
    start = instant(calls, as_of) - F.expr(f"interval {width}")
    micros = F.unix_micros(start.cast("timestamp"))
    edge = F.timestamp_micros((F.floor(micros / F.lit(BUCKET_US)) + 1) * F.lit(BUCKET_US))
    whole = rolled.where(F.col("bucket") >= edge)
    if DATE in rolled.columns:
        whole = whole.where(F.col(DATE) >= F.date_sub(F.to_date(edge), 1)).drop(DATE)
    cut = within(calls, as_of, width).where(F.col("timestamp") < edge.cast(calls.schema["timestamp"].dataType))
    if DATE in calls.columns:
        cut = cut.where(F.col(DATE) <= F.date_add(F.to_date(edge), 1))
    return whole.unionByName(rollup(cut))


def rows_since(rolled: DataFrame, calls: DataFrame, as_of: datetime | str | Column, window: str = DEFAULT_SINCE) -> DataFrame:
    """The histogram of the calls of the last ``1h``, ``6h``, ``24h`` or ``7d``; other names mean 24h."""
    return rows_within(rolled, calls, as_of, SINCE_WINDOWS.get(window, SINCE_WINDOWS[DEFAULT_SINCE]))


def _ranks(rows: DataFrame, keys: Sequence[str], ranks: dict[str, float], **more) -> DataFrame:
    return nearest_rank(rows, keys, "latency_ms", ranks, count=F.sum("calls"), **more)


def overview(rows: DataFrame) -> DataFrame:
    totals = rows.agg(
        or_zero(F.sum("calls")).alias("total_calls"),
        or_zero(error_rate(F.sum("errors"), F.nullif(F.sum("calls"), F.lit(0)))).alias("error_rate_pct"),
        F.floor(or_zero(F.sum(F.col("latency_ms") * F.col("calls")) / F.nullif(F.sum("calls"), F.lit(0))) + F.lit(0.5)).cast("long").alias("avg_latency_ms"),
        F.count_distinct("server_name").alias("active_servers"),
        or_zero(F.sum(F.col("input_tokens") + F.col("output_tokens"))).alias("total_tokens"),
        or_zero(F.sum("cost_usd")).alias("total_cost_usd"),
    )
    p95 = _ranks(rows, [], {"p95": 0.95}).select(or_zero(F.col("p95")).alias("p95"))
    return totals.withColumn("p95_latency_ms", p95.scalar())


def tool_stats(rows: DataFrame) -> DataFrame:
    stats = _ranks(rows, metrics.TOOL, P50_95_99, sums={"errors": F.col("errors")})
    return stats.withColumn("error_rate_pct", error_rate("errors", "call_count")).drop("errors")


def tool_latency_series(rows: DataFrame) -> DataFrame:
    return _ranks(rows, [*metrics.TOOL, "bucket"], P50_95).drop("call_count")


def tool_error_series(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*metrics.TOOL, "bucket").agg(error_rate(F.sum("errors"), F.sum("calls")).alias("error_rate_pct"))


def tool_volume_series(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*metrics.TOOL, "bucket").agg(F.sum("calls").alias("call_count"))


def server_health(rows: DataFrame) -> DataFrame:
    return metrics.health(_ranks(
        rows, ["server_name"], {"p95_latency_ms": 0.95}, sums={"errors": F.col("errors")}, latest={"last_seen_at": "last_seen_at"}))


def _usage(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.sum("calls").alias("call_count"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), F.sum("cost_usd").alias("cost_usd"))


def token_usage_by_node(rows: DataFrame) -> DataFrame:
    return _usage(rows, metrics.NODE).orderBy(F.desc("total_tokens"), *metrics.NODE)


def token_usage_by_agent_type(rows: DataFrame) -> DataFrame:
    return _usage(rows, ["agent_type"]).orderBy(F.desc("total_tokens"), "agent_type")


def cost_by_node(rows: DataFrame) -> DataFrame:
    return _usage(rows, metrics.NODE).drop("total_tokens").orderBy(F.desc("cost_usd"), *metrics.NODE)


def token_series(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def cost_series(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket").agg(F.sum("cost_usd").alias("cost_usd"))


def error_class_series(rows: DataFrame) -> DataFrame:
    """Failed calls per bucket, one column per class; a bucket without failures does not appear."""
    return rows.where("failed > 0").groupBy("bucket").agg(*[F.sum(name).alias(name) for name in CLASSES])
