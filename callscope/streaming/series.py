"""Windowed streams over calls: series, percentiles, sessions, and the join of requests with responses.

Late calls are dropped once the watermark has passed their window; a batch run
over the stored table is the way to correct such a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.config import SERIES_BUCKET, SESSION_GAP
from callscope.functions.measures import call_count, elapsed_ms, error_rate, is_error
from callscope.functions.percentile import rank_index
from callscope.session import use_rocksdb
from callscope.sources.capture import request_fields, response_fields, rpc_messages

NODE = ("server_name", "tool_name")
LATE = "10 minutes"
# Length of the join's spans of time, in limits: a line meets those of its id and span, and one request in so many lies in two.
SPAN = 4


def stream_timeseries(calls: DataFrame, keys: Sequence[str] = NODE, late: str = LATE) -> DataFrame:
    """Closed 15-minute buckets per node: calls, error rate, tokens, cost and
    failed calls by class."""
    failed_as = lambda name: F.count_if((F.col("status") != "success") & (F.col("error_class") == name))
    grouped = calls.withWatermark("timestamp", late).groupBy(F.window("timestamp", SERIES_BUCKET), *keys)
    return grouped.agg(
        call_count().alias("call_count"),
        error_rate(F.sum(is_error()), call_count()).alias("error_rate_pct"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost_usd").alias("cost_usd"),
        failed_as("hallucination").alias("hallucination"), failed_as("tool_failure").alias("tool_failure"),
        failed_as("timeout").alias("timeout"),
    ).select(F.col("window.start").alias("bucket"), *keys, "call_count", "error_rate_pct", "input_tokens",
             "output_tokens", "cost_usd", "hallucination", "tool_failure", "timeout")


def stream_latency_percentiles(calls: DataFrame, keys: Sequence[str] = NODE, late: str = LATE) -> DataFrame:
    """Exact nearest-rank P50 and P95 per node and closed bucket.

    Two chained aggregations: calls are counted per latency value first, then
    each bucket's small histogram is walked. State holds counts, never calls.
    """
    counted = (
        calls.withWatermark("timestamp", late)
        .groupBy(F.window("timestamp", SERIES_BUCKET), *keys, "latency_ms")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    histogram = counted.groupBy("window", *keys).agg(
        F.sort_array(F.collect_list(F.struct("latency_ms", "n"))).alias("h"), F.sum("n").alias("call_count"))
    return histogram.select(
        F.col("window.start").alias("bucket"), *keys, "call_count",
        _rank(F.col("h"), F.col("call_count"), 0.50).alias("p50_latency_ms"),
        _rank(F.col("h"), F.col("call_count"), 0.95).alias("p95_latency_ms"),
    )


def _rank(histogram: Column, total: Column, p: float) -> Column:
    """First value whose running count passes the rank, in a sorted histogram."""
    index = rank_index(total, p)
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("value"))

    def step(state: Column, entry: Column) -> Column:
        seen = state["seen"] + entry["n"]
        value = F.coalesce(state["value"], F.when(seen > index, entry["latency_ms"]))
        return F.struct(seen.alias("seen"), value.alias("value"))

    return F.aggregate(histogram, start, step)["value"]


def stream_sessions(calls: DataFrame, connection: str = "server_name", gap: str = SESSION_GAP, late: str = LATE) -> DataFrame:
    """Sessions by idle gap over request and response times, once closed.

    Splits at ``initialize`` need the order of all calls; the batch job
    ``sessionize`` does them exactly.
    """
    response = F.col("timestamp").cast("timestamp") + F.make_dt_interval(secs=F.col("latency_ms") / F.lit(1000).cast("decimal(18,6)"))
    points = F.array(
        F.struct(F.col("timestamp").cast("timestamp").alias("at"), F.lit(0).alias("kind")),
        F.struct(response.alias("at"), F.lit(1).alias("kind")),
    )
    activity = calls.select(F.col(connection).alias("conn"), F.explode(points).alias("p")).select("conn", "p.at", "p.kind")
    sessions = activity.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "conn").agg(
        F.count_if(F.col("kind") == 1).alias("call_count"), F.max("at").alias("last_activity"))
    return sessions.select("conn", F.col("w.start").alias("started_at"), "last_activity", "call_count")


def stream_join_rpc(log: DataFrame, limit: str = "1 hour", late: str = LATE) -> DataFrame:
    """Requests with the responses of at most ``limit`` later, as a join of two streams of the log.

    Everything runs in the JVM, and any number of tasks shares a busy connection or a busy id, since ids and spans of time
    spread it. State lies in RocksDB: all lines of a micro-batch are in it. Lines later than ``late`` are dropped, and a
    request is forgotten once the watermark is ``limit`` past it, answered or not. Equal to ``pair_rpc_log`` where a
    connection uses an id once within ``limit``; where it may use one again sooner, ``stream_pair_rpc`` or the carried form
    pair by order.
    """
    use_rocksdb(log.sparkSession)

    def side(messages: DataFrame, is_request: bool) -> DataFrame:
        return messages.where(F.col("is_request") == is_request).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)

    message = F.col("_message")
    requests = side(rpc_messages(log), True).select(
        "conn", "rpc_id", F.col("seq").alias("request_seq"), F.col("ts").alias("timestamp"), *request_fields(message))
    responses = side(rpc_messages(log), False).select(
        F.col("conn").alias("_conn"), F.col("rpc_id").alias("_rpc_id"), F.col("seq").alias("response_seq"), F.col("ts").alias("response_ts"),
        *response_fields(message))
    last = F.col("timestamp") + F.expr(f"interval {limit}")
    in_time = (F.col("response_ts") >= F.col("timestamp")) & (F.col("response_ts") <= last)
    # A response lies in one span of time; a request goes to the one or two spans in which its responses may lie.
    requests = requests.withColumn("_span", F.explode(F.array_distinct(F.array(_span(F.col("timestamp"), limit), _span(last, limit)))))
    responses = responses.withColumn("_response_span", _span(F.col("response_ts"), limit))
    same = (F.col("conn") == F.col("_conn")) & (F.col("rpc_id") == F.col("_rpc_id")) & (F.col("_span") == F.col("_response_span"))
    pairs = requests.join(responses, same & in_time)
    return pairs.drop("_conn", "_rpc_id", "_span", "_response_span").withColumn("latency_ms", elapsed_ms("timestamp", "response_ts"))


def _span(at: Column, limit: str) -> Column:
    """First microsecond of the span of time that ``at`` lies in; a span is ``SPAN`` times the limit."""
    width = F.greatest(F.expr(f"unix_micros(timestamp_micros(0) + interval {limit})") * F.lit(SPAN), F.lit(1))
    return F.unix_micros(at) - F.pmod(F.unix_micros(at), width)
