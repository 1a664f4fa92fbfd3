"""Table schemas and the column upgrade for older tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESPONSE = T.StructType([
    T.StructField("data", T.StringType()),
    T.StructField("truncated", T.BooleanType()),
    T.StructField("size_bytes", T.LongType()),
])

TOOL_CALLS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("agent_type", T.StringType()),
    T.StructField("server_name", T.StringType()),
    T.StructField("tool_name", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("arguments", T.StringType()),
    T.StructField("response", RESPONSE),
    T.StructField("status", T.StringType()),
    T.StructField("latency_ms", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("error_msg", T.StringType()),
    T.StructField("error_code", T.IntegerType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("cost_usd", T.DoubleType()),
    T.StructField("error_class", T.StringType()),
])

SESSIONS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("server_name", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("ended_at", T.TimestampType()),
    T.StructField("label", T.StringType()),
])

ALERT_EVENTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("tool_name", T.StringType()),
    T.StructField("server_name", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("fired_at", T.TimestampType()),
])

# See operators/rollup.py.
ROLLUP = T.StructType([
    T.StructField("server_name", T.StringType()),
    T.StructField("tool_name", T.StringType()),
    T.StructField("agent_type", T.StringType()),
    T.StructField("bucket", T.TimestampType()),
    T.StructField("latency_ms", T.LongType()),
    *[T.StructField(name, T.LongType()) for name in (
        "calls", "errors", "failed", "hallucination", "tool_failure", "timeout", "input_tokens", "output_tokens")],
    T.StructField("cost_usd", T.DoubleType()),
    T.StructField("last_seen_at", T.TimestampType()),
])

# One JSON line per event. Payloads are schemaless, so they are read as
# variants; a string-typed read would drop the quotes of string payloads.
EVENT_JSON = T.StructType([
    T.StructField("sessionId", T.StringType()),
    T.StructField("agentType", T.StringType()),
    T.StructField("serverName", T.StringType()),
    T.StructField("toolName", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("arguments", T.VariantType()),
    T.StructField("response", T.VariantType()),
    T.StructField("status", T.StringType()),
    T.StructField("latencyMs", T.DoubleType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("errorMsg", T.StringType()),
    T.StructField("errorCode", T.IntegerType()),
    T.StructField("_corrupt_record", T.StringType()),  # the line itself when it is not JSON
])

SESSION_END_JSON = T.StructType([
    T.StructField("sessionId", T.StringType()),
    T.StructField("endedAt", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])

_ADDED_LATER = {
    "error_code": (T.IntegerType(), None),
    "input_tokens": (T.LongType(), 0),
    "output_tokens": (T.LongType(), 0),
    "cost_usd": (T.DoubleType(), 0.0),
    "error_class": (T.StringType(), None),
}


def normalize_schema(df: DataFrame) -> DataFrame:
    """Bring an older calls table to the current columns.

    Columns a table lacks are added with their default; NULL tokens and cost
    read as 0. Running it twice changes nothing.
    """
    columns = {}
    for name, (dtype, default) in _ADDED_LATER.items():
        if name not in df.columns:
            columns[name] = F.lit(default).cast(dtype)
        elif default is not None:
            columns[name] = F.coalesce(F.col(name), F.lit(default).cast(dtype))
    return df.withColumns(columns)
