"""Event intake: JSON events from files, streams or message lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.schema import EVENT_JSON, SESSION_END_JSON
from callscope.session import allow_duplicate_json_keys

REQUIRED = ("session_id", "tool_name", "timestamp_text")
REJECT_REASON = "an event needs a session, a tool and a time"
# Columns of the calls table that may be empty but never NULL.
NOT_NULL = ("agent_type", "server_name", "method", "status", "latency_ms")
INCOMPLETE_REASON = "a value the table needs is missing or unreadable: agentType, serverName, method, status or latencyMs"

_NAMES = {
    "sessionId": "session_id", "agentType": "agent_type", "serverName": "server_name", "toolName": "tool_name",
    "method": "method", "status": "status", "errorMsg": "error_msg", "errorCode": "error_code",
    "_corrupt_record": "unparsed",
}


def _to_calls(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Event fields under table names; payloads become compact JSON text.

    Latencies are whole milliseconds; one that is no number a bigint holds reads as missing. ``unparsed`` is the line itself when it
    is not JSON, so that nothing is lost in quarantine. ``timestamp_text`` keeps the received text for validation; ``timestamp``
    is the instant it stands for, whatever offset it was written with.
    """
    def payload_text(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.to_json(F.col(name))).alias(name)

    return df.select(
        *keep,
        *[F.col(source).alias(name) for source, name in _NAMES.items()],
        F.round("latencyMs").try_cast("long").alias("latency_ms"),
        payload_text("arguments"),
        payload_text("response"),
        F.col("timestamp").alias("timestamp_text"),
        F.try_to_timestamp("timestamp").alias("timestamp"),
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events from JSON lines files."""
    allow_duplicate_json_keys(spark)
    return _to_calls(spark.read.schema(EVENT_JSON).json(path))


def stream_events(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """The same as a stream over a folder that receives JSON lines files."""
    allow_duplicate_json_keys(spark)
    reader = spark.readStream.schema(EVENT_JSON).option("maxFilesPerTrigger", max_files_per_trigger)
    return _to_calls(reader.json(path))


def stream_session_ends(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """End markers of sessions as a stream over a folder that receives JSON lines ``{"sessionId", "endedAt"}``."""
    reader = spark.readStream.schema(SESSION_END_JSON).option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(path)


def validate_session_ends(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into (``session_id``, ``ended_at``) and rejected lines: those without a session or a readable time."""
    parsed = df.withColumn("ended_at", F.try_to_timestamp("endedAt"))
    usable = ~_blank("sessionId") & F.col("ended_at").isNotNull()
    return parsed.where(usable).select(F.col("sessionId").alias("session_id"), "ended_at"), parsed.where(~usable).drop("ended_at")


def parse_events(df: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Events from a text column, such as the value of a message queue record."""
    allow_duplicate_json_keys(df.sparkSession)
    parsed = F.from_json(F.col(column).cast("string"), EVENT_JSON)
    return _to_calls(df.select(*keep, parsed.alias("e")).select(*keep, "e.*"), keep)


def _blank(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def validate_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into (valid, rejected).

    An event needs a session id, a tool name and a timestamp; missing and
    empty are the same, blanks are not trimmed. The remaining values that the
    table requires may be empty but not missing, so a stored call has no NULL
    in a key column. Rejects carry a reason. A timestamp that is present but
    unreadable is rejected too, since the table stores instants and not text.
    """
    missing, incomplete = F.lit(False), F.lit(False)
    for column in REQUIRED:
        missing = missing | _blank(column)
    for column in NOT_NULL:
        incomplete = incomplete | F.col(column).isNull()
    reason = (
        F.when(missing, REJECT_REASON).when(incomplete, INCOMPLETE_REASON)
        .when(F.col("timestamp").isNull(), "unreadable timestamp")
    )
    judged = df.withColumn("reason", reason)
    return judged.where(F.col("reason").isNull()).drop("reason", "timestamp_text", "unparsed"), judged.where(F.col("reason").isNotNull())
