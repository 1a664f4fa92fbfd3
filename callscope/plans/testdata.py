"""The calls table as a view over the given ``events`` table.

The view is plain SQL that Spark and the oracle database both understand, so
one text defines it for both sides of the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.config import Pricing
from callscope.operators.enrich import enrich
from callscope.operators.sessions import derive_sessions

CALL_COLUMNS = {
    "id": "event_id",
    "session_id": "concat('s', cast(user_id as varchar(10)), '-', cast(day(ts) as varchar(10)))",
    "agent_type": "case user_id % 4 when 0 then 'mcp-stdio' when 1 then 'mcp-http' when 2 then 'python-sdk' else 'agent-proxy' end",
    "server_name": "concat('srv', cast(user_id % 7 as varchar(10)))",
    "tool_name": "concat('tool', cast(event_id % 5 as varchar(10)))",
    "method": "'tools/call'",
    "arguments": "props",
    "status": "case when event_type <> 'error' then 'success' when event_id % 6 = 0 then 'timeout' else 'error' end",
    "latency_ms": "cast(floor(value * 20) as bigint)",
    "timestamp": "ts",
    "error_code": (
        "case when event_type <> 'error' then null when event_id % 6 = 1 then -32601"
        " when event_id % 6 = 2 then -32602 when event_id % 6 = 3 then -32603 end"
    ),
    "error_msg": (
        "case when event_type <> 'error' then null when event_id % 6 = 3 then 'internal error'"
        " when event_id % 6 = 4 then case when event_id % 4 = 0 then 'Unknown tool: foo' else 'Request Timed Out' end"
        " when event_id % 6 = 5 then 'upstream 500' end"
    ),
    "response_bytes": "case when event_type = 'error' then null else 100 + (event_id * 37) % 20000 end",
}
PRICING = Pricing(per_server={"srv1": (1.0, 5.0)})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def raw_calls(source: DataFrame) -> DataFrame:
    """Calls before enrichment, from an events table or stream."""
    calls = source.selectExpr(*[f"{sql} as {name}" for name, sql in CALL_COLUMNS.items()])
    size = F.col("response_bytes").cast("long")
    enveloped = F.struct(
        F.lit(None).cast("string").alias("data"), F.lit(False).alias("truncated"), size.alias("size_bytes"),
    )
    return calls.withColumn("response", F.when(size.isNotNull(), enveloped)).drop("response_bytes")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched calls table."""
    return enrich(raw_calls(events(spark, sf_dir)), PRICING)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_sessions(raw_calls(events(spark, sf_dir)))


def as_of(df: DataFrame, column: str = "timestamp"):
    """Newest time in the table (one value), the reports' reference time."""
    return one(df, F.max(column))


def first_session(df: DataFrame) -> str:
    """The session of the first call (one value)."""
    return one(df, F.min_by("session_id", "id"))


def one(df: DataFrame, aggregate: Column):
    """A single aggregated value."""
    return df.agg(aggregate).first()[0]


def flat(df: DataFrame, digits: int = 6) -> DataFrame:
    """Result columns in types both engines print alike: whole numbers as
    bigint, doubles rounded, times as text."""
    def plain(name: str, dtype: str) -> Column:
        column = F.col(f"`{name}`")
        if dtype in ("int", "smallint", "tinyint"):
            return column.cast("bigint").alias(name)
        if dtype in ("double", "float"):
            return F.round(column.cast("double"), digits).alias(name)
        if dtype in ("timestamp", "timestamp_ntz"):
            return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)
        return column

    return df.select(*[plain(name, dtype) for name, dtype in df.dtypes])


# -- the same tables for the oracle --------------------------------------------

CALLS_SQL = "select " + ", ".join(f"{sql} as {name}" for name, sql in CALL_COLUMNS.items()) + " from events"

ENRICHED_SQL = """
select id, session_id, agent_type, server_name, tool_name, method, cast(json(arguments) as varchar) as arguments, status, latency_ms, timestamp,
 error_code, error_msg, response_bytes, input_tokens, output_tokens,
 input_tokens / 1e6 * case when server_name = 'srv1' then 1.0 else 3.0 end
 + output_tokens / 1e6 * case when server_name = 'srv1' then 5.0 else 15.0 end as cost_usd,
 case when status = 'success' then null when status = 'timeout' then 'timeout'
  when error_code in (-32601, -32602) then 'hallucination'
  when regexp_matches(lower(coalesce(error_msg, '')), 'unknown tool|tool not found|no such tool|unknown method|method not found|unrecognized') then 'hallucination'
  when regexp_matches(lower(coalesce(error_msg, '')), 'timed?\\s*out|timeout|deadline exceeded') then 'timeout'
  else 'tool_failure' end as error_class
from (select *, cast(ceil(octet_length(encode(coalesce(cast(json(arguments) as varchar), 'null'))) / 4.0) as bigint) as input_tokens,
  cast(ceil(coalesce(response_bytes, 0) / 4.0) as bigint) as output_tokens from raw_calls)
"""

SESSIONS_SQL = """
select session_id as id, case when server_name = '' then 'unknown' else server_name end as server_name,
 timestamp as started_at, cast(null as timestamp) as ended_at, cast(null as varchar) as label
from (select *, row_number() over (partition by session_id order by id) as rn from raw_calls) where rn = 1
"""

WITH_CALLS = f"with raw_calls as ({CALLS_SQL}), calls as ({ENRICHED_SQL}), sessions as ({SESSIONS_SQL}) "


def stamp(expression: str) -> str:
    """Oracle text of a time, printed like ``flat`` does."""
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%f')"
