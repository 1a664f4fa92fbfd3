"""Wire logs derived from the given ``events`` table.

Two lines per call, with reused ids (``event_id % 50``), quoted ids,
notifications, broken lines, unanswered requests and several methods, all
spread over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.plans import testdata
from callscope.session import new_folder

_ID = "case when event_type = 'signup' then concat('\"', cast(event_id % 50 as varchar(10)), '\"') else cast(event_id % 50 as varchar(10)) end"
_METHOD = "case when event_id % 11 = 0 then 'initialize' when event_id % 13 = 0 then 'tools/list' else 'tools/call' end"
_REQUEST = (
    "case when event_type = 'purchase' and event_id % 9 = 0 then 'plain text, not a message'"
    f" when event_type = 'view' and event_id % 4 = 0 then concat('{{\"jsonrpc\":\"2.0\",\"method\":\"', {_METHOD}, '\"}}')"
    f" else concat('{{\"jsonrpc\":\"2.0\",\"id\":', {_ID}, ',\"method\":\"', {_METHOD}, '\",\"params\":{{\"name\":\"', tool_name,"
    " '\",\"arguments\":', arguments, '}}') end"
)
_RESPONSE = (
    f"case when status = 'timeout' then '' when status = 'success' then concat('{{\"jsonrpc\":\"2.0\",\"id\":', {_ID},"
    " ',\"result\":{\"bytes\":', cast(response_bytes as varchar(10)), '}}')"
    f" else concat('{{\"jsonrpc\":\"2.0\",\"id\":', {_ID}, ',\"error\":{{\"code\":', cast(coalesce(error_code, -32000) as varchar(10)),"
    " ',\"message\":\"', coalesce(error_msg, 'failed'), '\"}}') end"
)


def _wide_columns() -> str:
    cols = {k: v for k, v in testdata.CALL_COLUMNS.items() if k not in ("id", "timestamp")}
    return "event_id, event_type, ts, " + ", ".join(f"{sql} as {name}" for name, sql in cols.items())


def as_exchanges(events: DataFrame) -> DataFrame:
    """``(id, server, request_body, response_body, proxy_error, t0, t1)``."""
    wide = events.selectExpr(
        "event_id", "event_type", "ts",
        *[f"{sql} as {name}" for name, sql in testdata.CALL_COLUMNS.items() if name not in ("id", "timestamp")])
    return wide.selectExpr(
        "event_id as id", "server_name as server", f"{_REQUEST} as request_body", f"{_RESPONSE} as response_body",
        "case when status = 'timeout' then 'connection refused' end as proxy_error",
        "ts as t0", "timestampadd(MILLISECOND, latency_ms, ts) as t1")


def as_log(exchanges: DataFrame) -> DataFrame:
    """``(conn, direction, seq, ts, line)``, two lines per exchange."""
    def line(direction: str, ts: str, body: str):
        return F.struct(F.lit(direction).alias("direction"), F.col(ts).alias("ts"), F.col(body).alias("line"))

    both = F.array(line("agent", "t0", "request_body"), line("server", "t1", "response_body"))
    return exchanges.select(F.col("server").alias("conn"), F.col("id").alias("seq"), F.explode(both).alias("l")).select(
        "conn", "l.direction", "seq", "l.ts", "l.line")


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_exchanges(testdata.events(spark, sf_dir))


def rpc_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_log(exchanges(spark, sf_dir))


#: Names of the files that :func:`write_log_files` makes.
LOG_FILES = r"conn=(?P<conn>[^/]+)/part-(?P<n>\d+)-[^/]*$"


def write_log_files(spark: SparkSession, sf_dir: str) -> str:
    """The log as text files, in order along a connection's files; the folder they lie in."""
    folder = new_folder(spark, "wire-log")
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    ordered = rpc_log(spark, sf_dir).repartitionByRange("conn", "ts", "seq").sortWithinPartitions("conn", "ts", "seq")
    ordered.select(F.concat_ws("\t", time, "direction", F.coalesce("line", F.lit(""))).alias("value"), "conn").write.partitionBy("conn").text(folder)
    return folder


EXCHANGES_SQL = (
    f"select event_id as id, server_name as server, {_REQUEST} as request_body, {_RESPONSE} as response_body,"
    " case when status = 'timeout' then 'connection refused' end as proxy_error,"
    f" ts as t0, ts + to_milliseconds(latency_ms) as t1 from (select {_wide_columns()} from events)"
)
LOG_SQL = (
    "select server as conn, 'agent' as direction, id as seq, t0 as ts, request_body as line from exchanges"
    " union all select server, 'server', id, t1, response_body from exchanges"
)
WITH_LOG = f"with exchanges as ({EXCHANGES_SQL}), rpc_log as ({LOG_SQL}) "
