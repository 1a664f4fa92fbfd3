"""Queries: intake, capture, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from callscope.operators import sessions as ops
from callscope.plans import testdata, wiredata
from callscope.plans.catalog import query
from callscope.plans.testdata import WITH_CALLS, stamp
from callscope.plans.wiredata import WITH_LOG
from callscope.session import new_folder
from callscope.sources import capture, events, rpclog, tables

# -- intake ---------------------------------------------------------------------

_EVENT_FIELDS = """id, case when id % 7 = 3 then '' when id % 7 = 4 then null else session_id end as session_id,
 case when id % 5 = 2 and id % 3 = 0 then '' else tool_name end as tool_name"""


def _event_lines(spark, sf):
    """JSON event lines with some required fields blank or missing."""
    calls = testdata.raw_calls(testdata.events(spark, sf))
    session = F.when(F.col("id") % 7 == 3, "").when(F.col("id") % 7 == 4, None).otherwise(F.col("session_id"))
    tool = F.when((F.col("id") % 5 == 2) & (F.col("id") % 3 == 0), "").otherwise(F.col("tool_name"))
    return calls.select("id", F.to_json(F.struct(
        session.alias("sessionId"), F.col("agent_type").alias("agentType"), F.col("server_name").alias("serverName"), tool.alias("toolName"),
        "method", F.parse_json("arguments").alias("arguments"), F.col("response.size_bytes").alias("response"), "status",
        F.col("latency_ms").alias("latencyMs"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.col("error_msg").alias("errorMsg"), F.col("error_code").alias("errorCode"),
    )).alias("value"))


_EVENT_SQL = f"""select id, session_id, tool_name, replace(arguments, ' ', '') as arguments, cast(response_bytes as varchar) as response,
 status, cast(latency_ms as bigint) as latency_ms, {stamp('timestamp')} as timestamp, cast(error_code as bigint) as error_code, error_msg
 from (select {_EVENT_FIELDS}, arguments, response_bytes, status, latency_ms, timestamp, error_code, error_msg from calls) e"""
_EVENT_OUT = ("id", "session_id", "tool_name", "arguments", "response", "status", "latency_ms", "timestamp",
              "error_code", "error_msg")
_OK = "coalesce(session_id, '') <> '' and coalesce(tool_name, '') <> ''"


@query("parse_events", WITH_CALLS + _EVENT_SQL)
def _parse(spark, sf):
    return events.parse_events(_event_lines(spark, sf), keep=("id",)).select(*_EVENT_OUT)


@query("read_events", WITH_CALLS + f"select * exclude (id) from ({_EVENT_SQL})")
def _read(spark, sf):
    folder = new_folder(spark, "events")
    _event_lines(spark, sf).select("value").write.text(folder)
    return events.read_events(spark, folder).select(*_EVENT_OUT[1:])


@query("validate_events_valid", WITH_CALLS + f"select id, session_id, tool_name from ({_EVENT_SQL}) where {_OK}")
def _valid(spark, sf):
    valid, _ = events.validate_events(events.parse_events(_event_lines(spark, sf), keep=("id",)))
    return valid.select("id", "session_id", "tool_name")


@query("validate_events_rejected", WITH_CALLS + f"""select id, session_id, tool_name,
 'an event needs a session, a tool and a time' as reason from ({_EVENT_SQL}) where not ({_OK})""")
def _rejected(spark, sf):
    _, rejected = events.validate_events(events.parse_events(_event_lines(spark, sf), keep=("id",)))
    return rejected.select("id", "session_id", "tool_name", "reason")


@query("write_tool_calls", WITH_CALLS + f"""select id, session_id, agent_type, server_name, tool_name, method, arguments, status,
 cast(latency_ms as bigint) as latency_ms, {stamp('timestamp')} as timestamp, input_tokens, output_tokens,
 round(cost_usd, 6) as cost_usd, error_class, strftime(timestamp, '%Y-%m-%d') as day from calls""")
def _write(spark, sf):
    folder = new_folder(spark, "tool-calls")
    tables.write_tool_calls(testdata.calls(spark, sf), folder)
    return tables.read_tool_calls(spark, folder).select(
        "id", "session_id", "agent_type", "server_name", "tool_name", "method", "arguments", "status", "latency_ms",
        "timestamp", "input_tokens", "output_tokens", "cost_usd", "error_class", F.col("date").cast("string").alias("day"))


# -- capture --------------------------------------------------------------------

_PAIRS = """, valid as (select conn, direction, seq, ts, case when json_valid(line) then line end as line from rpc_log),
 messages as (select *, cast(json_extract(line, '$.id') as varchar) as rpc_id,
  coalesce(json_extract_string(line, '$.method'), '') as method from valid where line is not null),
 eligible as (select * from messages where rpc_id is not null and (direction = 'agent') = (method <> '')),
 lagged as (select *, lag(direction) over w as open_direction, lag(seq) over w as open_seq, lag(ts) over w as open_ts,
  lag(line) over w as open_line, lag(method) over w as open_method from eligible
  window w as (partition by conn, rpc_id order by ts, direction, seq)),
 pairs as (select conn, rpc_id, open_seq as request_seq, seq as response_seq, open_method as method, open_ts as timestamp,
  (epoch_us(ts) // 1000) - (epoch_us(open_ts) // 1000) as latency_ms, open_line as request, line as response from lagged
  where direction = 'server' and open_direction = 'agent') """


@query("pair_rpc_log", WITH_LOG + _PAIRS + f"""select conn, rpc_id, request_seq, response_seq, method, latency_ms, {stamp('timestamp')} as timestamp,
 cast(json_extract(response, '$.result') as varchar) as result, cast(json_extract(response, '$.error') as varchar) as error from pairs""")
def _pair(spark, sf):
    return capture.pair_rpc_log(wiredata.rpc_log(spark, sf)).select(
        "conn", "rpc_id", "request_seq", "response_seq", "method", "latency_ms", "timestamp", "result", "error")


_FILE_PAIRS_SQL = WITH_LOG + _PAIRS + f"""select conn, rpc_id, method, latency_ms, {stamp('timestamp')} as timestamp,
 cast(json_extract(response, '$.result') as varchar) as result, cast(json_extract(response, '$.error') as varchar) as error from pairs"""


@query("pair_rpc_log_files", _FILE_PAIRS_SQL)
def _pair_files(spark, sf):
    """From text files, split into ranges and numbered by place."""
    log = rpclog.read_rpc_log(spark, wiredata.write_log_files(spark, sf), wiredata.LOG_FILES, split_bytes=1 << 20)
    return capture.pair_rpc_log(log).select("conn", "rpc_id", "method", "latency_ms", "timestamp", "result", "error")


_FAILED = "json_extract(response, '$.error') is not null"
_STDIO = """case when method = 'tools/call' then coalesce(json_extract_string(request, '$.params.name'), method) else method end as tool_name,
 cast(json_extract(request, '$.params.arguments') as varchar) as arguments, cast(json_extract(response, '$.result') as varchar) as response"""
_MUX = """json_extract_string(request, '$.params.name') as tool_name,
 concat('{"arguments":', cast(json_extract(request, '$.params.arguments') as varchar), ',"name":', cast(json_extract(request, '$.params.name') as varchar), '}') as arguments,
 cast(coalesce(json_extract(response, '$.error'), json_extract(response, '$.result')) as varchar) as response"""
_SDK = """method as tool_name,
 concat('{"arguments":', cast(json_extract(request, '$.params.arguments') as varchar), ',"name":', cast(json_extract(request, '$.params.name') as varchar), '}') as arguments,
 cast(json_extract(response, '$.result') as varchar) as response"""


def _capture_sql(agent: str, fields: str, message: str, code: str, where: str = "") -> str:
    return WITH_LOG + _PAIRS + f"""select request_seq, '{agent}' as agent_type, conn as server_name, method, {fields},
     case when {_FAILED} then 'error' else 'success' end as status, latency_ms, {stamp('timestamp')} as timestamp,
     {message} as error_msg, {code} as error_code from pairs {where}"""


_CODE = "cast(json_extract(response, '$.error.code') as bigint)"
_CAPTURES = {
    "stdio": _capture_sql("mcp-stdio", _STDIO, "json_extract_string(response, '$.error.message')", _CODE),
    "http": _capture_sql("mcp-http", _STDIO, "json_extract_string(response, '$.error.message')", _CODE),
    "multiplexed": _capture_sql("agent-proxy", _MUX, "cast(json_extract(response, '$.error') as varchar)", _CODE,
                                "where method = 'tools/call'"),
    "sdk": _capture_sql("python-sdk", _SDK, "cast(json_extract(response, '$.error') as varchar)", "cast(null as bigint)"),
}
for _source, _sql in _CAPTURES.items():
    query(f"capture_{_source}", _sql)(
        lambda spark, sf, source=_source: capture.map_capture_fields(
            capture.pair_rpc_log(wiredata.rpc_log(spark, sf)), source,
        ).drop("rpc_id", "response_seq", "response_ts")
    )


@query("calls_from_http", f"with exchanges as ({wiredata.EXCHANGES_SQL})" + f""", parsed as (
 select *, coalesce(json_extract_string(request_body, '$.method'), '') as method from
  (select * replace (case when json_valid(request_body) then request_body end as request_body) from exchanges) where request_body is not null)
select id, 'mcp-http' as agent_type, server as server_name, method,
 case when proxy_error is null and method = 'tools/call' then coalesce(json_extract_string(request_body, '$.params.name'), method) else method end as tool_name,
 case when proxy_error is null then cast(json_extract(request_body, '$.params.arguments') as varchar)
  when json_extract(request_body, '$.params') is not null then concat('{{"arguments":', cast(json_extract(request_body, '$.params.arguments') as varchar),
   ',"name":', cast(json_extract(request_body, '$.params.name') as varchar), '}}') end as arguments,
 case when proxy_error is null then cast(json_extract(response_body, '$.result') as varchar) end as response,
 case when proxy_error is not null or json_extract(response_body, '$.error') is not null then 'error' else 'success' end as status,
 (epoch_us(t1) // 1000) - (epoch_us(t0) // 1000) as latency_ms, {stamp('t0')} as timestamp,
 case when proxy_error is not null then proxy_error else json_extract_string(response_body, '$.error.message') end as error_msg,
 case when proxy_error is null then cast(json_extract(response_body, '$.error.code') as bigint) end as error_code,
 proxy_error is not null as lost
from parsed where method <> ''""".replace("response_body, '$", "case when response_body <> '' then response_body end, '$"))
def _http(spark, sf):
    return capture.calls_from_http(wiredata.exchanges(spark, sf))


# -- sessions -------------------------------------------------------------------

_SESSION_OUT = f"id, server_name, {stamp('started_at')} as started_at, {stamp('ended_at')} as ended_at, label"
query("derive_sessions", WITH_CALLS + f"select {_SESSION_OUT} from sessions")(testdata.sessions)


def _known(spark, sf):
    known = testdata.events(spark, sf).where("event_type = 'purchase'")
    return ops.derive_sessions(testdata.raw_calls(known)).withColumn("label", F.lit("known"))


_KNOWN_SQL = """, known as (select session_id as id, server_name, timestamp as started_at, cast(null as timestamp) as ended_at, 'known' as label from
 (select c.*, row_number() over (partition by session_id order by id) as rn from raw_calls c join events e on e.event_id = c.id
  where e.event_type = 'purchase') where rn = 1) """


@query("merge_sessions", WITH_CALLS + _KNOWN_SQL + f"""select {_SESSION_OUT} from known union all
 select {_SESSION_OUT} from sessions s where not exists (select 1 from known k where k.id = s.id)""")
def _merge(spark, sf):
    return ops.merge_sessions(_known(spark, sf), testdata.raw_calls(testdata.events(spark, sf)))


@query("apply_session_ends", WITH_CALLS + f""", ends as (select case when status = 'error' then 'unknown' else session_id end as session_id,
  max(timestamp) as ended from calls where status <> 'success' group by 1)
 select id, server_name, {stamp('started_at')} as started_at, {stamp('ended')} as ended_at, label
 from sessions s left join ends e on e.session_id = s.id""")
def _ends(spark, sf):
    session = F.when(F.col("status") == "error", "unknown").otherwise(F.col("session_id"))
    ends = testdata.calls(spark, sf).where("status <> 'success'").select(
        session.alias("session_id"), F.col("timestamp").alias("ended_at"))
    return ops.apply_session_ends(testdata.sessions(spark, sf), ends)


_LIST = f"""select s.id, s.server_name, {stamp('s.started_at')} as started_at, {stamp('s.ended_at')} as ended_at, s.label, count(c.id) as call_count
 from sessions s left join calls c on c.session_id = s.id {{where}} group by s.id, s.server_name, s.started_at, s.ended_at, s.label
 order by s.started_at desc, s.id {{page}}"""


def _list(spark, sf, **options):
    return ops.list_sessions(testdata.sessions(spark, sf), testdata.calls(spark, sf), **options)


@query("list_sessions", WITH_CALLS + _LIST.format(where="", page="limit 20"))
def _list_default(spark, sf):
    return _list(spark, sf)


@query("list_sessions_page", WITH_CALLS + _LIST.format(where="where s.server_name = 'srv2' and c.agent_type = 'mcp-http'", page="limit 25 offset 10"))
def _list_page(spark, sf):
    return _list(spark, sf, limit=25, offset=10, server_name="srv2", agent_type="mcp-http")


@query("sessions_total", WITH_CALLS + "select count(distinct id) as total from sessions")
def _total(spark, sf):
    from callscope.operators.metrics import sessions_total

    return sessions_total(testdata.sessions(spark, sf))


@query("sessions_total_of_server", WITH_CALLS + "select count(distinct id) as total from sessions where server_name = 'srv2'")
def _total_server(spark, sf):
    from callscope.operators.metrics import sessions_total

    return sessions_total(testdata.sessions(spark, sf), "srv2")


@query("replay", WITH_CALLS + f"""select c.id, c.session_id, s.server_name as session_server_name, {stamp('s.started_at')} as started_at,
 c.tool_name, c.status, cast(c.latency_ms as bigint) as latency_ms, {stamp('c.timestamp')} as timestamp
 from calls c join sessions s on s.id = c.session_id where c.session_id = (select session_id from calls order by id limit 1) order by c.timestamp, c.id""")
def _replay(spark, sf):
    calls = testdata.calls(spark, sf)
    return ops.replay(testdata.sessions(spark, sf), calls, testdata.first_session(calls)).select(
        "id", "session_id", "session_server_name", "started_at", "tool_name", "status", "latency_ms", "timestamp")


@query("call_timeline", WITH_CALLS + """select id, session_id, round(latency_ms / cast(m as double) * 100, 6) as latency_pct,
 round(greatest(ln(latency_ms + 1.0) / ln(m + 1.0) * 100, 3.0), 6) as log_pct
 from (select *, greatest(max(latency_ms) over (partition by session_id), 1) as m from calls)""")
def _timeline(spark, sf):
    return ops.call_timeline(testdata.calls(spark, sf)).select("id", "session_id", "latency_pct", "log_pct")


# -- sessions by idle gap ----------------------------------------------------------

def _gap_sql(gap_ms: int, request_points: str, opens: str) -> str:
    return WITH_CALLS + f""", methods as (select *, case when id % 11 = 0 then 'initialize' else method end as m from calls),
 points as ({request_points} select server_name as conn, id, epoch_us(timestamp) // 1000 + latency_ms as t, 1 as kind, {opens} as init from methods),
 flagged as (select *, case when lag(t) over w is null or init or t - lag(t) over w > {gap_ms} then 1 else 0 end as opened
  from points window w as (partition by conn order by t, kind, id)),
 numbered as (select *, sum(opened) over (partition by conn order by t, kind, id rows unbounded preceding) as n from flagged)
 select id, concat(conn, '#', cast(n as bigint)) as session_id from numbered where kind = 1"""


_REQUEST_POINTS = "select server_name as conn, id, epoch_us(timestamp) // 1000 as t, 0 as kind, m = 'initialize' as init from methods union all"


def _with_init(spark, sf):
    method = F.when(F.col("id") % 11 == 0, "initialize").otherwise(F.col("method"))
    return testdata.raw_calls(testdata.events(spark, sf)).drop("session_id").withColumn("method", method)


@query("sessionize", _gap_sql(300_000, _REQUEST_POINTS, "false"))
def _sessionize(spark, sf):
    return ops.sessionize(_with_init(spark, sf)).select("id", "session_id")


@query("sessionize_6h_gap", _gap_sql(21_600_000, _REQUEST_POINTS, "false"))
def _sessionize_6h(spark, sf):
    return ops.sessionize(_with_init(spark, sf), gap="6 hours").select("id", "session_id")


@query("sessionize_http", _gap_sql(300_000, "", "m = 'initialize'"))
def _sessionize_http(spark, sf):
    return ops.sessionize(_with_init(spark, sf), request_activity=False).select("id", "session_id")


# The recorded exchanges themselves: an initialize that never reached the server opens no session.
@query("sessionize_http_log", f"with exchanges as ({wiredata.EXCHANGES_SQL})" + """, points as (
  select id, server, epoch_us(t1) // 1000 as t, json_extract_string(request_body, '$.method') = 'initialize' and proxy_error is null as init
  from (select * replace (case when json_valid(request_body) then request_body end as request_body) from exchanges) where request_body is not null),
 flagged as (select *, case when lag(t) over w is null or init or t - lag(t) over w > 300000 then 1 else 0 end as opened
  from points window w as (partition by server order by t, id))
select id, concat(server, '#', cast(sum(opened) over (partition by server order by t, id rows unbounded preceding) as bigint)) as session_id from flagged""")
def _sessionize_http_log(spark, sf):
    calls = capture.calls_from_http(wiredata.exchanges(spark, sf))
    return ops.sessionize(calls, request_activity=False).select("id", "session_id")


# Closing a connection: here each timed-out call closes it at its end.
_ENDS = """, methods as (select *, case when id % 11 = 0 then 'initialize' else method end as m from calls),
 points as (select server_name as conn, id, epoch_us(timestamp) // 1000 as t, 0 as kind, m = 'initialize' as init from methods
  union all select server_name, id, epoch_us(timestamp) // 1000 + latency_ms, 1, false from methods
  union all select server_name, null, epoch_us(timestamp) // 1000 + latency_ms, 2, false from methods where status = 'timeout'),
 lagged as (select *, lag(t) over w as last_t, lag(kind) over w as last_kind from points window w as (partition by conn order by t, kind, id)),
 flagged as (select *, case when kind < 2 and (last_t is null or last_kind = 2 or init or t - last_t > 21600000) then 1 else 0 end as opened from lagged),
 numbered as (select *, sum(opened) over (partition by conn order by t, kind, id rows unbounded preceding) as n from flagged) """


def _closings(spark, sf):
    closed = F.timestamp_millis(F.unix_millis(F.col("timestamp").cast("timestamp")) + F.col("latency_ms"))
    return _with_init(spark, sf).where("status = 'timeout'").select(
        F.col("server_name").alias("conn"), closed.alias("ended_at"))


@query("sessionize_with_ends", WITH_CALLS + _ENDS + "select id, concat(conn, '#', cast(n as bigint)) as session_id from numbered where kind = 1")
def _sessionize_ends(spark, sf):
    return ops.sessionize(_with_init(spark, sf), gap="6 hours", ends=_closings(spark, sf)).select("id", "session_id")


@query("session_ends", WITH_CALLS + _ENDS + f"""select concat(conn, '#', cast(n as bigint)) as session_id, {stamp('make_timestamp(t * 1000)')} as ended_at
 from numbered where kind = 2 and n > 0 and last_kind <> 2""")
def _session_ends(spark, sf):
    return ops.session_ends(_with_init(spark, sf), _closings(spark, sf), gap="6 hours")


# From the wire log to sessions: unanswered requests keep a session alive, too.
@query("sessionize_wire_log", WITH_LOG + _PAIRS + """, points as (
  select conn, cast(null as bigint) as id, epoch_us(ts) // 1000 as t, 0 as kind, method = 'initialize' as init from eligible where direction = 'agent'
  union all select conn, request_seq, (epoch_us(timestamp) // 1000) + latency_ms, 1, false from pairs),
 flagged as (select *, case when lag(t) over w is null or init or t - lag(t) over w > 300000 then 1 else 0 end as opened
  from points window w as (partition by conn order by t, kind, id)),
 numbered as (select *, sum(opened) over (partition by conn order by t, kind, id rows unbounded preceding) as n from flagged)
 select id, concat(conn, '#', cast(n as bigint)) as session_id from numbered where kind = 1""")
def _sessionize_log(spark, sf):
    log = wiredata.rpc_log(spark, sf)
    calls = capture.map_capture_fields(capture.pair_rpc_log(log), "stdio").withColumnRenamed("request_seq", "id")
    return ops.sessionize(calls, touches=capture.request_touches(log)).select("id", "session_id")
