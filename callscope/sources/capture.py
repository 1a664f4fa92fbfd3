"""Captured JSON-RPC traffic to calls.

``pair_rpc_log`` matches requests with responses, ``calls_from_http`` reads
recorded HTTP exchanges, ``map_capture_fields`` applies the field rules of the
capture source. Payloads travel as JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.measures import elapsed_ms
from callscope.functions.ordered import in_chunks, previous
from callscope.functions.payload import bound, field, field_text, text_or_null, truthy
from callscope.session import allow_duplicate_json_keys, cut_lineage

CALL_METHOD = "tools/call"
# Agent type recorded by each capture source.
AGENT_TYPES = {"stdio": "mcp-stdio", "http": "mcp-http", "multiplexed": "agent-proxy", "sdk": "python-sdk"}


def _text(value: Column) -> Column:
    return F.to_json(value)


def _id_text(value: Column) -> Column:
    """An id as text that is equal for equal ids: numbers by their value (``1e2`` is ``100``)."""
    number = F.when(~F.to_json(value).startswith('"'), F.try_variant_get(value, "$", "double"))
    whole = (number == F.floor(number)) & (F.abs(number) < 2.0**53)
    return F.coalesce(F.when(whole, number.cast("long").cast("string")).otherwise(number.cast("string")), _text(value))


def rpc_messages(log: DataFrame) -> DataFrame:
    """The log lines that can take part in a pair, with their id and role.

    A request is an agent-side line with a method and an id, a response a
    server-side line with an id and no method. Notifications, requests that
    the server starts, answers to those, blank and non-JSON lines drop out.
    The id keeps its JSON type, so ``1`` and ``"1"`` are different.
    """
    allow_duplicate_json_keys(log.sparkSession)
    def takes_part(message: Column) -> Column:
        from_agent = F.col("direction") == "agent"
        return field(message, "$.id").isNotNull() & (from_agent == truthy(field(message, "$.method")))

    # The filter runs below the projection and parses for itself, once.
    messages = log.where(bound(F.try_parse_json("line"), takes_part)).withColumn("_message", F.try_parse_json("line"))
    return messages.withColumns({
        "rpc_id": _id_text(field(F.col("_message"), "$.id")),
        "is_request": F.col("direction") == "agent",
    })


def pair_rpc_log(log: DataFrame) -> DataFrame:
    """Requests with their responses from ``(conn, direction, seq, ts, line)``.

    Within a connection and id, a response answers the line right before it
    if that is a request: a repeated request replaces the open one, and a
    response uses it up. ``seq`` must be unique per connection and direction.

    Only the small ordering columns are sorted; the lines are joined on for
    matched pairs. That keeps payloads out of the sort and lets one busy
    (connection, id) spread over many tasks.
    """
    messages = rpc_messages(log)
    keys, order = ["conn", "rpc_id"], ["ts", "direction", "seq"]
    # Written down first: sampling the sort ranges would parse every line again.
    thin = in_chunks(cut_lineage(messages.select(*keys, *order, "is_request")), keys, order)
    lagged = previous(thin, keys, order, F.struct("is_request", "seq", "ts"), "open")
    pairs = lagged.where(~F.col("is_request") & F.col("open.is_request")).select(
        "conn", "rpc_id", F.col("open.seq").alias("request_seq"), F.col("open.ts").alias("request_ts"),
        F.col("seq").alias("response_seq"), F.col("ts").alias("response_ts"),
    )
    request = log.where(F.col("direction") == "agent").select(
        "conn", F.col("seq").alias("request_seq"), F.try_parse_json("line").alias("_request"))
    response = log.where(F.col("direction") == "server").select(
        "conn", F.col("seq").alias("response_seq"), F.try_parse_json("line").alias("_response"))
    request = request.select("conn", "request_seq", *request_fields(F.col("_request")))
    response = response.select("conn", "response_seq", *response_fields(F.col("_response")))
    joined = pairs.join(request, ["conn", "request_seq"]).join(response, ["conn", "response_seq"])
    return joined.withColumns({
        "timestamp": F.col("request_ts"),
        "latency_ms": elapsed_ms("request_ts", "response_ts"),
    }).drop("request_ts")


def request_touches(log: DataFrame) -> DataFrame:
    """When requests touched their connection, answered or not: ``(conn,
    timestamp, opens)``. ``initialize`` opens a session."""
    requests = rpc_messages(log.where(F.col("direction") == "agent"))
    method = field_text(F.col("_message"), "$.method")
    opens = F.coalesce(method == "initialize", F.lit(False))
    return requests.select("conn", F.col("ts").alias("timestamp"), opens.alias("opens"))


def request_fields(message: Column) -> list[Column]:
    return [
        field_text(message, "$.method").alias("method"),
        _text(field(message, "$.params")).alias("params"),
    ]


def response_fields(message: Column) -> list[Column]:
    error = field(message, "$.error")
    return [
        text_or_null(field(message, "$.result")).alias("result"),
        F.when(truthy(error), _text(error)).alias("error"),
    ]


def map_capture_fields(df: DataFrame, source: str, server: str = "conn") -> DataFrame:
    """Call columns from a request/response pair by the rules of ``source``.

    Input: ``method, params, result, error, latency_ms, timestamp`` and the
    server column. ``stdio`` and ``http`` take the tool name and arguments out
    of a tools/call; ``multiplexed`` records tools/call only, with the whole
    params as arguments and an error in place of the response.
    """
    # Parsed in a step of their own, since several fields are read from each.
    df = df.withColumns({"_params": F.try_parse_json("params"), "_error": F.try_parse_json("error")})
    params, error = F.col("_params"), F.col("_error")
    is_call = F.col("method") == CALL_METHOD
    named_tool = F.coalesce(field_text(params, "$.name"), F.col("method"))
    failed = F.col("error").isNotNull()
    if source in ("stdio", "http"):
        arguments = F.coalesce(text_or_null(field(params, "$.arguments")), F.col("params"))
        response = F.col("result")
        message = field_text(error, "$.message")
    elif source == "multiplexed":
        df = df.where(is_call)
        arguments = F.col("params")
        response = F.coalesce(F.col("error"), F.col("result"))
        message = F.col("error")
    elif source == "sdk":
        # The instrumented program reports method = tool name, its keyword
        # arguments, and the exception text in place of an error object.
        named_tool, is_call = F.col("method"), F.lit(True)
        arguments = F.col("params")
        response = F.when(~failed, F.col("result"))
        message = F.coalesce(F.try_variant_get(error, "$", "string"), F.col("error"))
    else:
        raise ValueError(f"unknown capture source {source!r}; use one of {sorted(AGENT_TYPES)}")
    code = F.lit(None).cast("int") if source == "sdk" else F.try_variant_get(error, "$.code", "int")
    kept = [c for c in df.columns if c not in (
        "method", "params", "result", "error", "latency_ms", "timestamp", server, "_params", "_error")]
    return df.select(
        *kept,
        F.lit(AGENT_TYPES[source]).alias("agent_type"),
        F.col(server).alias("server_name"),
        F.when(is_call, named_tool).otherwise(F.col("method")).alias("tool_name"),
        "method",
        arguments.alias("arguments"),
        response.alias("response"),
        F.when(failed, "error").otherwise("success").alias("status"),
        "latency_ms", "timestamp",
        F.when(failed, message).alias("error_msg"),
        F.when(failed, code).alias("error_code"),
    )


def calls_from_http(exchanges: DataFrame) -> DataFrame:
    """Calls from recorded exchanges ``(server, request_body, response_body,
    proxy_error, t0, t1)``.

    A request that is not JSON, or has no method, gives nothing. A response
    that is not JSON counts as a success without response. When the upstream
    could not be reached, the call is an error named after its method (or
    ``unknown``), with the whole params as arguments, and ``lost`` is true.
    """
    allow_duplicate_json_keys(exchanges.sparkSession)
    request, response = F.col("_request"), F.col("_response")
    lost = F.col("proxy_error").isNotNull()

    def recorded(body: Column) -> Column:
        return F.when(lost, ~F.is_variant_null(body)).otherwise(truthy(field(body, "$.method")))

    parsed = exchanges.where(bound(F.try_parse_json("request_body"), recorded)).withColumns({
        "_request": F.try_parse_json("request_body"),
        "_response": F.try_parse_json("response_body"),
    })
    kept = [c for c in exchanges.columns if c not in ("request_body", "response_body", "t0", "t1")]
    messages = parsed.select(
        *kept, F.col("t0").alias("timestamp"), elapsed_ms("t0", "t1").alias("latency_ms"),
        *request_fields(request), *response_fields(response), _text(field(request, "$.params")).alias("_whole"),
    ).withColumn("method", F.coalesce("method", F.lit("unknown")))
    calls = map_capture_fields(messages, "http", "server").withColumn("lost", lost)
    of_lost = {
        "tool_name": F.col("method"), "arguments": F.col("_whole"), "response": F.lit(None), "status": F.lit("error"),
        "error_msg": F.col("proxy_error"), "error_code": F.lit(None),
    }
    return calls.withColumns({
        name: F.when(lost, value).otherwise(F.col(name)) for name, value in of_lost.items()
    }).drop("proxy_error", "_whole")
