"""Queries: filters, aggregations, series, listings, exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from callscope.functions.percentile import P50_95_99, nearest_rank
from callscope.operators import enrich, filters, metrics, topk
from callscope.plans import testdata
from callscope.plans.catalog import query
from callscope.plans.testdata import PRICING, WITH_CALLS, stamp
from callscope.schema import normalize_schema
from callscope.session import cut_lineage

_DAY = "(select * from calls where timestamp > (select max(timestamp) from calls) - interval 24 hours)"


def ranks_sql(keys: str, ranks: dict[str, float], source: str = "calls", extra: str = "") -> str:
    """Nearest-rank percentiles by sorting each group, for the oracle."""
    over = f"over (partition by {keys} order by latency_ms, id)" if keys else "over (order by latency_ms, id)"
    count = f"over (partition by {keys})" if keys else "over ()"
    picks = ", ".join(
        f"max(case when rn = least(cast(floor(n * cast({p} as double)) as bigint), n - 1) then cast(latency_ms as bigint) end) as {name}"
        for name, p in ranks.items()
    )
    head = f"{keys}, " if keys else ""
    tail = f" group by {keys}" if keys else ""
    return (
        f"select {head}count(*) as call_count{extra}, {picks} from ("
        f"select *, row_number() {over} - 1 as rn, count(*) {count} as n from {source}) ranked{tail}"
    )


_ERROR_PCT = "round(sum(case when status = 'error' then 1 else 0 end) * 100.0 / count(*), 6)"
_RATE = f", cast({_ERROR_PCT} as double) as error_rate_pct"
_P = {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95, "p99_latency_ms": 0.99}
_BUCKETED = "(select *, time_bucket(interval '15 minutes', timestamp) as b from calls)"


# -- filters --------------------------------------------------------------------

_CALL_COLS = "id, session_id, server_name, tool_name, status, cast(latency_ms as bigint) as latency_ms"


_FIRST = "(select session_id from calls order by id limit 1)"


def _thin(df):
    return df.select("id", "session_id", "server_name", "tool_name", "status", "latency_ms")


for _key, _interval in (("1h", "1 hour"), ("6h", "6 hours"), ("24h", "24 hours"), ("7d", "7 days")):
    query(f"since_{_key}", WITH_CALLS + f"select {_CALL_COLS} from calls where timestamp > (select max(timestamp) from calls) - interval {_interval}")(
        lambda spark, sf, key=_key: _thin(filters.since(testdata.calls(spark, sf), testdata.as_of(testdata.calls(spark, sf)), key))
    )


@query("by_tool", WITH_CALLS + f"select {_CALL_COLS} from calls where tool_name = 'tool3'")
def _by_tool(spark, sf):
    return _thin(filters.by_tool(testdata.calls(spark, sf), "tool3"))


@query("failed_calls", WITH_CALLS + f"select {_CALL_COLS} from calls where status <> 'success'")
def _failed(spark, sf):
    return _thin(filters.failed(testdata.calls(spark, sf)))


@query("session_calls", WITH_CALLS + f"select {_CALL_COLS} from calls where session_id = {_FIRST}")
def _session_calls(spark, sf):
    calls = testdata.calls(spark, sf)
    return _thin(filters.session_calls(calls, testdata.first_session(calls)))


@query("call_at", WITH_CALLS + f"""select {_CALL_COLS} from calls where session_id = {_FIRST}
 and timestamp = (select timestamp from calls order by id limit 1) order by id limit 1""")
def _call_at(spark, sf):
    calls = testdata.calls(spark, sf)
    return _thin(filters.call_at(calls, testdata.first_session(calls), testdata.one(calls, F.min_by("timestamp", "id"))))


# -- enrichment -------------------------------------------------------------------

@query("normalize_schema", WITH_CALLS + """
select id, tool_name, cast(null as bigint) as error_code, cast(0 as bigint) as input_tokens,
 cast(0 as bigint) as output_tokens, cast(0 as double) as cost_usd, cast(null as varchar) as error_class from calls""")
def _normalize(spark, sf):
    old = testdata.calls(spark, sf).select("id", "tool_name")
    return normalize_schema(old).select(
        "id", "tool_name", "error_code", "input_tokens", "output_tokens", "cost_usd", "error_class")


@query("estimate_tokens", WITH_CALLS + "select id, input_tokens, output_tokens from calls")
def _tokens(spark, sf):
    raw = testdata.raw_calls(testdata.events(spark, sf))
    return enrich.estimate_tokens(raw).select("id", "input_tokens", "output_tokens")


@query("price_calls", WITH_CALLS + "select id, server_name, round(cost_usd, 6) as cost_usd from calls")
def _price(spark, sf):
    raw = enrich.estimate_tokens(testdata.raw_calls(testdata.events(spark, sf)))
    return enrich.price_calls(raw, PRICING).select("id", "server_name", "cost_usd")


@query("price_calls_from_table", WITH_CALLS + """
, rates as (select concat('srv', cast(c_nationkey % 7 as varchar)) as server_name,
  round(avg(c_acctbal) / 1000, 4) as i, round(max(c_acctbal) / 1000, 4) as o from customer where c_nationkey % 7 < 4 group by 1)
select id, c.server_name, round(input_tokens / 1e6 * coalesce(i, 3.0) + output_tokens / 1e6 * coalesce(o, 15.0), 6) as cost_usd
from calls c left join rates r on r.server_name = c.server_name""")
def _price_table(spark, sf):
    server = F.concat(F.lit("srv"), (F.col("c_nationkey") % 7).cast("string"))
    overrides = (
        spark.read.parquet(f"{sf}/customer.parquet").where(F.col("c_nationkey") % 7 < 4)
        .groupBy(server.alias("server_name"))
        .agg(F.round(F.avg("c_acctbal") / 1000, 4).alias("input_per_million"),
             F.round(F.max("c_acctbal") / 1000, 4).alias("output_per_million"))
    )
    raw = enrich.estimate_tokens(testdata.raw_calls(testdata.events(spark, sf)))
    return enrich.price_calls(raw, overrides=overrides).select("id", "server_name", "cost_usd")


@query("classify_errors", WITH_CALLS + "select id, status, error_class from calls")
def _classify(spark, sf):
    return enrich.classify_errors(testdata.raw_calls(testdata.events(spark, sf))).select("id", "status", "error_class")


@query("enrich", WITH_CALLS + f"""
select id, session_id, agent_type, arguments, cast(response_bytes as bigint) as size_bytes, cast(latency_ms as bigint) as latency_ms,
 {stamp('timestamp')} as timestamp, cast(error_code as bigint) as error_code, error_msg, input_tokens, output_tokens,
 round(cost_usd, 6) as cost_usd, error_class from calls""")
def _enrich(spark, sf):
    return testdata.calls(spark, sf).select(
        "id", "session_id", "agent_type", "arguments", F.col("response.size_bytes").alias("size_bytes"), "latency_ms",
        "timestamp", "error_code", "error_msg", "input_tokens", "output_tokens", "cost_usd", "error_class")


# -- aggregations -------------------------------------------------------------------

_OVERVIEW = """select count(*) as total_calls,
 coalesce(round(sum(case when status = 'error' then 1 else 0 end) * 100.0 / nullif(count(*), 0), 6), 0)::double as error_rate_pct,
 cast(floor(coalesce(avg(latency_ms), 0) + 0.5) as bigint) as avg_latency_ms, count(distinct server_name) as active_servers,
 cast(coalesce(sum(input_tokens + output_tokens), 0) as bigint) as total_tokens, coalesce(round(sum(cost_usd), 6), 0) as total_cost_usd,
 coalesce((select max(p95_latency_ms) from ({p95})), 0) as p95_latency_ms from {source}"""


@query("overview", WITH_CALLS + _OVERVIEW.format(p95=ranks_sql("", {"p95_latency_ms": 0.95}, f"{_DAY} d"), source=f"{_DAY} d"))
def _overview(spark, sf):
    calls = testdata.calls(spark, sf)
    return metrics.overview(calls, testdata.as_of(calls))


@query("overview_all_time", WITH_CALLS + _OVERVIEW.format(p95=ranks_sql("", {"p95_latency_ms": 0.95}), source="calls"))
def _overview_all(spark, sf):
    return metrics.overview_of(testdata.calls(spark, sf))


@query("nearest_rank", WITH_CALLS + ranks_sql("server_name, tool_name, agent_type", _P))
def _nearest_rank(spark, sf):
    return nearest_rank(testdata.calls(spark, sf), ["server_name", "tool_name", "agent_type"], "latency_ms", P50_95_99)


@query("nearest_rank_global", WITH_CALLS + ranks_sql("", _P))
def _nearest_rank_global(spark, sf):
    return nearest_rank(testdata.calls(spark, sf), [], "latency_ms", P50_95_99)


@query("tool_stats", WITH_CALLS + ranks_sql("tool_name, server_name", _P, extra=_RATE))
def tool_stats(spark, sf):
    return metrics.tool_stats(testdata.calls(spark, sf))


@query("tool_stats_24h", WITH_CALLS + ranks_sql("tool_name, server_name", _P, f"{_DAY} d", _RATE))
def _tool_stats_24h(spark, sf):
    calls = testdata.calls(spark, sf)
    return metrics.tool_stats(filters.since(calls, testdata.as_of(calls), "24h"))


@query("tool_latency_series", WITH_CALLS + f"""select tool_name, server_name, {stamp('b')} as bucket, p50_latency_ms, p95_latency_ms
 from ({ranks_sql('tool_name, server_name, b', {k: _P[k] for k in list(_P)[:2]}, _BUCKETED + ' x')})""")
def _latency_series(spark, sf):
    return metrics.tool_latency_series(testdata.calls(spark, sf))


@query("tool_error_series", WITH_CALLS + f"select tool_name, server_name, {stamp('b')} as bucket, cast({_ERROR_PCT} as double) as error_rate_pct from {_BUCKETED} x group by tool_name, server_name, b")
def _error_series(spark, sf):
    return metrics.tool_error_series(testdata.calls(spark, sf))


@query("tool_volume_series", WITH_CALLS + f"select tool_name, server_name, {stamp('b')} as bucket, count(*) as call_count from {_BUCKETED} x group by tool_name, server_name, b")
def _volume_series(spark, sf):
    return metrics.tool_volume_series(testdata.calls(spark, sf))


@query("timeseries", WITH_CALLS + f"""select agent_type, {stamp('b')} as bucket, count(*) as call_count, cast(max(latency_ms) as bigint) as max_latency_ms
 from {_BUCKETED} x group by agent_type, b""")
def _timeseries(spark, sf):
    return metrics.timeseries(
        testdata.calls(spark, sf),
        {"call_count": F.count(F.lit(1)), "max_latency_ms": F.max("latency_ms")}, ["agent_type"])


_HEALTH = """select server_name, case when rate > 20 then 'down' when rate > 5 or p95_latency_ms > 2000 then 'degraded' else 'healthy' end as status,
 floor(rate * 100 + 0.5) / 100 as error_rate_pct, p95_latency_ms, call_count as total_calls, last_seen as last_seen_at from ({ranks})"""
_HEALTH_EXTRA = f", sum(case when status = 'error' then 1 else 0 end) / cast(count(*) as double) * 100 as rate, {stamp('max(timestamp)')} as last_seen"


def _health_sql(source: str) -> str:
    return WITH_CALLS + _HEALTH.format(ranks=ranks_sql("server_name", {"p95_latency_ms": 0.95}, source, _HEALTH_EXTRA))


def _last(width: str) -> str:
    return f"(select * from calls where timestamp > (select max(timestamp) from calls) - interval {width}) w"


@query("server_health", _health_sql(_last("5 minutes")))
def _health(spark, sf):
    calls = testdata.calls(spark, sf)
    return metrics.server_health(calls, testdata.as_of(calls))


@query("server_health_6h", _health_sql(_last("6 hours")))
def _health_6h(spark, sf):
    calls = testdata.calls(spark, sf)
    return metrics.server_health(calls, testdata.as_of(calls), "6 hours")


@query("server_health_all_time", _health_sql("calls"))
def _health_all(spark, sf):
    return metrics.server_health_of(testdata.calls(spark, sf))


_USAGE = """count(*) as call_count, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens,
 cast(sum(input_tokens + output_tokens) as bigint) as total_tokens, round(sum(cost_usd), 6) as cost_usd"""


@query("token_usage_by_node", WITH_CALLS + f"select server_name, tool_name, {_USAGE} from calls group by server_name, tool_name")
def _tokens_node(spark, sf):
    return metrics.token_usage_by_node(testdata.calls(spark, sf))


@query("token_usage_by_agent_type", WITH_CALLS + f"select agent_type, {_USAGE} from calls group by agent_type")
def _tokens_agent(spark, sf):
    return metrics.token_usage_by_agent_type(testdata.calls(spark, sf))


@query("token_series", WITH_CALLS + f"""select {stamp('b')} as bucket, cast(sum(input_tokens) as bigint) as input_tokens,
 cast(sum(output_tokens) as bigint) as output_tokens from {_BUCKETED} x group by b""")
def _token_series(spark, sf):
    return metrics.token_series(testdata.calls(spark, sf))


@query("cost_by_node", WITH_CALLS + f"select * exclude (total_tokens) from (select server_name, tool_name, {_USAGE} from calls group by server_name, tool_name)")
def _cost_node(spark, sf):
    return metrics.cost_by_node(testdata.calls(spark, sf))


_COST_SESSIONS = f"""select c.session_id, c.call_count, c.cost_usd, c.total_tokens, s.server_name,
 {stamp('s.started_at')} as started_at, s.label from
 (select session_id, count(*) as call_count, round(sum(cost_usd), 6) as cost_usd, cast(sum(input_tokens + output_tokens) as bigint) as total_tokens
  from calls group by session_id order by sum(cost_usd) desc, session_id limit {{n}}) c left join sessions s on s.id = c.session_id"""


@query("cost_by_session", WITH_CALLS + _COST_SESSIONS.format(n=50))
def _cost_session(spark, sf):
    return metrics.cost_by_session(testdata.calls(spark, sf), testdata.sessions(spark, sf))


@query("top_sessions", WITH_CALLS + _COST_SESSIONS.format(n=15))
def _top_sessions(spark, sf):
    return topk.top_sessions(metrics.cost_by_session(testdata.calls(spark, sf), testdata.sessions(spark, sf)))


@query("cost_series", WITH_CALLS + f"select {stamp('b')} as bucket, round(sum(cost_usd), 6) as cost_usd from {_BUCKETED} x group by b")
def _cost_series(spark, sf):
    return metrics.cost_series(testdata.calls(spark, sf))


@query("cost_totals", WITH_CALLS + """, nodes as (select server_name, tool_name, sum(cost_usd) as cost, sum(input_tokens + output_tokens) as tokens
 from calls group by server_name, tool_name)
select round(sum(cost), 6) as total_cost_usd, cast(sum(tokens) as bigint) as total_tokens, count(*) as active_nodes,
 (select server_name from nodes order by cost desc, server_name, tool_name limit 1) as top_server_name,
 (select tool_name from nodes order by cost desc, server_name, tool_name limit 1) as top_tool_name from nodes""")
def _cost_totals(spark, sf):
    return metrics.cost_totals(testdata.calls(spark, sf))


@query("errors_by_class", WITH_CALLS + """select coalesce(error_class, 'unclassified') as error_class, count(*) as count,
 round(count(*) * 100.0 / sum(count(*)) over (), 6) as share_pct from calls where status <> 'success' group by 1""")
def _errors_class(spark, sf):
    return metrics.errors_by_class(testdata.calls(spark, sf))


@query("error_class_series", WITH_CALLS + f"""select {stamp('b')} as bucket, count(*) filter (where error_class = 'hallucination') as hallucination,
 count(*) filter (where error_class = 'tool_failure') as tool_failure, count(*) filter (where error_class = 'timeout') as timeout
 from {_BUCKETED} x where status <> 'success' group by b""")
def _error_class_series(spark, sf):
    return metrics.error_class_series(testdata.calls(spark, sf))


@query("p95_by_tool", WITH_CALLS + f"""select p.tool_name, p.p95_latency_ms, f.server_name from
 (select tool_name, p95_latency_ms from ({ranks_sql('tool_name', {'p95_latency_ms': 0.95})})) p join
 (select tool_name, min(server_name) as server_name from calls c where latency_ms =
  (select min(latency_ms) from calls m where m.tool_name = c.tool_name) group by tool_name) f on f.tool_name = p.tool_name""")
def _p95_tool(spark, sf):
    return metrics.p95_by_tool(testdata.calls(spark, sf))


@query("error_rate_by_tool", WITH_CALLS + f"select tool_name, server_name, cast({_ERROR_PCT} as double) as error_rate_pct from calls group by tool_name, server_name")
def _error_rate_tool(spark, sf):
    return metrics.error_rate_by_tool(testdata.calls(spark, sf))


# -- listings -------------------------------------------------------------------------

_LISTED = f"id, session_id, server_name, tool_name, status, cast(latency_ms as bigint) as latency_ms, {stamp('timestamp')} as timestamp"


def _listed(df):
    return df.select("id", "session_id", "server_name", "tool_name", "status", "latency_ms", "timestamp")


@query("recent_calls", WITH_CALLS + f"select {_LISTED} from (select * from calls order by timestamp desc, id desc limit 50)")
def _recent_calls(spark, sf):
    return _listed(topk.recent_calls(testdata.calls(spark, sf)))


@query("recent_errors", WITH_CALLS + f"""select id, session_id, server_name, tool_name, status, error_class,
 cast(error_code as bigint) as error_code, error_msg, {stamp('timestamp')} as timestamp
 from (select * from calls where status <> 'success' and timestamp > (select max(timestamp) from calls) - interval 24 hours
  order by timestamp desc, id desc limit 50)""")
def _recent_errors(spark, sf):
    calls = testdata.calls(spark, sf)
    return topk.recent_errors(filters.since(calls, testdata.as_of(calls), "24h"))


@query("live_tail", WITH_CALLS + f"select {_LISTED} from (select * from calls order by timestamp desc, id desc limit 200)")
def _live_tail(spark, sf):
    return _listed(topk.live_tail(testdata.calls(spark, sf)))


@query("top_nodes_by_tokens", WITH_CALLS + f"""select server_name, tool_name, {_USAGE} from calls group by server_name, tool_name
 order by sum(input_tokens + output_tokens) desc, server_name, tool_name limit 12""")
def _top_tokens(spark, sf):
    return topk.top_nodes(metrics.token_usage_by_node(testdata.calls(spark, sf)))


@query("top_nodes_by_cost", WITH_CALLS + f"""select * exclude (total_tokens) from (select server_name, tool_name, {_USAGE} from calls
 group by server_name, tool_name order by sum(cost_usd) desc, server_name, tool_name limit 12)""")
def _top_cost(spark, sf):
    return topk.top_nodes(metrics.cost_by_node(testdata.calls(spark, sf)), "cost_usd")


_STATS = ranks_sql("tool_name, server_name", _P, extra=_RATE)


def _positioned(rows):
    """Rows with the position in which the operator put them: their place in the partition, and the rows of the partitions before."""
    line = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut_lineage(rows.withColumns({"_split": F.spark_partition_id(), "_line": line}))
    counts = placed.groupBy("_split").agg(F.count(F.lit(1)).alias("_rows"))  # one row per partition
    earlier = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_split", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    numbered = placed.join(starts, "_split").withColumn("position", F.col("_start") + F.col("_line") + 1)
    return numbered.select("position", *rows.columns)


for _by, _column in topk.TOOL_STAT_ORDER.items():
    query(f"sort_tool_stats_{_by}", WITH_CALLS + f"""select cast(row_number() over (order by {_column} desc, tool_name, server_name) as bigint) as position,
     tool_name, server_name, {_column} from ({_STATS})""")(
        lambda spark, sf, by=_by, column=_column: _positioned(
            topk.sort_tool_stats(metrics.tool_stats(testdata.calls(spark, sf)), by).select("tool_name", "server_name", column))
    )


@query("sort_calls", WITH_CALLS + f"""select cast(row_number() over (order by latency_ms desc, id) as bigint) as position, id, session_id, cast(latency_ms as bigint) as latency_ms
 from calls where server_name = 'srv3'""")
def _sort_calls(spark, sf):
    calls = filters.by_server(testdata.calls(spark, sf), "srv3").select("id", "session_id", "timestamp", "tool_name", "status", "latency_ms")
    return _positioned(topk.sort_calls(calls, "latencyMs").select("id", "session_id", "latency_ms"))
