"""Queries: exports and whole reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.operators import export
from callscope.plans import reports, testdata
from callscope.plans.catalog import query
from callscope.plans.metric_queries import _BUCKETED, _OVERVIEW, _P, _RATE, _USAGE, ranks_sql
from callscope.plans.testdata import WITH_CALLS
from callscope.session import new_folder

_TOOLS_SQL = WITH_CALLS + f"""select tool_name as "toolName", server_name as "serverName", call_count as "callCount", error_rate_pct as "errorRatePct",
 p50_latency_ms as "p50LatencyMs", p95_latency_ms as "p95LatencyMs", p99_latency_ms as "p99LatencyMs" {{more}} from
 ({ranks_sql('tool_name, server_name', _P, extra=_RATE + ", count(distinct time_bucket(interval '15 minutes', timestamp)) as buckets")})"""
_TOOL_TYPES = ("toolName string, serverName string, callCount bigint, errorRatePct double, p50LatencyMs bigint,"
               " p95LatencyMs bigint, p99LatencyMs bigint")


@query("export_tool_stats_csv", _TOOLS_SQL.format(more=""))
def _tools_csv(spark, sf):
    folder = new_folder(spark, "tools-csv")
    export.export_tool_stats(testdata.calls(spark, sf), "csv", folder)
    return spark.read.schema(_TOOL_TYPES).csv(folder, header=True)


@query("export_tool_stats_json", _TOOLS_SQL.format(more=', buckets as "latencyBuckets", buckets as "errorBuckets"'))
def _tools_json(spark, sf):
    folder = new_folder(spark, "tools-json")
    export.export_tool_stats(testdata.calls(spark, sf), "json", folder)
    series = ", timeseriesLatency array<struct<bucket:string,p50:bigint,p95:bigint>>, timeseriesErrors array<struct<bucket:string,errorRatePct:double>>"
    stored = spark.read.schema(_TOOL_TYPES + series).json(folder)
    return stored.select(
        *[F.col(c) for c in stored.columns[:7]],
        F.size("timeseriesLatency").alias("latencyBuckets"), F.size("timeseriesErrors").alias("errorBuckets"))


# The values of the nested series.
@query("export_tool_stats_json_series", WITH_CALLS + f"""select tool_name as "toolName", server_name as "serverName", strftime(b, '%Y-%m-%dT%H:%M:%S') as bucket,
 p50_latency_ms as p50, p95_latency_ms as p95, error_rate_pct as "errorRatePct"
 from ({ranks_sql('tool_name, server_name, b', {'p50_latency_ms': 0.5, 'p95_latency_ms': 0.95}, _BUCKETED + ' x', extra=_RATE)})""")
def _tools_json_series(spark, sf):
    folder = new_folder(spark, "tools-series")
    export.export_tool_stats(testdata.calls(spark, sf), "json", folder)
    series = "timeseriesLatency array<struct<bucket:string,p50:bigint,p95:bigint>>, timeseriesErrors array<struct<bucket:string,errorRatePct:double>>"
    stored = spark.read.schema(f"toolName string, serverName string, {series}").json(folder)
    latency = stored.select("toolName", "serverName", F.inline("timeseriesLatency"))
    errors = stored.select("toolName", "serverName", F.inline("timeseriesErrors"))
    return latency.join(errors, ["toolName", "serverName", "bucket"], "full").withColumn("bucket", F.substring("bucket", 1, 19))


@query("export_cost_csv", WITH_CALLS + """select server_name as "serverName", tool_name as "toolName", count(*) as "callCount",
 cast(sum(input_tokens) as bigint) as "inputTokens", cast(sum(output_tokens) as bigint) as "outputTokens",
 printf('%.6f', sum(cost_usd)) as "costUsd" from calls group by server_name, tool_name""")
def _cost_csv(spark, sf):
    folder = new_folder(spark, "cost-csv")
    export.export_cost(testdata.calls(spark, sf), "csv", folder)
    types = "serverName string, toolName string, callCount bigint, inputTokens bigint, outputTokens bigint, costUsd string"
    return spark.read.schema(types).csv(folder, header=True)


@query("export_cost_json", WITH_CALLS + """
select 'totals' as section, '' as key, round(sum(cost_usd), 6) as cost, cast(sum(input_tokens + output_tokens) as bigint) as tokens from calls
union all select 'byNode', concat(server_name, '/', tool_name), round(sum(cost_usd), 6), cast(sum(input_tokens + output_tokens) as bigint)
 from calls group by server_name, tool_name
union all select 'bySession', session_id, round(c, 6), t from (select session_id, sum(cost_usd) as c, cast(sum(input_tokens + output_tokens) as bigint) as t
 from calls group by 1 order by c desc, session_id limit 50)
union all select 'timeseries', strftime(time_bucket(interval '15 minutes', timestamp), '%Y-%m-%dT%H:%M:%S'), round(sum(cost_usd), 6), null
 from calls group by 2""")
def _cost_json(spark, sf):
    folder = new_folder(spark, "cost-json")
    export.export_cost(testdata.calls(spark, sf), "json", folder, testdata.sessions(spark, sf))
    entry = "serverName string, toolName string, sessionId string, bucket string, costUsd double, totalCostUsd double, inputTokens bigint, outputTokens bigint, totalTokens bigint"
    rows = spark.read.schema("section string, entry string").json(folder).select("section", F.from_json("entry", entry).alias("e"))
    node = F.concat_ws("/", "e.serverName", "e.toolName")
    key = F.when(F.col("section") == "byNode", node).when(F.col("section") == "bySession", F.col("e.sessionId"))
    return rows.select(
        "section", F.coalesce(key, F.substring("e.bucket", 1, 19), F.lit("")).alias("key"),
        F.coalesce("e.costUsd", "e.totalCostUsd").alias("cost"),
        F.coalesce("e.totalTokens", F.col("e.inputTokens") + F.col("e.outputTokens")).alias("tokens"))


# -- reports: JSON lines by section; the rows of each are checked by their own queries --

_DAY = "(select * from calls where timestamp > (select max(timestamp) from calls) - interval 24 hours) d"
_DAY_BUCKETS = f"(select count(distinct time_bucket(interval '15 minutes', timestamp)) from {_DAY} {{where}})"
_NODES = f"(select count(distinct concat(server_name, ' ', tool_name)) from {_DAY})"


def _counts(**sections: str) -> str:
    return WITH_CALLS + " union all ".join(f"select '{n}' as section, cast({sql} as bigint) as row_count" for n, sql in sections.items())


def _counted(spark, report):
    """Section sizes, after writing the whole report and parsing its JSON again."""
    folder = new_folder(spark, "report")
    reports.write_report(report, folder)
    return reduce(DataFrame.unionByName, [
        spark.read.text(f"{folder}/{name}").agg(F.lit(name).alias("section"), F.count(F.parse_json("value")).alias("row_count")) for name in report])


@query("report_overview", _counts(totals="1", recentCalls="(select least(count(*), 50) from calls)"))
def _overview(spark, sf):
    calls = testdata.calls(spark, sf)
    return _counted(spark, reports.overview_report(calls, testdata.as_of(calls)))


@query("report_tools", _counts(tools=_NODES))
def _tools(spark, sf):
    calls = testdata.calls(spark, sf)
    return _counted(spark, reports.tool_report(calls, testdata.as_of(calls)))


@query("report_tokens", _counts(byNode=_NODES, byAgentType=f"(select count(distinct agent_type) from {_DAY})",
                                timeseries=_DAY_BUCKETS.format(where="")))
def _tokens(spark, sf):
    calls = testdata.calls(spark, sf)
    return _counted(spark, reports.token_report(calls, testdata.as_of(calls)))


@query("report_cost", _counts(byNode=_NODES, bySession=f"(select least(count(distinct session_id), 50) from {_DAY})",
                              timeseries=_DAY_BUCKETS.format(where=""), totals="1"))
def _cost(spark, sf):
    calls = testdata.calls(spark, sf)
    return _counted(spark, reports.cost_report(calls, testdata.sessions(spark, sf), testdata.as_of(calls)))


@query("report_errors", _counts(
    byClass=f"(select count(distinct error_class) from {_DAY} where status <> 'success')",
    timeseries=_DAY_BUCKETS.format(where="where status <> 'success'"),
    recentErrors=f"(select least(count(*), 50) from {_DAY} where status <> 'success')"))
def _errors(spark, sf):
    calls = testdata.calls(spark, sf)
    return _counted(spark, reports.error_report(calls, testdata.as_of(calls)))


@query("write_report_tokens", WITH_CALLS + f"""select server_name, tool_name, {_USAGE} from {_DAY} group by server_name, tool_name""")
def _write_tokens(spark, sf):
    calls, folder = testdata.calls(spark, sf), new_folder(spark, "report")
    reports.write_report(reports.token_report(calls, testdata.as_of(calls)), folder)
    types = "server_name string, tool_name string, call_count bigint, input_tokens bigint, output_tokens bigint, total_tokens bigint, cost_usd double"
    return spark.read.schema(types).json(f"{folder}/byNode")


# The values of the other reports' sections, read back from what was written.

def _written(spark, report, section, types):
    folder = new_folder(spark, "report")
    reports.write_report({section: report[section]}, folder)
    return spark.read.schema(types).json(f"{folder}/{section}")


@query("write_report_overview", WITH_CALLS + _OVERVIEW.format(p95=ranks_sql("", {"p95_latency_ms": 0.95}, _DAY), source=_DAY))
def _write_overview(spark, sf):
    calls = testdata.calls(spark, sf)
    return _written(spark, reports.overview_report(calls, testdata.as_of(calls)), "totals", (
        "total_calls bigint, error_rate_pct double, avg_latency_ms bigint, active_servers bigint, total_tokens bigint, total_cost_usd double, p95_latency_ms bigint"))


@query("write_report_errors", WITH_CALLS + f"""select coalesce(error_class, 'unclassified') as error_class, count(*) as count,
 round(count(*) * 100.0 / sum(count(*)) over (), 6) as share_pct from {_DAY} where status <> 'success' group by 1""")
def _write_errors(spark, sf):
    calls = testdata.calls(spark, sf)
    return _written(spark, reports.error_report(calls, testdata.as_of(calls)), "byClass", "error_class string, count bigint, share_pct double")


@query("write_report_cost", WITH_CALLS + f"""select session_id, count(*) as call_count, round(sum(cost_usd), 6) as cost_usd,
 cast(sum(input_tokens + output_tokens) as bigint) as total_tokens from {_DAY} group by session_id order by sum(cost_usd) desc, session_id limit 50""")
def _write_cost(spark, sf):
    calls = testdata.calls(spark, sf)
    report = reports.cost_report(calls, testdata.sessions(spark, sf), testdata.as_of(calls))
    return _written(spark, report, "bySession", "session_id string, call_count bigint, cost_usd double, total_tokens bigint")


@query("write_report_tools", WITH_CALLS + f"""select tool_name as "toolName", server_name as "serverName", call_count as "callCount", error_rate_pct as "errorRatePct",
 p50_latency_ms as "p50LatencyMs", p95_latency_ms as "p95LatencyMs", p99_latency_ms as "p99LatencyMs" from ({ranks_sql('tool_name, server_name', _P, _DAY, extra=_RATE)})""")
def _write_tools(spark, sf):
    calls = testdata.calls(spark, sf)
    return _written(spark, reports.tool_report(calls, testdata.as_of(calls)), "tools", _TOOL_TYPES)
