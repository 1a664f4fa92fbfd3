"""Queries: reports from the maintained histogram. Each has the SQL of the report over the calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callscope.operators import rollup as ops
from callscope.plans import testdata
from callscope.plans.catalog import query
from callscope.plans.metric_queries import _DAY, _OVERVIEW, _P, _RATE, _USAGE, ranks_sql
from callscope.plans.testdata import WITH_CALLS, stamp
from callscope.session import new_folder
from callscope.sources import tables

_DAY_BUCKETS = "(select *, time_bucket(interval '15 minutes', timestamp) as b from calls where timestamp > (select max(timestamp) from calls) - interval 24 hours) d"
_FIVE = "(select * from calls where timestamp > (select max(timestamp) from calls) - interval 5 minutes) d"


def _stored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The rollup and the calls, as two batches left them."""
    path, source = new_folder(spark, "rolled-calls"), testdata.calls(spark, sf)
    for batch_id in range(2):
        tables.write_tool_calls(source.where(f"id % 2 = {batch_id}"), path, batch_id=batch_id)
        tables.write_rollup(ops.rollup(source.where(f"id % 2 = {batch_id}")), f"{path}-rollup", batch_id)
    return tables.read_rollup(spark, f"{path}-rollup"), tables.read_tool_calls(spark, path)


def _day(spark, sf):
    rolled, calls = _stored(spark, sf)
    return ops.rows_since(rolled, calls, testdata.as_of(calls))


@query("tool_stats_rolled", WITH_CALLS + ranks_sql("tool_name, server_name", _P, f"{_DAY} d", extra=_RATE))
def _tool_stats(spark, sf):
    return ops.tool_stats(_day(spark, sf))


@query("overview_rolled", WITH_CALLS + _OVERVIEW.format(p95=ranks_sql("", {"p95_latency_ms": 0.95}, f"{_DAY} d"), source=f"{_DAY} d"))
def _overview(spark, sf):
    return ops.overview(_day(spark, sf))


@query("tool_latency_series_rolled", WITH_CALLS + f"""select tool_name, server_name, {stamp('b')} as bucket, p50_latency_ms, p95_latency_ms
 from ({ranks_sql('tool_name, server_name, b', {'p50_latency_ms': 0.5, 'p95_latency_ms': 0.95}, _DAY_BUCKETS)}) r""")
def _latency_series(spark, sf):
    return ops.tool_latency_series(_day(spark, sf))


@query("token_usage_by_node_rolled", WITH_CALLS + f"select server_name, tool_name, {_USAGE} from {_DAY} d group by server_name, tool_name")
def _token_usage(spark, sf):
    return ops.token_usage_by_node(_day(spark, sf))


@query("error_class_series_rolled", WITH_CALLS + f"""select {stamp('b')} as bucket, count(*) filter (where error_class = 'hallucination') as hallucination,
 count(*) filter (where error_class = 'tool_failure') as tool_failure, count(*) filter (where error_class = 'timeout') as timeout
 from {_DAY_BUCKETS} where status <> 'success' group by b""")
def _error_series(spark, sf):
    return ops.error_class_series(_day(spark, sf))


# The window is shorter than a bucket, so all of it is counted from the calls of one or two buckets.
@query("server_health_rolled", WITH_CALLS + f"""select server_name, total_calls, p95_latency_ms, error_rate_pct, case when rate > 20 then 'down'
 when rate > 5 or p95_latency_ms > 2000 then 'degraded' else 'healthy' end as status
 from (select server_name, call_count as total_calls, p95_latency_ms, rate, floor(rate * 100 + 0.5) / 100 as error_rate_pct from
  ({ranks_sql('server_name', {'p95_latency_ms': 0.95}, _FIVE, extra=", sum(case when status = 'error' then 1 else 0 end) / cast(count(*) as double) * 100 as rate")}))""")
def _health(spark, sf):
    rolled, calls = _stored(spark, sf)
    return ops.server_health(ops.rows_within(rolled, calls, testdata.as_of(calls), "5 minutes")).drop("last_seen_at")
