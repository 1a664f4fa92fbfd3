"""Queries: alert state, alerts, severity."""

from __future__ import annotations

from callscope.config import AlertSettings
from callscope.operators import alerts as ops
from callscope.operators import metrics, topk
from callscope.plans import testdata
from callscope.plans.catalog import query
from callscope.plans.testdata import WITH_CALLS, stamp
from callscope.session import new_folder
from callscope.sources import tables

_HOURLY = AlertSettings(latency_p95_ms=4000, error_rate_percent=20, cooldown_minutes=60)

# The buffer rule spelled out by definition: list of the last L latencies, and
# a floored error count stepped from trim to trim.
_STATE = """, numbered as (select id, server_name, tool_name, timestamp, latency_ms,
  row_number() over node as n, sum(case when status = 'error' then 1 else 0 end) over node as cum,
  list(latency_ms) over (partition by server_name, tool_name order by timestamp, id rows between 199 preceding and current row) as recent
  from calls window node as (partition by server_name, tool_name order by timestamp, id)),
 sized as (select *, case when n <= 200 then n else 101 + (n - 201) % 100 end as l,
  case when n <= 200 then 0 else (n - 201) // 100 + 1 end as k from numbered),
 trims as (select server_name, tool_name, k, cum as cum_at from sized where n >= 201 and (n - 201) % 100 = 0),
 floors as (select server_name, tool_name, k, cum_at, cum_at - 100 * k -
   least(0, min(cum_at - 100 * k) over (partition by server_name, tool_name order by k)) as left_errors from trims),
 state as (select s.id, s.server_name, s.tool_name, s.timestamp, cast(s.l as bigint) as buffer_calls,
  list_sort(s.recent[len(s.recent) - s.l + 1 : len(s.recent)])[cast(least(floor(s.l * cast(0.95 as double)), s.l - 1) as bigint) + 1] as p95_latency_ms,
  cast(case when s.k = 0 then s.cum else f.left_errors + s.cum - f.cum_at end as bigint) as error_count
  from sized s left join floors f on f.server_name = s.server_name and f.tool_name = s.tool_name and f.k = s.k) """


def _alerts_sql(p95: float, rate: float, cooldown_ms: int) -> str:
    """Greedy cooldown, followed step by step by a recursive query."""
    return WITH_CALLS.replace("with ", "with recursive ", 1) + _STATE + f""", candidates as (
  select id, tool_name, server_name, timestamp, 'latency_p95' as metric, cast(p95_latency_ms as double) as value, cast({p95} as double) as threshold
  from state where p95_latency_ms > {p95}
  union all select id, tool_name, server_name, timestamp, 'error_rate', error_count / cast(buffer_calls as double) * 100, cast({rate} as double)
  from state where buffer_calls >= 5 and error_count / cast(buffer_calls as double) * 100 > {rate}),
 firsts as (select * from (select *, epoch_us(timestamp) // 1000 as t,
  row_number() over (partition by tool_name, metric, epoch_us(timestamp) // 1000 order by timestamp, id) as rn from candidates) where rn = 1),
 successors as materialized (select a.tool_name, a.metric, a.t, min(b.t) as next from firsts a join firsts b
  on a.tool_name = b.tool_name and a.metric = b.metric and a.t + {cooldown_ms} <= b.t group by all),
 chain as (select tool_name, metric, min(t) as t from firsts group by tool_name, metric
  union all select s.tool_name, s.metric, s.next from chain c join successors s on s.tool_name = c.tool_name and s.metric = c.metric and s.t = c.t),
 fired as (select case when f.metric = 'latency_p95' then f.id else -1 - f.id end as id, f.tool_name, f.server_name, f.metric, f.value, f.threshold,
  f.timestamp as fired_at from firsts f join chain c on c.tool_name = f.tool_name and c.metric = f.metric and c.t = f.t) """


_HOURLY_SQL = _alerts_sql(4000, 20, 3_600_000)
_OUT = f"id, tool_name, server_name, metric, round(value, 6) as value, threshold, {stamp('fired_at')} as fired_at"


def _hourly(spark, sf):
    return ops.alerts(testdata.calls(spark, sf), _HOURLY)


@query("rolling_tool_state", WITH_CALLS + _STATE + f"""select id, server_name, tool_name, {stamp('timestamp')} as timestamp, buffer_calls,
 cast(p95_latency_ms as bigint) as p95_latency_ms, error_count, round(error_count / cast(buffer_calls as double) * 100, 6) as error_rate_pct from state""")
def _state(spark, sf):
    return ops.rolling_tool_state(testdata.calls(spark, sf))


@query("alerts", _HOURLY_SQL + f"select {_OUT} from fired")
def _alerts(spark, sf):
    return _hourly(spark, sf)


@query("alerts_default_settings", _alerts_sql(2000, 10, 300_000) + f"select {_OUT} from fired")
def _alerts_default(spark, sf):
    return ops.alerts(testdata.calls(spark, sf))


@query("write_alerts", _HOURLY_SQL + f"select {_OUT} from fired")
def _write(spark, sf):
    folder = new_folder(spark, "alerts")
    tables.write_alerts(_hourly(spark, sf), folder)
    return tables.read_alerts(spark, folder)


@query("alert_severity", _HOURLY_SQL + "select id, metric, case when value > 2 * threshold then 'CRITICAL' else 'WARNING' end as severity from fired")
def _severity(spark, sf):
    return ops.alert_severity(_hourly(spark, sf)).select("id", "metric", "severity")


@query("list_alerts", _HOURLY_SQL + f"select {_OUT} from (select * from fired order by fired_at desc, id desc limit 50 offset 20)")
def _list(spark, sf):
    return topk.list_alerts(_hourly(spark, sf), limit=50, offset=20)


@query("alerts_total", _HOURLY_SQL + "select count(*) as total from fired")
def _total(spark, sf):
    return metrics.alerts_total(_hourly(spark, sf))
