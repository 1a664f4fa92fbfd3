"""Order and limits of the listings, with ties."""

import pytest
from pyspark.sql import functions as F

from callscope.operators import filters, metrics, sessions, topk

ROWS = [
    (1, "s", "b", "t2", "error", 50, 1000), (2, "s", "a", "t1", "success", 70, 1000), (3, "s", "a", "t1", "timeout", 10, 3000),
    (4, "s", "a", "t2", "success", 70, 2000), (5, "r", "b", "t1", "error", 10, 500),
]


def ids(df):
    return [r.id for r in df.collect()]


@pytest.fixture(scope="module")
def calls(make_calls):
    return make_calls(ROWS).withColumns({
        "error_class": F.lit(None).cast("string"), "error_code": F.lit(None).cast("int"), "error_msg": F.lit(None).cast("string")})


@pytest.mark.parametrize("by,direction,want", [
    ("timestamp", None, [1, 2, 4, 3]), ("timestamp", "desc", [3, 4, 1, 2]), ("toolName", None, [2, 3, 1, 4]),
    ("toolName", "desc", [1, 4, 2, 3]), ("status", None, [1, 2, 4, 3]), ("latencyMs", None, [2, 4, 1, 3]),
    ("latencyMs", "asc", [3, 1, 2, 4]),
])
def test_sort_calls(calls, by, direction, want):
    assert ids(topk.sort_calls(filters.session_calls(calls, "s"), by, direction)) == want


def test_newest_first(calls):
    assert ids(topk.recent_calls(calls, 3)) == [3, 4, 2]
    assert ids(topk.live_tail(calls)) == [3, 4, 2, 1, 5]
    assert ids(topk.recent_errors(calls, 2)) == [3, 1]
    assert tuple(topk.recent_errors(calls).columns) == topk.ERROR_COLUMNS


@pytest.mark.parametrize("by,first", [
    ("latency_p95", ("t1", "a")), ("nonsense", ("t1", "a")), ("error_rate", ("t1", "b")), ("call_count", ("t1", "a"))])
def test_sort_tool_stats(calls, by, first):
    top = topk.sort_tool_stats(metrics.tool_stats(calls), by).first()
    assert (top.tool_name, top.server_name) == first


def test_call_at_takes_the_first(calls):
    assert ids(filters.call_at(calls, "s", "1970-01-01 00:00:01")) == [1]


def test_replay_is_in_order(calls):
    known = sessions.derive_sessions(calls)
    rows = sessions.replay(known, calls, "s").collect()
    assert [(r.id, r.session_server_name) for r in rows] == [(1, "b"), (2, "b"), (4, "b"), (3, "b")]


def test_alert_pages(spark):
    alerts = spark.createDataFrame([(i, 100 - i // 2) for i in range(10)], "id long, ms long").select(
        "id", F.timestamp_millis("ms").alias("fired_at"))
    assert ids(topk.list_alerts(alerts, limit=4)) == [1, 0, 3, 2]
    assert ids(topk.list_alerts(alerts, limit=3, offset=8)) == [9, 8]
    assert metrics.alerts_total(alerts).first().total == 10


def test_timeline_floors(calls, make_calls):
    rows = {r.id: (r.latency_pct, round(r.log_pct, 3)) for r in sessions.call_timeline(
        make_calls([(1, "s", "a", "t", "success", 0, 0), (2, "q", "a", "t", "success", 0, 0), (3, "q", "a", "t", "success", 99, 0)])).collect()}
    assert rows == {1: (0.0, 3.0), 2: (0.0, 3.0), 3: (100.0, 100.0)}
