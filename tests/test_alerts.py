"""Alert state and cooldown against step-by-step models."""

import random

import pytest
from pyspark.sql import functions as F

from callscope.config import AlertSettings
from callscope.operators import alerts


def stepwise_state(rows):
    """The buffer rule, one call after the other."""
    nodes, out = {}, {}
    for i, _, server, tool, status, latency, _ in sorted(rows, key=lambda r: (r[6], r[0])):
        node = nodes.setdefault((server, tool), {"recent": [], "errors": 0})
        node["recent"].append(latency)
        node["errors"] += status == "error"
        if len(node["recent"]) == 201:
            del node["recent"][:100]
            node["errors"] = max(0, node["errors"] - 100)
        held = sorted(node["recent"])
        out[i] = (len(held), held[min(int(len(held) * 0.95), len(held) - 1)], node["errors"])
    return out


def greedy(candidates, cooldown):
    last, fired = {}, set()
    for i, tool, metric, ms in sorted(candidates, key=lambda c: (c[3], c[0])):
        if (tool, metric) not in last or ms - last[(tool, metric)] >= cooldown:
            last[(tool, metric)] = ms
            fired.add((i, metric))
    return fired


def random_calls(seed, n, error_rate, hot=0.0):
    rng, ms, rows = random.Random(seed), 0, []
    for i in range(n):
        ms += rng.choice([0, 1, 20, 500])
        server, tool = ("s0", "t0") if rng.random() < hot else (rng.choice(["s0", "s1"]), rng.choice(["t0", "t1"]))
        status = "error" if rng.random() < error_rate else rng.choice(["success", "timeout"])
        rows.append((i, "s", server, tool, status, int(rng.expovariate(0.01)), ms))
    return rows


@pytest.mark.parametrize("seed,error_rate,hot", [(1, 0.05, 0), (2, 0.5, 0.9), (3, 0.97, 0.5)])
def test_state_equals_stepwise_model(make_calls, seed, error_rate, hot):
    rows = random_calls(seed, 3000, error_rate, hot)
    got = {r.id: (r.buffer_calls, r.p95_latency_ms, r.error_count)
           for r in alerts.rolling_tool_state(make_calls(rows)).collect()}
    assert got == stepwise_state(rows)


@pytest.mark.parametrize("cooldown", [0, 1, 37, 1000, 100_000])
def test_cooldown_equals_greedy_model(spark, cooldown):
    rng, ms, rows = random.Random(cooldown), 0, []
    for i in range(2500):
        ms += rng.choice([0, 0, 1, 3, 40, 2000 if i % 100 == 0 else 2])
        rows.append((i, "s", rng.choice(["a", "a", "a", "b"]), rng.choice(["latency_p95", "error_rate"]), ms))
    df = spark.createDataFrame(rows, "id long, server_name string, tool_name string, metric string, ms long").selectExpr(
        "id", "server_name", "tool_name", "metric", "timestamp_millis(ms) as timestamp", "1d as value", "0d as threshold")
    got = {(r.id if r.id >= 0 else ~r.id, r.metric) for r in alerts.fire_alerts(df, cooldown).collect()}
    assert got == greedy([(i, t, m, ms) for i, _, t, m, ms in rows], cooldown)


def test_thresholds_are_strict(make_calls):
    rows = [(i, "s", "a", "t", "error" if i == 4 else "success", 2000, i) for i in range(10)]
    settings = AlertSettings(latency_p95_ms=2000, error_rate_percent=20)
    found = alerts.alert_candidates(alerts.rolling_tool_state(make_calls(rows)), settings)
    assert found.count() == 0  # 1 of 5 calls is exactly 20 %
    lower = AlertSettings(latency_p95_ms=1999, error_rate_percent=19)
    got = alerts.alert_candidates(alerts.rolling_tool_state(make_calls(rows)), lower).groupBy("metric").count()
    assert {r.metric: r["count"] for r in got.collect()} == {"latency_p95": 10, "error_rate": 1}


def test_error_rate_needs_five_calls(make_calls):
    rows = [(i, "s", "a", "t", "error", 1, i) for i in range(6)]
    got = alerts.alert_candidates(alerts.rolling_tool_state(make_calls(rows)))
    assert sorted(r.id for r in got.collect()) == [4, 5]


def test_severity(spark):
    df = spark.createDataFrame([(4.0, 2.0), (4.1, 2.0)], "value double, threshold double")
    assert [r.severity for r in alerts.alert_severity(df).orderBy("value").collect()] == ["WARNING", "CRITICAL"]


def test_server_shares_the_cooldown(make_calls):
    rows = [(1, "s", "a", "t", "success", 9000, 0), (2, "s", "b", "t", "success", 9000, 1000)]
    got = alerts.alerts(make_calls(rows)).select("server_name", "metric", F.unix_millis("fired_at").alias("ms")).collect()
    assert [tuple(r) for r in got] == [("a", "latency_p95", 0)]
