"""Ordered operators when one busy group spans many chunks.

Small inputs would end up in a single chunk, so partition coalescing is off
here; half of all rows belong to one group.
"""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_alerts import random_calls, stepwise_state

from callscope.functions.ordered import CHUNK, in_chunks, previous, running
from callscope.operators import alerts, diff, sessions
from callscope.sources import capture


@pytest.fixture(autouse=True)
def many_chunks(spark):
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def same(left, right):
    assert left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def test_running_values_match_plain_windows(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else rng.choice("abc"), rng.randrange(20), i, rng.randrange(-50, 50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, at int, id long, v long")
    keys, order = ["k"], ["at", "id"]
    chunked = in_chunks(df, keys, order)
    assert chunked.where("k = 'hot'").select(CHUNK).distinct().count() >= 3
    got = running(chunked, keys, order, sums={"total": F.col("v")}, minima={"low": F.when(F.col("v") % 3 == 0, F.col("v"))})
    got = previous(got, keys, order, F.col("v"), "before")
    w = Window.partitionBy("k").orderBy("at", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({
        "total": F.sum("v").over(upto), "low": F.min(F.when(F.col("v") % 3 == 0, F.col("v"))).over(upto),
        "before": F.lag("v").over(w)})
    columns = ["k", "at", "id", "v", "total", "low", "before"]
    same(got.select(columns), want.select(columns))


@pytest.mark.parametrize("seed,error_rate", [(11, 0.3), (12, 0.9)])
def test_alert_state(make_calls, seed, error_rate):
    rows = random_calls(seed, 3000, error_rate, hot=0.5)
    got = {r.id: (r.buffer_calls, r.p95_latency_ms, r.error_count)
           for r in alerts.rolling_tool_state(make_calls(rows)).collect()}
    assert got == stepwise_state(rows)


def test_sessionize(make_calls):
    rng, ms, rows = random.Random(4), 0, []
    for i in range(1500):
        ms += rng.choice([0, 10, 60_000, 200_000, 310_000])
        rows.append((i, "s", "hot" if rng.random() < 0.7 else "cold", "t", "success", rng.choice([0, 5, 400_000]), ms))
    method = F.when(F.col("id") % 37 == 0, "initialize").otherwise("tools/call")
    got = {r.id: r.session_id for r in sessions.sessionize(
        make_calls(rows).drop("session_id").withColumn("method", method)).collect()}
    points, seen, want = [], {}, {}
    for i, _, conn, _, _, latency, at in rows:
        points += [(at, 0, i, conn, i % 37 == 0), (at + latency, 1, i, conn, False)]
    for at, kind, i, conn, opens in sorted(points):
        n, last = seen.get(conn, (0, None))
        if last is None or opens or at - last > 300_000:
            n += 1
        seen[conn] = (n, at)
        if kind == 1:
            want[i] = f"{conn}#{n}"
    assert got == want


def test_previous_call(make_calls):
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < 0.6 else "cold", "s", rng.choice("tu"), "success", 1, rng.randrange(600)) for i in range(1500)]
    got = {r.id: r.previous_id for r in diff.previous_same_tool(make_calls(rows)).collect()}
    want = {}
    for i, session, _, tool, _, _, ms in rows:
        earlier = [(-m, j) for j, s, _, t, _, _, m in rows if (s, t) == (session, tool) and m < ms]
        want[i] = min(earlier)[1] if earlier else None
    assert got == want


def test_pairing(spark):
    rng, rows, want, waiting = random.Random(6), [], [], None
    for seq in range(2000):
        direction = rng.choice(["agent", "server"])
        rows.append(("c", direction, seq, seq, '{"id":1,"method":"m"}' if direction == "agent" else '{"id":1,"result":0}'))
        if direction == "agent":
            waiting = seq
        elif waiting is not None:
            want.append((waiting, seq))
            waiting = None
    log = spark.createDataFrame(rows, "conn string, direction string, seq long, ms long, line string").withColumn(
        "ts", F.timestamp_millis("ms"))
    got = capture.pair_rpc_log(log).select("request_seq", "response_seq").collect()
    assert sorted(map(tuple, got)) == want
