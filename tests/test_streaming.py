"""Streams over several micro-batches give what the batch jobs give."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_alerts import random_calls, stepwise_state

from callscope.config import AlertSettings, Pricing
from callscope.operators import alerts, sessions
from callscope.plans import testdata, wiredata
from callscope.session import new_folder
from callscope.sources import capture, tables
from callscope.streaming import carried, ingest, series, sinks, stateful

SETTINGS = AlertSettings(latency_p95_ms=4000, error_rate_percent=20, cooldown_minutes=60)


@pytest.fixture(scope="module")
def pieces(spark):
    """The events table in five files, written in time order."""
    source = testdata.events(spark, "/root/testdata/sf0.01").orderBy("ts").select("*")
    folder, n = new_folder(spark, "pieces"), 2000
    for part in range(5):
        source.where((F.col("event_id") >= part * n) & (F.col("event_id") < (part + 1) * n)).coalesce(1).write.mode("append").parquet(folder)
    return folder


def streamed(spark, pieces):
    schema = spark.read.parquet(pieces).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(pieces)


def finished(spark, stream):
    out = new_folder(spark, "out")
    query = sinks.to_parquet(stream, out, new_folder(spark, "state"), available_now=True)
    query.awaitTermination()
    batches = [p for p in query.recentProgress if p.numInputRows]
    return spark.read.schema(stream.schema).parquet(out), len(batches)


def test_alert_stream_equals_batch(spark, pieces):
    stream = testdata.raw_calls(streamed(spark, pieces))
    fired, batches = finished(spark, stateful.stream_alerts(stream, SETTINGS))
    batch = alerts.alerts(testdata.raw_calls(spark.read.parquet(pieces)), SETTINGS)
    assert batches == 5
    plain = lambda df: sorted(map(tuple, df.select("id", "tool_name", "server_name", "metric", F.round("value", 6), "threshold").collect()))
    assert plain(fired) == plain(batch) and batch.count() > 100


def test_pair_stream_equals_batch(spark, pieces):
    log = wiredata.as_log(wiredata.as_exchanges(spark.read.parquet(pieces)))
    folder, days = new_folder(spark, "log"), (0, 6, 12, 18, 24, 40)
    for start, end in zip(days, days[1:]):  # a response may come a file after its request
        part = log.where((F.dayofmonth("ts") + (F.month("ts") - 1) * 31 > start) & (F.dayofmonth("ts") + (F.month("ts") - 1) * 31 <= end))
        part.coalesce(1).write.mode("append").parquet(folder)
    arriving = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    pairs, batches = finished(spark, stateful.stream_pair_rpc(arriving))
    columns = ["conn", "rpc_id", "request_seq", "response_seq", "method", "params", "result", "error", "latency_ms"]
    whole = capture.pair_rpc_log(log).select(columns)
    assert batches == 5 and whole.count() > 5000
    assert whole.exceptAll(pairs.select(columns)).count() == 0
    assert pairs.select(columns).exceptAll(whole).count() == 0


def test_pairing_with_a_time_limit(spark, pieces):
    # With a time limit the query has to keep running, so it is stopped here.
    log = wiredata.as_log(wiredata.as_exchanges(streamed(spark, pieces)))
    out = new_folder(spark, "limited")
    query = sinks.to_parquet(stateful.stream_pair_rpc(log, ttl_ms=3_600_000), out, new_folder(spark, "state"))
    for _ in range(60):
        if query.awaitTermination(1) or sum(p.numInputRows > 0 for p in query.recentProgress) == 5:
            break
    query.stop()
    assert query.exception() is None
    assert spark.read.parquet(out).count() > 5000


def event(i, session="s", **more):
    return {"sessionId": session, "toolName": "t", "serverName": "a", "agentType": "other", "method": "tools/call",
            "status": "success", "latencyMs": 5, "timestamp": f"2026-01-01T00:00:{i:02d}Z",
            "arguments": {"n": i, "api_key": "x"}, "response": {"ok": i}, **more}


def write_lines(folder, name, events):
    with open(f"{folder}/{name}", "w") as f:
        f.writelines(json.dumps(e) + "\n" for e in events)


def test_ingest_stream(spark, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()
    paths = ingest.IngestPaths(*[str(tmp_path / n) for n in ("calls", "sessions", "rejected", "state")])

    def run():
        ingest.run_ingest_stream(spark, str(incoming), paths, Pricing(), available_now=True).awaitTermination()

    write_lines(incoming, "1.json", [event(1), event(2, "r"), event(3, ""), event(4, toolName="")])
    run()
    write_lines(incoming, "2.json", [event(5), event(6, "q"), event(7, response={"data": 1, "truncated": True, "sizeBytes": 4000})])
    run()
    calls = tables.read_tool_calls(spark, paths.calls)
    assert calls.count() == 5 and calls.select("id").distinct().count() == 5
    rows = {json.loads(r.arguments)["n"]: r for r in calls.collect()}
    assert rows[1].arguments == '{"api_key":"[REDACTED]","n":1}'
    assert rows[7].output_tokens == 1000 and rows[7].response.truncated
    assert [rows[i].id for i in (1, 2, 5, 6, 7)] == sorted(r.id for r in rows.values())
    stored = {r.id: r.started_at for r in ingest.read_sessions(spark, paths.sessions).withColumn(
        "started_at", F.second("started_at")).collect()}
    assert stored == {"q": 6, "r": 2, "s": 1}  # session s came again in the second batch
    assert spark.read.parquet(paths.rejected).count() == 2

    # The same batch again replaces itself.
    again = ingest.stream_events.__globals__["read_events"](spark, str(incoming / "2.json"))
    ingest.ingest_batch(again, 1, paths, Pricing())
    assert tables.read_tool_calls(spark, paths.calls).count() == 5
    assert ingest.read_sessions(spark, paths.sessions).count() == 3


def test_arrival_ids_are_unique_and_dense(spark):
    df = spark.range(1000).repartition(7).where("id % 3 > 0").withColumnRenamed("id", "n")
    numbered, rows = ingest._with_arrival_id(df, 5)
    ids = [r.id for r in numbered.collect()]
    assert sorted(ids) == list(range(5, 5 + rows)) and rows == df.count()


def test_arrival_ids_go_on_in_any_batch(spark, tmp_path):
    paths = ingest.IngestPaths(*(str(tmp_path / x) for x in ("calls", "sessions", "rejected", "state")))
    event = '{"sessionId":"s","agentType":"a","serverName":"v","toolName":"t","method":"m","status":"success","latencyMs":%s,"timestamp":"2026-03-09T10:00:00Z"}'

    def store(batch_id, *latencies):
        lines = spark.createDataFrame([(event % ms,) for ms in latencies], "value string")
        ingest.ingest_batch(ingest.stream_events.__globals__["parse_events"](lines), batch_id, paths)

    store(0, "1", "2")
    store(2**23, "3e9", "NaN", "4")  # no bound on batches; one bad latency is put aside
    store(2**23 + 1, "5")
    store(2**23, "3e9", "NaN", "4")  # again
    calls = tables.read_tool_calls(spark, paths.calls)
    assert sorted((r.id, r.latency_ms) for r in calls.collect()) == [(0, 1), (1, 2), (2, 3_000_000_000), (3, 4), (4, 5)]
    assert spark.read.parquet(paths.rejected).count() == 1


def test_stored_calls_round_trip(spark, sf, tmp_path):
    calls = testdata.calls(spark, sf)
    path = str(tmp_path / "calls")
    tables.write_tool_calls(calls, path)
    tables.write_tool_calls(calls, path)
    stored = tables.read_tool_calls(spark, path)
    assert stored.count() == 2 * calls.count()
    assert sessions.derive_sessions(stored).count() == sessions.derive_sessions(calls).count()
    fired = alerts.alerts(calls)
    tables.write_alerts(fired, str(tmp_path / "alerts"))
    assert tables.read_alerts(spark, str(tmp_path / "alerts")).count() == fired.count()


def test_one_day_is_read_and_compacted_by_itself(spark, sf, tmp_path):
    calls = testdata.calls(spark, sf)
    path, packed = str(tmp_path / "calls"), str(tmp_path / "packed")
    for batch_id in range(3):
        tables.write_tool_calls(calls.where(f"id % 3 = {batch_id}"), path, batch_id=batch_id)
    tables.write_tool_calls(calls.where("id % 3 = 1"), path, batch_id=1)
    assert tables.read_tool_calls(spark, path).count() == calls.count()
    day = tables.read_tool_calls(spark, path, ["2024-01-05", "1999-01-01"])
    assert day.inputFiles() and all("date=2024-01-05/" in f for f in day.inputFiles())
    tables.compact_day(spark, path, "2024-01-05", packed)
    assert tables.read_tool_calls(spark, packed).count() == day.count() == calls.where("to_date(timestamp) = '2024-01-05'").count()
    assert tables.read_tool_calls(spark, path, ["1999-01-01"]).count() == 0


def test_carried_sessions_equal_batch(spark, pieces):
    method = F.when(F.col("id") % 11 == 0, "initialize").otherwise(F.col("method"))
    calls = lambda df: testdata.raw_calls(df).drop("session_id").withColumn("method", method)
    out = new_folder(spark, "carried")
    carried.run_sessionize_stream(
        calls(streamed(spark, pieces)), out, f"{out}-carry", f"{out}-state", request_activity=False, available_now=True).awaitTermination()
    got = spark.read.parquet(out).select("id", "session_id")
    whole = sessions.sessionize(calls(spark.read.parquet(pieces)), request_activity=False).select("id", "session_id")
    # a long call of one file may end after a short one of the next began; such calls count as late
    assert got.count() == whole.count() and got.exceptAll(whole).count() <= 0.01 * whole.count()


def test_carried_sessions_go_on_and_take_late_calls(spark, make_calls, tmp_path):
    out, carry = str(tmp_path / "out"), str(tmp_path / "carry")
    minute = 60_000
    batches = [[(1, 0), (2, 10 * minute)], [(3, 11 * minute), (4, 30 * minute)], [], [(5, 2 * minute), (6, 31 * minute)]]
    for n, batch in enumerate(batches):
        calls = make_calls([(i, "s", "srv", "t", "success", 0, ms) for i, ms in batch])
        carried.sessionize_batch(calls.withColumn("method", F.lit("m")), n, out, carry)
    carried.sessionize_batch(calls.withColumn("method", F.lit("m")), 3, out, carry)  # again
    got = {r.id: r.session_id for r in spark.read.parquet(out).collect()}
    assert got == {1: "srv#1", 2: "srv#2", 3: "srv#2", 4: "srv#3", 5: "srv#3", 6: "srv#3"}


def test_carried_pairs_equal_batch(spark, pieces):
    log = wiredata.as_log(wiredata.as_exchanges(spark.read.parquet(pieces)))
    folder, days = new_folder(spark, "log"), (0, 6, 12, 18, 24, 40)
    for start, end in zip(days, days[1:]):
        part = log.where((F.dayofmonth("ts") + (F.month("ts") - 1) * 31 > start) & (F.dayofmonth("ts") + (F.month("ts") - 1) * 31 <= end))
        part.coalesce(1).write.mode("append").parquet(folder)
    arriving, out = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder), new_folder(spark, "pairs")
    carried.run_pairing_stream(arriving, out, f"{out}-carry", f"{out}-state", limit="2 days", available_now=True).awaitTermination()
    columns = ["conn", "rpc_id", "request_seq", "response_seq", "method", "params", "result", "error", "latency_ms"]
    got, whole = spark.read.parquet(out).select(columns), capture.pair_rpc_log(log).select(columns)
    assert whole.count() > 5000 and whole.exceptAll(got).count() == 0 and got.exceptAll(whole).count() == 0


def test_carried_alerts_equal_batch(spark, pieces):
    calls = testdata.raw_calls(streamed(spark, pieces))
    out = new_folder(spark, "carried-alerts")
    carried.run_carried_alert_stream(calls, out, f"{out}-carry", f"{out}-state", SETTINGS, available_now=True).awaitTermination()
    fired = tables.read_alerts(spark, out)
    whole = alerts.alerts(testdata.raw_calls(spark.read.parquet(pieces)), SETTINGS)
    assert fired.select("batch").distinct().count() > 1
    plain = lambda df: sorted(map(tuple, df.select("id", "tool_name", "server_name", "metric", F.round("value", 6), "threshold", "fired_at").collect()))
    assert plain(fired) == plain(whole) and whole.count() > 100


@pytest.mark.parametrize("error_rate, sizes", [(0.9, (3, 1, 150, 0, 47, 1, 301, 97)), (0.3, (199, 1, 1, 99, 1, 100, 200, 99))])
def test_carried_state_of_a_node_composes(spark, make_calls, error_rate, sizes):
    """Cuts at and around the trims of the buffer, a hot node and several small ones, empty batches."""
    rows = random_calls(21, sum(sizes), error_rate, hot=0.8)
    want, got, at = stepwise_state(rows), {}, 0
    before = spark.createDataFrame([], alerts.NODE_STATE)
    for size in sizes:
        seen, left = alerts.rolling_tool_state_from(make_calls(rows[at:at + size]), before)
        got |= {r.id: (r.buffer_calls, r.p95_latency_ms, r.error_count) for r in seen.collect()}
        left = {(r.server_name, r.tool_name): tuple(r) for r in left.collect()}
        known = {(r.server_name, r.tool_name): tuple(r) for r in before.collect()} | left
        assert all(len(state[5]) <= 200 for state in known.values())
        before = spark.createDataFrame(list(known.values()), alerts.NODE_STATE)
        at += size
    assert got == want


def test_cooldown_goes_on_from_the_last_alert(spark):
    rng = random.Random(5)
    times = sorted({rng.randrange(4000) for _ in range(300)})
    rows = [(i, "srv", rng.choice("ab"), t, "m", 1.0, 0.0) for i, t in enumerate(times)]
    make = lambda part: spark.createDataFrame(part, "id long, server_name string, tool_name string, ms long, metric string, value double, threshold double").withColumn(
        "timestamp", F.timestamp_millis("ms")).drop("ms")
    whole = {r.id for r in alerts.fire_alerts(make(rows), 100).collect()}
    got, last = set(), {}
    for at in range(0, len(rows), 40):
        before = spark.createDataFrame([(*k, t) for k, t in last.items()], alerts.FIRED_STATE)
        part = rows[at:at + 40] + ([rows[at - 1]] if at else [])  # the last candidate again: as late as the alert it fired
        for r in alerts.fire_alerts(make(part), 100, before).collect():
            got.add(r.id)
            at_ms = next(row[3] for row in rows if row[0] in (r.id, ~r.id))
            last[(r.tool_name, r.metric)] = max(last.get((r.tool_name, r.metric), -1), at_ms)
    assert got == whole


def test_a_wrong_clock_gives_up_no_open_request(spark, tmp_path):
    out, carry = str(tmp_path / "out"), str(tmp_path / "carry")
    line = lambda conn, direction, seq, ts, text: (conn, direction, seq, ts, text)
    request, answer = '{"id":%d,"method":"m"}', '{"id":%d,"result":0}'
    batches = [
        [line("a", "agent", 0, "2026-01-01 10:00:00", request % 1), line("b", "agent", 1, "2026-01-01 10:00:01", request % 1),
         line("a", "agent", 2, "2026-01-01 10:00:02", request % 2), line("c", "agent", 3, "2099-01-01 00:00:00", request % 1),
         line("a", "agent", 4, "2099-01-01 00:00:00", request % 3)],
        [line("a", "server", 5, "2026-01-01 10:00:05", answer % 1), line("c", "server", 6, "2026-01-01 10:00:06", answer % 9)],
        [line("a", "server", 7, "2026-01-01 12:30:00", answer % 8), line("b", "server", 8, "2026-01-01 10:00:09", answer % 1)],
        [line("a", "server", 9, "2026-01-01 12:30:01", answer % 2)],
    ]
    for n, batch in enumerate(batches):
        log = spark.createDataFrame(batch, "conn string, direction string, seq long, ts string, line string").withColumn("ts", F.col("ts").cast("timestamp"))
        carried.pair_batch(log, n, out, carry)
    pairs = sorted((r.conn, r.request_seq, r.response_seq) for r in spark.read.parquet(out).collect())
    assert pairs == [("a", 0, 5), ("b", 1, 8)]  # request 2 of a was over two hours behind a's lines
    assert sorted(p.name for p in (tmp_path / "carry").iterdir()) == ["batch=2", "batch=3"]


@pytest.fixture
def out_of_order(spark, make_calls):
    """Calls and closings of some hours, in five files; each comes up to nine minutes after a later one."""
    rng, ms, rows = random.Random(8), 1_700_000_000_000, []
    for i in range(400):
        ms += rng.choice([0, 10, 60_000, 200_000, 310_000])
        rows.append((i, "s", rng.choice(["hot", "hot", "cold"]), "t", "success", rng.choice([0, 5, 40_000]), ms + rng.randrange(1000)))
    ends = [(rng.choice(["hot", "cold", "never"]), rng.choice(rows)[6] + rng.randrange(400_000)) for _ in range(40)]
    arrival = lambda at: at + rng.randrange(540_000)
    calls = make_calls(rows).drop("session_id").withColumn("method", F.when(F.col("id") % 37 == 0, "initialize").otherwise("m"))
    closings = spark.createDataFrame(ends, "conn string, ms long").withColumn("ended_at", F.timestamp_millis("ms")).drop("ms")
    first, last = rows[0][6], rows[-1][6] + 600_000
    folders = new_folder(spark, "calls"), new_folder(spark, "closings")
    order = {r[0]: arrival(r[6]) for r in rows}
    for part in range(5):
        low, high = (first + (last - first) * k // 5 for k in (part, part + 1))
        ids = [i for i, at in order.items() if low <= at < high or part == 4 and at >= high]
        calls.where(F.col("id").isin(ids)).coalesce(1).write.mode("append").parquet(folders[0])
        closings.where((F.unix_millis("ended_at") >= low) & ((F.unix_millis("ended_at") < high) | F.lit(part == 4))).coalesce(1).write.mode(
            "append").parquet(folders[1])
    read = [spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f) for df, f in zip((calls, closings), folders)]
    return calls, closings, *read


def test_ordered_sessions_equal_batch(spark, out_of_order):
    calls, closings, calls_stream, closings_stream = out_of_order
    got, batches = finished(spark, stateful.stream_sessionize_ordered(calls_stream, closings_stream))
    newest = max(calls.agg(F.max(F.unix_millis("timestamp") + F.col("latency_ms"))).first()[0], closings.agg(F.max(F.unix_millis("ended_at"))).first()[0])
    passed = calls.where(F.unix_millis("timestamp") + F.col("latency_ms") < newest - 600_000).select("id")
    whole = sessions.sessionize(calls, ends=closings).select("id", "session_id").join(passed, "id")
    assert batches >= 5 and got.count() == whole.count() > 350 and got.exceptAll(whole).isEmpty()


@pytest.fixture
def one_connection(spark, make_calls):
    """Calls of nine days on one connection, some initializing, and its closings, in two files; slots begin with closings and after gaps."""
    rng, ms, rows = random.Random(12), 1_700_000_000_000 // stateful.SLOT_MS * stateful.SLOT_MS, []
    for i in range(1500):
        ms += rng.choice([0, 10, 60_000, 200_000, 310_000, 2_000_000])
        rows.append((i, "s", "hot", "t", "success", rng.choice([0, 5, 40_000, 4_000_000]), ms))
    starts = range(rows[0][6], rows[-1][6], stateful.SLOT_MS)
    ends = [("hot", at) for at in starts[::2]] + [("hot", at - 1) for at in starts[::4]] + [("hot", rng.choice(rows)[6] + rng.randrange(400_000)) for _ in range(60)]
    calls = make_calls(rows).drop("session_id").withColumn("method", F.when(F.col("id") % 37 == 0, "initialize").otherwise("m"))
    closings = spark.createDataFrame(ends, "conn string, ms long").withColumn("ended_at", F.timestamp_millis("ms")).drop("ms")
    read = []
    for df, time in ((calls, "timestamp"), (closings, "ended_at")):
        folder, middle = new_folder(spark, "one"), F.timestamp_millis(F.lit(rows[700][6]))
        for half in (F.col(time) < middle, F.col(time) >= middle):
            df.where(half).coalesce(1).write.mode("append").parquet(folder)
        read.append(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder))
    return calls, closings, *read


def tasks_of(got):
    """How many tasks of the last step wrote rows; a key goes to the same one in every micro-batch."""
    return got.select(F.regexp_extract(F.input_file_name(), "part-([0-9]+)-", 1)).distinct().count()


def test_one_connection_goes_through_many_tasks(spark, one_connection):
    calls, closings, calls_stream, closings_stream = one_connection
    closed = F.timestamp_millis(F.unix_millis("timestamp") + F.col("latency_ms"))
    newest = max(calls.agg(F.max(F.unix_millis(closed))).first()[0], closings.agg(F.max(F.unix_millis("ended_at"))).first()[0])
    got, _ = finished(spark, stateful.stream_sessionize_ordered(calls_stream, closings_stream, late="2 hours"))
    passed = lambda at: F.unix_millis(at) < newest - 7_200_000
    whole = sessions.sessionize(calls, ends=closings).select("id", "session_id").join(calls.where(passed(closed)).select("id"), "id")
    assert got.count() == whole.count() > 1300 and got.exceptAll(whole).isEmpty() and tasks_of(got) > 1
    ended, _ = finished(spark, stateful.stream_session_ends(calls_stream, closings_stream, late="2 hours"))
    whole = sessions.session_ends(calls, closings).where(passed(F.col("ended_at")))
    assert ended.count() == whole.count() > 60 and ended.exceptAll(whole).isEmpty() and tasks_of(ended) > 1


def test_one_connection_as_it_arrives(spark, one_connection):
    calls, _, calls_stream, _ = one_connection
    short = lambda df: df.withColumn("latency_ms", F.col("latency_ms") % 1000)  # noqa: E731  files in the order of activity
    got, batches = finished(spark, stateful.stream_sessionize(short(calls_stream)))
    whole = sessions.sessionize(short(calls)).select("id", "session_id")
    assert batches == 2 and got.count() == whole.count() == 1500 and got.exceptAll(whole).isEmpty() and tasks_of(got) > 1


def test_joined_pairs_equal_batch_and_forget(spark):
    """Ids used once; answers within a minute, too late or missing; a file is an hour."""
    rng, lines = random.Random(3), []
    for i in range(300):
        at = i * 60
        lines.append(("c" if i % 3 else "d", "agent", i, at, '{"id":%d,"method":"m","params":{"n":%d}}' % (i, i)))
        if i % 4:
            lines.append((lines[-1][0], "server", i, at + rng.randrange(1, 50), '{"id":%d,"result":{"n":%d}}' % (i, i)))
        elif i % 8:
            lines.append((lines[-1][0], "server", i, at + 90, '{"id":%d,"result":0}' % i))
    log = spark.createDataFrame(lines, "conn string, direction string, seq long, s long, line string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    folder = new_folder(spark, "hours")
    for hour in range(5):
        log.where(F.hour("ts") == hour).coalesce(1).write.mode("append").parquet(folder)
    out = new_folder(spark, "joined")
    arriving = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = sinks.to_parquet(series.stream_join_rpc(arriving, limit="1 minute", late="30 seconds"), out, new_folder(spark, "state"), available_now=True)
    query.awaitTermination()
    columns = ["conn", "rpc_id", "request_seq", "response_seq", "method", "params", "result", "error", "latency_ms"]
    got, whole = spark.read.parquet(out).select(columns), capture.pair_rpc_log(log).where("latency_ms <= 60000").select(columns)
    assert got.count() == whole.count() == 225 and got.exceptAll(whole).isEmpty()
    held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress]
    assert max(held) <= 250 and held[-1] <= 12  # two files of lines at most, at the end what the watermark has not passed


def test_one_id_is_joined_in_many_tasks(spark):
    """One connection sends one id all day: a few lines within the limit, in several files, some at the edges of spans."""
    rng, minute = random.Random(4), 60_000_000
    edges = [n * series.SPAN * minute for n in range(1, 350)]
    times = [rng.randrange(1440 * minute) for _ in range(600)] + [at + d for at in rng.sample(edges, 150) for d in (-1, 0)]
    lines = [("c", "agent", i, at, '{"id":1,"method":"m%d"}' % i) for i, at in enumerate(times)]
    later = [rng.choice((0, 1, minute // 2, minute - 1, minute, minute + 1)) for _ in times]
    lines += [("c", "server", i, at + d, '{"id":1,"result":%d}' % i) for i, (at, d) in enumerate(zip(times, later))]
    log = spark.createDataFrame(lines, "conn string, direction string, seq long, us long, line string").withColumn("ts", F.timestamp_micros("us"))
    folder = new_folder(spark, "one-id")
    for part in range(4):  # an answer may come a file after its request
        log.where(F.floor(F.col("us") / (361 * minute)) == part).drop("us").coalesce(1).write.mode("append").parquet(folder)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    arriving = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = new_folder(spark, "joined")
    query = sinks.to_parquet(series.stream_join_rpc(arriving, limit="1 minute", late="1 hour"), out, new_folder(spark, "state"), available_now=True)
    query.awaitTermination()
    got = spark.read.parquet(out)
    asked, answered = [sorted((at, seq) for _, who, seq, at, _ in lines if who == side) for side in ("agent", "server")]
    whole = sorted((i, j, r // 1000 - t // 1000) for t, i in asked for r, j in answered if t <= r <= t + minute)
    assert sorted(map(tuple, got.select("request_seq", "response_seq", "latency_ms").collect())) == whole and len(whole) > 900
    assert sum(p.numInputRows > 0 for p in query.recentProgress) == 4 and tasks_of(got) > 1
    assert any("rocksdb" in name for p in query.recentProgress for s in p["stateOperators"] for name in s["customMetrics"])
