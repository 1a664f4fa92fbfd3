"""Request/response pairing and event intake: hand-written edges."""

import random

import pytest
from pyspark.sql import functions as F

from callscope.sources import capture, events

LOG = "conn string, direction string, seq long, ms long, line string"


def log_of(spark, rows):
    return spark.createDataFrame(rows, LOG).withColumn("ts", F.timestamp_millis("ms")).drop("ms")


def test_pairing_edges(spark):
    rows = [
        ("c", "agent", 1, 0, '{"id":1,"method":"tools/call","params":{"name":"t","arguments":{"a":1}}}'),
        ("c", "agent", 2, 5, '{"id":"1","method":"tools/list"}'),
        ("c", "agent", 3, 6, '{"method":"notifications/x"}'),
        ("c", "agent", 4, 7, "   "),
        ("c", "agent", 5, 8, "not json"),
        ("c", "server", 1, 10, '{"id":1,"result":{"ok":true}}'),
        ("c", "server", 2, 11, '{"id":"1","result":null}'),
        ("c", "server", 3, 12, '{"id":1,"result":"orphan"}'),
        ("c", "server", 4, 13, '{"id":9,"method":"sampling/create"}'),
        ("c", "agent", 6, 14, '{"id":9,"result":1}'),
        ("c", "agent", 7, 20, '{"id":2,"method":"a"}'),
        ("c", "agent", 8, 21, '{"id":2,"method":"b"}'),
        ("c", "server", 5, 30, '{"id":2,"error":{"code":-32601,"message":"Unknown tool"}}'),
        ("c", "agent", 9, 40, '{"id":3,"method":"never answered"}'),
        ("d", "server", 1, 41, '{"id":3,"result":1}'),
        ("c", "agent", 10, 50, '{"id":null,"method":"initialize"}'),
        ("c", "server", 6, 51, '{"id":null,"result":[]}'),
        ("c", "agent", 11, 60, '{"id":4,"method":""}'),
        ("c", "server", 7, 61, '{"id":4,"result":1}'),
    ]
    got = capture.pair_rpc_log(log_of(spark, rows)).orderBy("timestamp", "request_seq").collect()
    assert [(r.request_seq, r.response_seq, r.method, r.rpc_id, r.latency_ms, r.result, r.error) for r in got] == [
        (1, 1, "tools/call", "1", 10, '{"ok":true}', None),
        (2, 2, "tools/list", '"1"', 6, None, None),
        (8, 5, "b", "2", 9, None, '{"code":-32601,"message":"Unknown tool"}'),
        (10, 6, "initialize", "null", 1, "[]", None),
    ]
    call = capture.map_capture_fields(capture.pair_rpc_log(log_of(spark, rows)), "stdio").orderBy("timestamp").collect()
    assert [(c.tool_name, c.arguments, c.response, c.status, c.error_msg, c.error_code) for c in call] == [
        ("t", '{"a":1}', '{"ok":true}', "success", None, None),
        ("tools/list", None, None, "success", None, None),
        ("b", None, None, "error", "Unknown tool", -32601),
        ("initialize", None, "[]", "success", None, None),
    ]


def test_pairing_equals_a_stepwise_model(spark):
    rng, rows, pairs, seqs = random.Random(3), [], [], {}
    open_requests = {}
    for ms in range(3000):
        conn, direction, rpc = rng.choice("ab"), rng.choice(["agent", "server"]), rng.choice([0, 0, 0, 1, 2])
        seq = seqs[(conn, direction)] = seqs.get((conn, direction), 0) + 1
        line = f'{{"id":{rpc},"method":"m"}}' if direction == "agent" else f'{{"id":{rpc},"result":{ms}}}'
        rows.append((conn, direction, seq, ms, line))
        if direction == "agent":
            open_requests[(conn, rpc)] = seq
        elif (conn, rpc) in open_requests:
            pairs.append((conn, open_requests.pop((conn, rpc)), seq))
    got = capture.pair_rpc_log(log_of(spark, rows)).select("conn", "request_seq", "response_seq").collect()
    assert sorted(map(tuple, got)) == sorted(pairs)


def test_http_exchanges(spark):
    rows = [
        (1, '{"method":"tools/call","params":{"name":"t","arguments":[1]}}', '{"result":{"a":1}}', None),
        (2, '{"method":"tools/call","params":{"arguments":null}}', "<html>", None),
        (3, '{"method":"x"}', '{"error":{"code":5,"message":"m"}}', None),
        (4, "garbage", "{}", None), (5, '{"id":1}', "{}", None), (6, "null", "{}", "down"),
        (7, '{"method":"tools/call","params":{"name":"t"}}', None, "refused"), (8, "{}", None, "refused"),
        (9, '{"method":"x"}', "null", None),
    ]
    df = spark.createDataFrame(rows, "id int, request_body string, response_body string, proxy_error string")
    df = df.withColumns({"server": F.lit("s"), "t0": F.timestamp_millis(F.lit(0)), "t1": F.timestamp_millis(F.lit(25))})
    got = {r.id: r for r in capture.calls_from_http(df).collect()}
    assert sorted(got) == [1, 2, 3, 7, 8, 9]
    shown = {i: (r.tool_name, r.arguments, r.response, r.status, r.error_msg, r.error_code, r.latency_ms) for i, r in got.items()}
    assert shown == {
        1: ("t", "[1]", '{"a":1}', "success", None, None, 25),
        2: ("tools/call", '{"arguments":null}', None, "success", None, None, 25),
        3: ("x", None, None, "error", "m", 5, 25),
        7: ("tools/call", '{"name":"t"}', None, "error", "refused", None, 25),
        8: ("unknown", None, None, "error", "refused", None, 25),
        9: ("x", None, None, "success", None, None, 25),
    }


def test_unknown_capture_source(spark):
    pairs = capture.pair_rpc_log(log_of(spark, [("c", "agent", 1, 0, "{}")]))
    with pytest.raises(ValueError):
        capture.map_capture_fields(pairs, "fax")


def test_event_payloads_keep_their_shape(spark):
    rest = '"agentType":"other","serverName":"","method":"m","status":"success"'
    lines = [
        '{"sessionId":"s","toolName":"t","timestamp":"2026-03-09T10:00:00Z","arguments":"text","response":null,"latencyMs":5,' + rest + "}",
        '{"sessionId":"s","toolName":"t","timestamp":"2026-03-09T12:00:00.000001+02:00","arguments":{"b":1,"a":1.0,"b":2},"latencyMs":5,' + rest + "}",
        '{"sessionId":"","toolName":"t","timestamp":"2026-03-09T10:00:00Z","latencyMs":5,' + rest + "}",
        '{"sessionId":" ","toolName":"t","timestamp":"2026-03-09T10:00:00Z","latencyMs":5,' + rest + "}",
        '{"toolName":"t","timestamp":"2026-03-09T10:00:00Z","latencyMs":5,' + rest + "}",
        '{"sessionId":"s","toolName":"t","timestamp":"yesterday","latencyMs":5,' + rest + "}",
        '{"sessionId":"s","toolName":"t","timestamp":"2026-03-09T10:00:00Z",' + rest + "}",
        "{broken",
        '{"sessionId":"s","toolName":"t","timestamp":"2026-03-09T10:00:00Z","latencyMs":7.5,' + rest + "}",
    ]
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, value string")
    valid, rejected = events.validate_events(events.parse_events(df, keep=("i",)))
    got = {r.i: r for r in valid.collect()}
    assert sorted(got) == [0, 1, 3, 8]
    assert got[8].latency_ms == 8
    assert got[0].arguments == '"text"' and got[0].latency_ms == 5
    assert got[1].arguments == '{"a":1,"b":2}'
    assert (got[1].timestamp - got[0].timestamp).total_seconds() == 1e-6
    assert {r.i: (" ".join(r.reason.split()[:3]), r.unparsed) for r in rejected.collect()} == {
        2: ("an event needs", None), 4: ("an event needs", None), 5: ("unreadable timestamp", None),
        6: ("a value the", None), 7: ("an event needs", "{broken")}
