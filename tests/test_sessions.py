"""Sessions by idle gap, session tables."""

from pyspark.sql import functions as F

from callscope.operators import sessions

MINUTES = 60_000


def split(make_calls, rows, method=None, **options):
    df = make_calls(rows).drop("session_id").withColumn("method", method if method is not None else F.lit("tools/call"))
    got = sessions.sessionize(df, **options).collect()
    return {r.id: r.session_id for r in got}


def call(i, ms, latency=0, server="a"):
    return (i, "", server, "t", "success", latency, ms)


def test_gap_is_strict(make_calls):
    at = [0, 5 * MINUTES, 10 * MINUTES + 1]
    assert split(make_calls, [call(i, ms) for i, ms in enumerate(at)]) == {0: "a#1", 1: "a#1", 2: "a#2"}


def test_activity_at_response_counts(make_calls):
    rows = [call(0, 0, 4 * MINUTES), call(1, 9 * MINUTES), call(2, 20 * MINUTES, 6 * MINUTES)]
    # A response six minutes after its request comes too late: the call is in a new session.
    assert split(make_calls, rows) == {0: "a#1", 1: "a#1", 2: "a#3"}
    assert split(make_calls, rows, request_activity=False) == {0: "a#1", 1: "a#1", 2: "a#2"}


def test_initialize_splits_and_connections_are_apart(make_calls):
    rows = [call(0, 0), call(1, 1000), call(2, 2000), call(3, 1500, server="b")]
    method = F.when(F.col("id") == 1, "initialize").otherwise("tools/call")
    assert split(make_calls, rows, method) == {0: "a#1", 1: "a#2", 2: "a#2", 3: "b#1"}


def test_ids_of_different_connections_may_repeat(make_calls):
    df = make_calls([call(1, 0), call(1, 5, server="b"), call(2, 9 * MINUTES)]).drop("session_id").withColumn("method", F.lit("x"))
    got = sorted((r.server_name, r.id, r.session_id) for r in sessions.sessionize(df).collect())
    assert got == [("a", 1, "a#1"), ("a", 2, "a#2"), ("b", 1, "b#1")]


def test_session_override(make_calls):
    df = make_calls([call(0, 0), call(1, 1)]).withColumns({
        "method": F.lit("x"), "session_id": F.when(F.col("id") == 0, "mine")})
    assert {r.id: r.session_id for r in sessions.sessionize(df).collect()} == {0: "mine", 1: "a#1"}


def test_known_sessions_stay(make_calls, spark):
    calls = make_calls([(1, "s1", "", "t", "success", 1, 10), (2, "s1", "z", "t", "success", 1, 5), (3, "s2", "b", "t", "success", 1, 7)])
    derived = sessions.derive_sessions(calls)
    assert {r.id: r.server_name for r in derived.collect()} == {"s1": "unknown", "s2": "b"}
    known = derived.where("id = 's1'").withColumn("server_name", F.lit("kept"))
    merged = sessions.merge_sessions(known, calls)
    assert {r.id: r.server_name for r in merged.collect()} == {"s1": "kept", "s2": "b"}
    ends = spark.createDataFrame([("s1", 1000), ("s1", 3000), ("s9", 1)], "session_id string, ms long").select(
        "session_id", F.timestamp_millis("ms").alias("ended_at"))
    ended = {r.id: r.ended_at for r in sessions.apply_session_ends(merged, ends).withColumn("ended_at", F.unix_millis("ended_at")).collect()}
    assert ended == {"s1": 3000, "s2": None}
    listed = sessions.list_sessions(merged.union(spark.createDataFrame(
        [("empty", "b")], "id string, server_name string").selectExpr(
        "id", "server_name", "timestamp_millis(99) as started_at", "null as ended_at", "null as label")), calls)
    assert [(r.id, r.call_count) for r in listed.collect()] == [("empty", 0), ("s1", 2), ("s2", 1)]
    assert sessions.replay(merged, calls, "nobody").count() == 0


def test_closing_ends_the_session(make_calls, spark):
    rows = [call(0, 0), call(1, 1000), call(2, 3000), call(3, 5000)]
    ends = spark.createDataFrame([("a", 2000), ("a", 2500), ("a", 9000), ("b", 1)], "conn string, ms long").select(
        "conn", F.timestamp_millis("ms").alias("ended_at"))
    assert split(make_calls, rows, ends=ends) == {0: "a#1", 1: "a#1", 2: "a#2", 3: "a#2"}
    df = make_calls(rows).drop("session_id").withColumn("method", F.lit("x"))
    closed = sessions.session_ends(df, ends).select("session_id", F.unix_millis("ended_at").alias("ms")).collect()
    assert sorted(map(tuple, closed)) == [("a#1", 2000), ("a#2", 9000)]


def test_unanswered_requests_keep_a_session_alive(make_calls, spark):
    rows = [call(0, 0), call(1, 8 * MINUTES)]
    touches = spark.createDataFrame([("a", 0, False), ("a", 4 * MINUTES, False), ("a", 8 * MINUTES, False)],
                                    "conn string, ms long, opens boolean").withColumn("timestamp", F.timestamp_millis("ms"))
    assert split(make_calls, rows) == {0: "a#1", 1: "a#2"}
    assert split(make_calls, rows, touches=touches) == {0: "a#1", 1: "a#1"}
