"""Tables that streams maintain by key."""

import contextlib
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from callscope.streaming import ingest
from callscope.streaming.keyed import KeyedTable, latest


def table(path, **kw):
    return KeyedTable(str(path), ("k",), "k string, v long", latest("k"), **{"buckets": 4, "merge_after": 2, **kw})


def rows(spark, values):
    return spark.createDataFrame(list(values.items()), "k string, v long")


def content(df):
    return {r.k: r.v for r in df.collect()}


def test_holds_the_latest_row_of_each_key(spark, tmp_path):
    rng, t, want, steps = random.Random(3), table(tmp_path / "t"), {}, []
    assert content(t.read(spark)) == {}
    for batch in range(7):
        values = {f"k{rng.randrange(12)}": batch * 100 + i for i in range(rng.randrange(4))}
        t.update(batch, rows(spark, values))
        want |= values
        steps.append(dict(want))
        assert content(t.read(spark)) == want and content(t.read(spark, batch)) == (steps[-2] if batch else {})
    of = spark.createDataFrame([("k1",), ("k1",), ("k5",), ("new",)], "k string")
    assert content(t.read(spark, of=of)) == {k: v for k, v in want.items() if k in ("k1", "k5")}


def test_a_retried_batch_changes_nothing_and_old_files_go(spark, tmp_path):
    t, every = table(tmp_path / "t", buckets=2, merge_after=3), {f"k{i}": 0 for i in range(9)}
    for batch in range(12):
        values = {k: batch for k in every}
        t.update(batch, rows(spark, {"k0": -1, "k1": -2}) if batch == 7 else rows(spark, values))
        if batch == 7:  # died after a part of its work
            t.update(batch, rows(spark, values))
        assert content(t.read(spark)) == values
    indexes = os.listdir(tmp_path / "t" / "index")
    assert sorted(i for i in indexes if "=" in i) == ["batch=10", "batch=11"]
    live = [d for d, _, files in os.walk(tmp_path / "t" / "rows") if any(f.endswith(".parquet") for f in files)]
    assert len(live) <= 2 * 2 * 4


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_a_batch_reads_the_buckets_of_its_keys_only(spark, tmp_path):
    t = table(tmp_path / "t", buckets=16)
    t.update(0, rows(spark, {f"k{i}": i for i in range(500)}))
    few = t.read(spark, 1, of=spark.createDataFrame([("k7",)], "k string"))
    assert content(few) == {"k7": 7} and plan(few).count("bucket=") <= 2
    assert len(t._rows(spark, [p for p in t._parts(spark, None) if p[0] in t._touched(rows(spark, {"k7": 1}))]).inputFiles()) == 1


@pytest.fixture
def paths(tmp_path):
    return ingest.IngestPaths(*(str(tmp_path / x) for x in ("calls", "sessions", "rejected", "state")))


EVENT = '{"sessionId":"%s","agentType":"a","serverName":"%s","toolName":"t","method":"m","status":"success","latencyMs":1,"timestamp":"2026-03-09T10:%02d:00Z"}'


def test_sessions_keep_their_first_event_and_get_their_last_end(spark, paths, monkeypatch):
    parse = ingest.stream_events.__globals__["parse_events"]

    def store(batch_id, *events):
        ingest.ingest_batch(parse(spark.createDataFrame([(EVENT % e,) for e in events], "value string")), batch_id, paths)

    def end(batch_id, *markers):
        ingest.end_batch(spark.createDataFrame([(*m, None) for m in markers], "sessionId string, endedAt string, _corrupt_record string"), batch_id, paths)

    end(0, ("late", "2026-03-09T11:00:00Z"), ("s", "2026-03-09T12:00:00Z"))  # before any call of theirs
    store(0, ("s", "v", 1), ("r", "", 2))
    reads = []
    plain = ingest.session_table(paths.sessions).__class__._rows
    monkeypatch.setattr(KeyedTable, "_rows", lambda self, spark, parts: reads.append(len(parts)) or plain(self, spark, parts))
    store(1, ("s", "w", 0), ("late", "v", 3))  # an earlier time, but arrived later
    assert not reads  # a batch reads no stored session
    end(1, ("s", "2026-03-09T11:30:00+00:00"), ("", "2026-03-09T11:30:00Z"), ("r", "soon"), ("nobody", "2026-03-09T11:30:00Z"), (None, None))
    store(1, ("s", "w", 0), ("late", "v", 3))  # again
    stored = ingest.read_sessions(spark, paths.sessions, paths.ends).select("id", "server_name", F.minute("started_at"), F.hour("ended_at")).collect()
    assert sorted(map(tuple, stored)) == [("late", "v", 3, 11), ("r", "unknown", 2, None), ("s", "v", 1, 12)]
    assert spark.read.parquet(f"{paths.ends}-rejected").count() == 3
    assert ingest.read_sessions(spark, paths.sessions).where("ended_at is not null").isEmpty()
