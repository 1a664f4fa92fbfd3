"""Reports from the maintained histogram equal those from the calls."""

import json

import pytest
from pyspark.sql import functions as F
from test_plans import plan
from test_streaming import event, write_lines

from callscope.config import Pricing
from callscope.operators import filters, metrics, rollup
from callscope.plans import testdata
from callscope.sources import tables
from callscope.streaming import ingest


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path, source = str(tmp_path_factory.mktemp("rolled") / "calls"), testdata.calls(spark, "/root/testdata/sf0.01")
    for batch_id in (0, 1, 1):  # the second batch twice
        part = source.where(F.col("id") % 2 == batch_id)
        tables.write_tool_calls(part, path, batch_id=batch_id)
        tables.write_rollup(rollup.rollup(part), f"{path}-rollup", batch_id)
    return tables.read_rollup(spark, f"{path}-rollup").cache(), tables.read_tool_calls(spark, path)


def rows(df):
    names = sorted(df.columns)
    rounded = [F.round(c, 6).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c).cast("string").alias(c) for c in names]
    return sorted(map(tuple, df.select(rounded).collect()), key=str)


@pytest.mark.parametrize("as_of, window", [
    ("2024-01-20 00:07:30", "6h"), ("2024-01-20 00:15:00", "6h"), ("2024-01-20 00:00:00.000001", "24h"), ("2024-01-19 23:59:59.999", "7d"),
    ("2031-01-01 00:00:00", "1h")])
def test_windows_cut_anywhere(stored, as_of, window):
    rolled, calls = stored
    chosen, found = filters.since(calls, as_of, window), rollup.rows_since(rolled, calls, as_of, window).cache()
    for name in ("tool_stats", "tool_volume_series", "cost_by_node", "error_class_series"):
        assert rows(getattr(rollup, name)(found)) == rows(getattr(metrics, name)(chosen)), name
    assert rows(rollup.overview(found)) == rows(metrics.overview_of(chosen))
    if window == "6h":
        for name in ("tool_latency_series", "tool_error_series", "token_usage_by_node", "token_usage_by_agent_type", "token_series", "cost_series"):
            assert rows(getattr(rollup, name)(found)) == rows(getattr(metrics, name)(chosen)), name
        assert rows(rollup.server_health(found)) == rows(metrics.server_health_of(chosen))


def test_only_the_cut_bucket_is_read_from_the_calls(stored):
    rolled, calls = stored
    text = plan(rollup.tool_stats(rollup.rows_since(rolled, calls, "2024-01-20 00:07:30", "24h")))
    filters_of_calls = [line for line in text.splitlines() if line.startswith("PushedFilters") and "GreaterThan(timestamp" in line]
    assert filters_of_calls and all(
        "GreaterThan(timestamp,2024-01-19 00:07:30.0)" in line and "LessThan(timestamp,2024-01-19 00:15:00.0)" in line for line in filters_of_calls)
    assert "arguments" not in text and "response" not in text


def test_ingest_adds_to_the_rollup(spark, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()
    paths = ingest.IngestPaths(*[str(tmp_path / n) for n in ("calls", "sessions", "rejected", "state")])
    for name, events in (("1.json", [event(1), event(2, status="error"), event(3, "")]), ("2.json", [event(5), event(6, timestamp="2026-01-03T10:00:00Z")]),
                         ("3.json", [event(7, "")])):
        write_lines(incoming, name, events)
        ingest.run_ingest_stream(spark, str(incoming), paths, Pricing(), available_now=True).awaitTermination()
    calls, rolled = tables.read_tool_calls(spark, paths.calls), tables.read_rollup(spark, paths.rollup)
    assert rolled.agg(F.sum("calls")).first()[0] == calls.count() == 4
    assert rows(rollup.tool_stats(rolled)) == rows(metrics.tool_stats(calls))
    again = ingest.stream_events.__globals__["read_events"](spark, str(incoming / "2.json"))
    ingest.ingest_batch(again, 1, paths, Pricing())
    calls, rolled = tables.read_tool_calls(spark, paths.calls), tables.read_rollup(spark, paths.rollup)
    assert rows(rollup.token_usage_by_node(rolled)) == rows(metrics.token_usage_by_node(calls))
    assert json.loads(tables.read_batch(spark, paths.calls, 1, ["2026-01-03"]).first().arguments)["n"] == 6
    assert tables.read_batch(spark, paths.calls, 1, []).count() == 0
