"""What the physical plans must and must not do."""

import ast
import contextlib
import io
import pathlib

import pytest

from callscope.operators import filters, metrics, topk
from callscope.plans import testdata
from callscope.sources import tables

PACKAGE = pathlib.Path(__file__).parent.parent / "callscope"


@pytest.fixture(scope="module")
def stored(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "calls")
    tables.write_tool_calls(testdata.calls(spark, sf), path)
    return tables.read_tool_calls(spark, path)


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("report", [
    metrics.tool_stats, metrics.server_health_of, metrics.overview_of, metrics.token_usage_by_node, metrics.cost_by_node,
    metrics.cost_series, metrics.errors_by_class, metrics.error_class_series, metrics.tool_latency_series, topk.recent_errors])
def test_reports_read_no_payload(stored, report):
    text = plan(report(filters.since(stored, "2024-01-20 00:00:00", "6h")))
    schemas = [line for line in text.splitlines() if line.startswith("ReadSchema")]
    assert schemas and not any("arguments" in s or "response" in s for s in schemas)
    assert "GreaterThan(timestamp,2024-01-19" in text
    assert "PartitionFilters: [isnotnull(date" in text and "2024-01-18" in text


def test_unknown_window_means_a_day(stored):
    count = lambda window: filters.since(stored, "2024-01-20 00:00:00", window).count()
    assert count("24h") == count("2 weeks") > count("1h")


def test_tool_and_status_filters_are_pushed(stored):
    text = plan(filters.failed(filters.by_tool(stored, "tool1")))
    assert "EqualTo(tool_name,tool1)" in text and "Not(EqualTo(status,success))" in text


def test_listings_are_top_k(stored):
    assert "TakeOrderedAndProject" in plan(topk.recent_calls(stored.drop("arguments", "response")))


def test_percentiles_shuffle_the_histogram(stored):
    text = plan(metrics.tool_stats(stored))
    assert "partial_count(1)" in text and "collect_list" not in text
    assert text.count("Exchange hashpartitioning") <= text.count("Exchange")


def test_ranks_of_a_whole_table_have_no_window(stored):
    from callscope.functions.percentile import P50_95, nearest_rank

    for df in (nearest_rank(stored, [], "latency_ms", P50_95), metrics.overview_of(stored)):
        assert "Window" not in plan(df)


def test_library_never_collects():
    """No driver-side gathering, cross join or local checkpoint in the package.
    ``first`` appears where one row is asked for: the newest timestamp of a
    report, the id mark of a batch, and the index of a keyed table. (The subpackage ``llm`` has its own test.)"""
    banned = {"collect", "toPandas", "toLocalIterator", "crossJoin", "localCheckpoint", "take", "head"}
    firsts, broadcasts = [], []
    for path in PACKAGE.rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
                assert node.func.attr not in banned, f"{path.name}: {node.func.attr}"
                if node.func.attr == "first":
                    firsts.append(path.name)
                if node.func.attr == "broadcast":
                    broadcasts.append(path.name)
    assert sorted(firsts) == ["ingest.py"] * 3 + ["keyed.py"] * 2 + ["testdata.py"]
    assert broadcasts == ["ordered.py"]  # one row per chunk; everything else is left to Spark's size check


def test_lookups_skip_row_groups(spark, tmp_path):
    """The scan itself yields no row for a session or a call that lies inside the file's range but not in it."""
    from pyspark.sql import functions as F

    calls = spark.range(60_000).select(
        (F.col("id") * 2).alias("id"), F.format_string("s%08d", F.xxhash64("id") % 10**8).alias("session_id"), F.lit("a").alias("server_name"),
        F.lit("t").alias("tool_name"), F.lit("success").alias("status"), F.lit(1).alias("latency_ms"), F.lit("2026-01-01").cast("timestamp").alias("timestamp"))
    path = str(tmp_path / "calls")
    tables.write_tool_calls(calls.repartition(1), path)

    def scanned(condition, path=path):
        found = tables.read_tool_calls(spark, path).where(condition)
        rows = found.select("id", "session_id").collect()
        leaf = found.select("id")._jdf.queryExecution().executedPlan()
        leaf.execute().count()
        while leaf.children().size():
            leaf = leaf.children().head()
        return len(rows), leaf.metrics().apply("numOutputRows").value()

    known = calls.where("id = 5000").first().session_id
    assert scanned("id = 5000")[0] == 1 and scanned(f"session_id = '{known}'")[0] >= 1
    absent = ("id = 5001", "session_id = 's00000000x'")
    assert [scanned(a) for a in absent] == [(0, 0), (0, 0)]
    spark.read.parquet(path).write.parquet(f"{path}-plain")
    assert all(scanned(a, f"{path}-plain")[1] > 0 for a in absent)  # without the filters
