"""Exact nearest-rank percentiles without collecting a group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

P50_95 = {"p50_latency_ms": 0.50, "p95_latency_ms": 0.95}
P50_95_99 = {**P50_95, "p99_latency_ms": 0.99}
#: Values looked at together where the ranks of a whole table are asked for.
RANGE = 4096


def rank_index(n: Column, p: float) -> Column:
    """0-based position of percentile ``p`` among ``n`` sorted values."""
    return F.least(F.floor(n * F.lit(float(p))), n - 1)


def nearest_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Mapping[str, float],
    sums: Mapping[str, Column] | None = None,
    latest: Mapping[str, str] | None = None,
    count: Column | None = None,
) -> DataFrame:
    """Percentiles of ``value`` per ``keys``: the value at sorted position
    ``min(floor(n * p), n - 1)``, plus the row count as ``call_count``.

    The rows are first counted per (keys, value); that partial aggregate runs
    map-side, so only the histogram is shuffled and a hot key costs no more
    than its distinct values (whole milliseconds here). A running count over
    the histogram then finds each rank. ``sums`` (additive) and ``latest``
    (maximum) measures ride along in the same pass. ``count`` adds up the rows
    that each row stands for, where ``df`` is a histogram itself.
    """
    sums, latest = dict(sums or {}), dict(latest or {})
    histogram = df.groupBy(*keys, F.col(value).alias("_value")).agg(
        (F.count(F.lit(1)) if count is None else count).alias("_n"),
        *[F.sum(expr).alias(name) for name, expr in sums.items()],
        *[F.max(column).alias(name) for name, column in latest.items()],
    )
    if not keys:
        return _of_all_rows(histogram, ranks, sums, latest)
    group = Window.partitionBy(*keys)
    up_to_here = group.orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = histogram.withColumns({
        "_running": F.sum("_n").over(up_to_here),
        "_total": F.sum("_n").over(group),
    })
    picks = [
        F.min(F.when(F.col("_running") > rank_index(F.col("_total"), p), F.col("_value"))).alias(name)
        for name, p in ranks.items()
    ]
    return ranked.groupBy(*keys).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("call_count"),
        *picks,
        *[F.sum(name).alias(name) for name in sums],
        *[F.max(name).alias(name) for name in latest],
    )


def _of_all_rows(histogram: DataFrame, ranks: Mapping[str, float], sums: Mapping[str, Column], latest: Mapping[str, str]) -> DataFrame:
    """The ranks of the whole table, without gathering its histogram in one task.

    Values are cut into ranges of ``RANGE``, which are dealt to tasks. One row holds how many calls each range has; it
    tells which range has a rank, and how many calls come before. Only the histograms of those ranges are looked into.
    """
    ranges = histogram.groupBy(F.floor(F.col("_value") / RANGE).alias("_range")).agg(
        F.sum("_n").alias("_n"), F.array_sort(F.collect_list(F.struct("_value", "_n"))).alias("_inside"),
        *[F.sum(name).alias(name) for name in sums], *[F.max(name).alias(name) for name in latest])
    totals = ranges.agg(
        F.array_sort(F.collect_list(F.struct("_range", "_n"))).alias("_ranges"), F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"),
        *[F.sum(name).alias(name) for name in sums], *[F.max(name).alias(name) for name in latest])
    wanted = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), _passing(F.col("_ranges"), rank_index(F.col("_total"), p), "_range").alias("at"))
        for name, p in ranks.items()]))
    carried = [*sums, *latest]
    places = totals.select(wanted.alias("_rank"), "_total", *carried).withColumn("_range", F.col("_rank.at.value"))
    found = places.join(ranges.select("_range", "_inside"), "_range", "left")
    value = _passing(F.col("_inside"), F.col("_rank.at.left"), "_value")["value"]
    return found.agg(
        F.max("_total").alias("call_count"), *[F.max(F.when(F.col("_rank.name") == name, value)).alias(name) for name in ranks],
        *[F.max(name).alias(name) for name in carried])


def _passing(counted: Column, index: Column, value: str) -> Column:
    """The first entry of sorted (``value``, ``_n``) whose running count passes ``index``, and what of ``index`` is left for it."""
    kind = "bigint"
    start = F.struct(F.lit(None).cast(kind).alias("value"), index.cast(kind).alias("left"))

    def step(state: Column, entry: Column) -> Column:
        done = state["value"].isNotNull()
        here = ~done & (entry["_n"] > state["left"])
        left = F.when(done | here, state["left"]).otherwise(state["left"] - entry["_n"])
        return F.struct(F.when(here, entry[value]).otherwise(state["value"]).cast(kind).alias("value"), left.cast(kind).alias("left"))

    return F.aggregate(counted, start, step)
