"""Running values and previous rows over groups of any size.

A plain window sorts a whole group in one task, which does not hold when one
key owns a third of the table. Here the rows are range-partitioned by (keys,
order) instead, so a large group spans many tasks, and what a task needs from
the tasks before it is carried over in a small table with one row per (group,
chunk).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.session import cut_lineage

CHUNK, EDGE = "_chunk", "_edge"


def in_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Sort-order chunks of balanced size, numbered in ``_chunk``.

    ``order`` must end in a unique column, so that even equal times split, and
    ``keys`` must not be NULL (the table's key columns never are).
    The chunk of a row depends on sampled range bounds; it is written down
    once, because a second evaluation could cut elsewhere.

    ``_edge`` marks the rows of a chunk's first and last group. Chunks follow
    the order of the keys, so no other group can go on in a neighbouring
    chunk, and only these rows need to be summed up for the carry; with many
    small groups that is next to nothing.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in (*keys, *order)])
    chunked = cut_lineage(ranged.withColumn(CHUNK, F.spark_partition_id()))
    key = F.struct(*keys)
    ends = chunked.groupBy(CHUNK).agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
    # One row per chunk, so never more rows than shuffle partitions.
    with_ends = chunked.join(F.broadcast(ends), CHUNK)
    return with_ends.withColumn(EDGE, (key == F.col("_low")) | (key == F.col("_high"))).drop("_low", "_high")


def _chunk_window(keys: Sequence[str], order: Sequence[str]):
    # EDGE is the same for all rows of a group in a chunk. As a key it lets a filter on it
    # sink below the window, so what is carried on is computed from border groups alone.
    return Window.partitionBy(*keys, CHUNK, EDGE).orderBy(*order)


def _earlier_chunks(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(CHUNK)


def _join_carry(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    # The rows already are partitioned by these columns for the window, so
    # only the small side moves, if it is not broadcast anyway.
    return df.join(carry.withColumn(EDGE, F.lit(True)), [*keys, CHUNK, EDGE], "left")


def previous(chunked: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``lag(value)`` in order within ``keys``; needs :func:`in_chunks`."""
    boxed = F.struct(value.alias("v"))
    last = chunked.where(EDGE).groupBy(*keys, CHUNK).agg(F.max_by(boxed, F.struct(*order)).alias("_last"))
    carry = last.withColumn("_before", F.lag("_last").over(_earlier_chunks(keys))).drop("_last")
    inside = chunked.withColumn("_lag", F.lag(boxed).over(_chunk_window(keys, order)))
    joined = _join_carry(inside, carry.where(F.col("_before").isNotNull()), keys)
    return joined.withColumn(name, F.coalesce("_lag", "_before")["v"]).drop("_lag", "_before")


def running(
    chunked: DataFrame, keys: Sequence[str], order: Sequence[str],
    sums: Mapping[str, Column] | None = None, minima: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Inclusive running sums and minima in order within ``keys``."""
    sums, minima = dict(sums or {}), dict(minima or {})
    window = _chunk_window(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = _earlier_chunks(keys).rowsBetween(Window.unboundedPreceding, -1)
    totals = chunked.where(EDGE).groupBy(*keys, CHUNK).agg(
        *[F.sum(expr).alias(name) for name, expr in sums.items()],
        *[F.min(expr).alias(name) for name, expr in minima.items()],
    )
    carried = {f"_before_{name}": F.sum(name).over(before) for name in sums}
    carried |= {f"_before_{name}": F.min(name).over(before) for name in minima}
    carry = totals.select(*keys, CHUNK, *[expr.alias(name) for name, expr in carried.items()])
    carry = carry.where(reduce(or_, [F.col(name).isNotNull() for name in carried]))
    inside = chunked.withColumns({
        **{name: F.sum(expr).over(window) for name, expr in sums.items()},
        **{name: F.min(expr).over(window) for name, expr in minima.items()},
    })
    joined = _join_carry(inside, carry, keys)
    return joined.withColumns({
        **{name: F.col(name) + F.coalesce(F.col(f"_before_{name}"), F.lit(0)) for name in sums},
        **{name: F.least(F.col(name), F.col(f"_before_{name}")) for name in minima},
    }).drop(*carried)
