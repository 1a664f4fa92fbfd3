"""Payload diffs between calls, as table jobs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.functions.linediff import EQUAL, line_diff, pretty_lines
from callscope.functions.measures import epoch_ms
from callscope.functions.ordered import in_chunks, previous
from callscope.functions.payload import compact

SECTIONS = ("arguments", "response")
_PART = ("_first", "_types", "_lines")
_TEXTS = pa.list_(pa.string())
#: Lines, and characters of them, that leave a worker at once.
BATCH_LINES, BATCH_CHARS = 4096, 1 << 22


def _diff_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of each pair ``(before, after)`` in parts ``(*keys, _first, _types, _lines)``; ``_first`` is the number of a part's first line.

    A worker holds one pair and one batch of lines, so its memory does not grow with the number of pairs.
    """
    for batch in batches:
        keys, before, after = batch.columns[:-2], batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        parts, waiting, chars = [], 0, 0

        def flush() -> pa.RecordBatch:
            at, first, types, lines = zip(*parts)
            chosen = pa.array(at, pa.int64())
            return pa.RecordBatch.from_arrays(
                [*(pc.array_take(key, chosen) for key in keys), pa.array(first, pa.int64()), pa.array(types, _TEXTS), pa.array(lines, _TEXTS)],
                names=[*batch.schema.names[:-2], *_PART])

        for row in range(batch.num_rows):
            a, b = before[row].as_py(), after[row].as_py()
            left = pretty_lines(a)
            pairs = [(EQUAL, line) for line in left] if a == b else line_diff(left, pretty_lines(b))
            start = 0
            for i, (_, line) in enumerate(pairs, 1):
                waiting, chars = waiting + 1, chars + len(line)
                full = waiting >= BATCH_LINES or chars >= BATCH_CHARS
                if full or i == len(pairs):
                    parts.append((row, start, *zip(*pairs[start:i])))
                    start = i
                if full:
                    yield flush()
                    parts, waiting, chars = [], 0, 0
        if parts:
            yield flush()


def shown_response(response: str | Column = "response") -> Column:
    """What a response shows in a diff: its data when present, else the whole
    envelope; NULL without a response."""
    response = F.col(response) if isinstance(response, str) else response
    data = response["data"]
    whole = F.to_json(
        F.struct(F.lit(None).cast("string").alias("data"), response["truncated"].alias("truncated"),
                 response["size_bytes"].alias("sizeBytes")),
        {"ignoreNullFields": "false"},
    )
    return F.when(response.isNotNull(), F.when(data.isNotNull() & (data != "null"), data).otherwise(whole))


def previous_same_tool(calls: DataFrame) -> DataFrame:
    """Each call with the closest strictly earlier call of the same tool in
    its session (at millisecond resolution; of several at that time, the first).

    Only times and ids are sorted, in chunks; a session of any length works.
    Adds ``previous_id`` and ``previous_timestamp``, NULL when there is none.
    """
    keys, moment = ["session_id", "tool_name"], F.struct("timestamp", "id")
    thin = calls.select(*keys, "id", "timestamp", epoch_ms("timestamp").alias("_ms"))
    moments = thin.groupBy(*keys, "_ms").agg(F.min(moment).alias("_first"))
    chunked = in_chunks(moments, keys, ["_ms"])
    lagged = previous(chunked, keys, ["_ms"], F.col("_first"), "_previous").select(
        *keys, "_ms", F.col("_previous.id").alias("previous_id"),
        F.col("_previous.timestamp").alias("previous_timestamp"),
    )
    return calls.withColumn("_ms", epoch_ms("timestamp")).join(lagged, [*keys, "_ms"]).drop("_ms")


def pairs_of(calls: DataFrame, chosen: DataFrame) -> DataFrame:
    """The payloads of chosen pairs of calls, ``(previous_id, id)``, ready for
    :func:`diff_calls` and :func:`diff_summary`; a row without a previous call
    is left out. Payloads are canonical JSON, so the order of keys is no
    difference for either."""
    def canonical(payload: Column) -> Column:
        return F.coalesce(compact(payload), payload)

    payloads = calls.select(
        "id", "tool_name", canonical(F.col("arguments")).alias("arguments"), canonical(shown_response()).alias("response"))

    def side(key: str, name: str) -> DataFrame:
        return payloads.select(
            F.col("id").alias(key), F.col("tool_name").alias(f"tool_{name}"),
            F.col("arguments").alias(f"arguments_{name}"), F.col("response").alias(f"response_{name}"))

    pairs = chosen.where(F.col("previous_id").isNotNull()).select("id", "previous_id")
    return pairs.join(side("id", "after"), "id").join(side("previous_id", "before"), "previous_id")


def pairs_with_previous(calls: DataFrame) -> DataFrame:
    """Every call paired with the previous call of its tool in the session."""
    return pairs_of(calls, previous_same_tool(calls.select("id", "session_id", "tool_name", "timestamp")))


def diff_calls(pairs: DataFrame, keys: Sequence[str] = ("previous_id", "id"), changed_only: bool = False) -> DataFrame:
    """Line diff of arguments and response per pair, one row per line:
    ``(*keys, section, line_no, type, line)``.

    ``pairs`` holds ``arguments_before/after`` and ``response_before/after``
    as JSON text. With ``changed_only`` identical sections are dropped before
    they reach Python.
    """
    sections = F.explode(F.array(*[
        F.struct(F.lit(s).alias("section"), F.col(f"{s}_before").alias("before"), F.col(f"{s}_after").alias("after"))
        for s in SECTIONS
    ]))
    rows = pairs.select(*keys, sections.alias("s")).select(*keys, "s.*")
    if changed_only:
        rows = rows.where(~F.col("before").eqNullSafe(F.col("after")))
    kept = rows.select(*keys, "section")
    first, types, lines = _PART
    texts = T.ArrayType(T.StringType())
    parts = rows.mapInArrow(_diff_lines, T.StructType([
        *kept.schema, T.StructField(first, T.LongType()), T.StructField(types, texts), T.StructField(lines, texts)]))
    exploded = parts.select(*kept.columns, first, F.posexplode(F.arrays_zip(types, lines)).alias("_at", "_line"))
    return exploded.select(*kept.columns, (F.col(first) + F.col("_at")).cast("int").alias("line_no"),
                           F.col(f"_line.{types}").alias("type"), F.col(f"_line.{lines}").alias("line"))


def diff_vs_previous(calls: DataFrame, changed_only: bool = False) -> DataFrame:
    """The diff of every call against the previous call of its tool."""
    return diff_calls(pairs_with_previous(calls), changed_only=changed_only)


def diff_summary(pairs: DataFrame, keys: Sequence[str] = ("previous_id", "id")) -> DataFrame:
    """Per pair: did arguments or response change, are the tools different.
    Canonical texts are compared, so no line diff is needed."""
    def changed(section: str) -> Column:
        return (~F.col(f"{section}_before").eqNullSafe(F.col(f"{section}_after"))).alias(f"{section}_changed")

    return pairs.select(
        *keys, *[changed(s) for s in SECTIONS],
        (F.col("tool_before") != F.col("tool_after")).alias("different_tools"))


def unified(diff: DataFrame) -> DataFrame:
    """Diff lines with their ``+``, ``-`` or blank gutter."""
    gutter = F.when(F.col("type") == "add", "+").when(F.col("type") == "del", "-").otherwise(" ")
    return diff.withColumn("gutter", gutter)


def split_left(diff: DataFrame) -> DataFrame:
    """The left column of a split view: everything but added lines."""
    return diff.where(F.col("type") != "add")


def split_right(diff: DataFrame) -> DataFrame:
    """The right column of a split view: everything but deleted lines."""
    return diff.where(F.col("type") != "del")
