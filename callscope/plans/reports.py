"""Whole reports: several sections answering one question.

A report is a set of aggregated DataFrames. :func:`write_report` writes each
section as JSON lines, whatever its size. :func:`document` nests each section
of few rows by its definition (totals, the top n) into one JSON array, for a screen.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.operators import metrics, topk
from callscope.operators.export import tools_with_series
from callscope.operators.filters import by_tool, since

Time = datetime | str | Column


@dataclass(frozen=True)
class Section:
    rows: DataFrame
    order: Sequence[Column | str] = ()
    #: The section's definition admits few rows only, whatever the data.
    few: bool = False


# The names of the sections below.


def overview_report(calls: DataFrame, as_of: Time) -> dict[str, Section]:
    """Headline numbers of 24 hours, and the newest calls of all time."""
    recent = topk.recent_calls(calls)
    return {
        "totals": Section(metrics.overview(calls, as_of), few=True),
        "recentCalls": Section(recent, (F.desc("timestamp"), F.desc("id")), few=True),
    }


def tool_report(calls: DataFrame, as_of: Time, window: str = "24h", tool_name: str | None = None) -> dict[str, Section]:
    chosen = by_tool(since(calls, as_of, window), tool_name)
    return {"tools": Section(tools_with_series(chosen), ("toolName", "serverName"))}


def token_report(calls: DataFrame, as_of: Time, window: str = "24h") -> dict[str, Section]:
    chosen = since(calls, as_of, window)
    return {
        "byNode": Section(metrics.token_usage_by_node(chosen), (F.desc("total_tokens"), *metrics.NODE)),
        "byAgentType": Section(metrics.token_usage_by_agent_type(chosen), (F.desc("total_tokens"), "agent_type")),
        "timeseries": Section(metrics.token_series(chosen), ("bucket",)),
    }


def cost_report(calls: DataFrame, sessions: DataFrame, as_of: Time, window: str = "24h") -> dict[str, Section]:
    chosen = since(calls, as_of, window)
    return {
        "byNode": Section(metrics.cost_by_node(chosen), (F.desc("cost_usd"), *metrics.NODE)),
        "bySession": Section(metrics.cost_by_session(chosen, sessions), (F.desc("cost_usd"), "session_id"), few=True),
        "timeseries": Section(metrics.cost_series(chosen), ("bucket",)),
        "totals": Section(metrics.cost_totals(chosen), few=True),
    }


def error_report(calls: DataFrame, as_of: Time, window: str = "24h") -> dict[str, Section]:
    chosen = since(calls, as_of, window)
    return {
        "byClass": Section(metrics.errors_by_class(chosen), ("error_class",)),
        "timeseries": Section(metrics.error_class_series(chosen), ("bucket",)),
        "recentErrors": Section(topk.recent_errors(chosen), (F.desc("timestamp"), F.desc("id")), few=True),
    }


def document(sections: dict[str, Section]) -> DataFrame:
    """One row per section: its name, number of rows and all its rows as a JSON
    array in report order. An empty section gives an empty array.

    An array is made in one task, so only sections of few rows are taken;
    :func:`write_report` writes the others.
    """
    if many := [name for name, section in sections.items() if not section.few]:
        raise ValueError(f"sections of any number of rows, for write_report: {', '.join(many)}")

    def lines(name: str, section: Section) -> DataFrame:
        order = Window.orderBy(*section.order) if section.order else Window.orderBy(F.lit(1))
        rows = section.rows.orderBy(*section.order) if section.order else section.rows
        return rows.select(
            F.lit(name).alias("section"), F.row_number().over(order).alias("position"),
            F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))

    everything = reduce(DataFrame.unionByName, [lines(n, s) for n, s in sections.items()])
    spark = everything.sparkSession
    names = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in sections])).alias("section"))
    nested = everything.groupBy("section").agg(F.sort_array(F.collect_list(F.struct("position", "row"))).alias("rows"))
    return names.join(nested, "section", "left").select(
        "section", F.coalesce(F.size("rows"), F.lit(0)).alias("row_count"),
        F.concat(F.lit("["), F.coalesce(F.array_join("rows.row", ","), F.lit("")), F.lit("]")).alias("json"))


def write_report(sections: dict[str, Section], path: str) -> None:
    """Each section as JSON lines in its own folder, in report order. Nothing
    is nested, so a section may have any number of rows."""
    for name, section in sections.items():
        rows = section.rows.orderBy(*section.order) if section.order else section.rows
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")
