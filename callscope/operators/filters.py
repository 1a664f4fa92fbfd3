"""Predicates on the calls table. All of them reach the Parquet scan."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.config import DEFAULT_SINCE, SINCE_WINDOWS

DATE = "date"


def instant(df: DataFrame, at: datetime | str | Column, column: str = "timestamp") -> Column:
    """``at`` as a constant of the same type as the time column."""
    if isinstance(at, Column):
        return at
    text = at.isoformat(sep=" ") if isinstance(at, datetime) else at
    return F.lit(text).cast(df.schema[column].dataType)


def within(df: DataFrame, as_of: datetime | str | Column, width: str) -> DataFrame:
    """Calls strictly later than ``as_of`` minus ``width``.

    On the stored table whole ``date`` partitions are skipped as well; one day
    of slack covers readers in another time zone than the writer.
    """
    start = instant(df, as_of) - F.expr(f"interval {width}")
    later = df.where(F.col("timestamp") > start)
    return later.where(F.col(DATE) >= F.date_sub(F.to_date(start), 1)) if DATE in df.columns else later


def since(df: DataFrame, as_of: datetime | str | Column, window: str = DEFAULT_SINCE) -> DataFrame:
    """Calls of the last ``1h``, ``6h``, ``24h`` or ``7d``; other names mean 24h.

    The time is an argument instead of the wall clock, so a report can be
    repeated.
    """
    return within(df, as_of, SINCE_WINDOWS.get(window, SINCE_WINDOWS[DEFAULT_SINCE]))


def by_tool(df: DataFrame, tool_name: str | None = None) -> DataFrame:
    return df.where(F.col("tool_name") == tool_name) if tool_name else df


def by_server(df: DataFrame, server_name: str | None = None) -> DataFrame:
    return df.where(F.col("server_name") == server_name) if server_name else df


def by_agent_type(df: DataFrame, agent_type: str | None = None) -> DataFrame:
    return df.where(F.col("agent_type") == agent_type) if agent_type else df


def failed(df: DataFrame) -> DataFrame:
    """Everything that did not succeed, timeouts included."""
    return df.where(F.col("status") != "success")


def session_calls(df: DataFrame, session_id: str) -> DataFrame:
    return df.where(F.col("session_id") == session_id)


def call_at(df: DataFrame, session_id: str, at: datetime | str | Column) -> DataFrame:
    """The first call of a session at exactly this time (deep link)."""
    return session_calls(df, session_id).where(F.col("timestamp") == instant(df, at)).orderBy("id").limit(1)
