"""Column expressions shared by the metric operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callscope.config import SERIES_BUCKET

def call_count() -> Column:
    return F.count(F.lit(1))


def is_error() -> Column:
    """1 for status ``error``. Timeouts do not count towards the error rate."""
    return (F.col("status") == "error").cast("long")


def error_rate(errors: str | Column, calls: str | Column) -> Column:
    """Errors in percent of calls."""
    errors = F.col(errors) if isinstance(errors, str) else errors
    calls = F.col(calls) if isinstance(calls, str) else calls
    return errors / calls * 100


def tokens() -> Column:
    return F.col("input_tokens") + F.col("output_tokens")


def or_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def bucket(timestamp: str = "timestamp", width: str = SERIES_BUCKET) -> Column:
    """Start of the time bucket a call falls into (UTC aligned)."""
    return F.window(timestamp, width)["start"]


def epoch_ms(timestamp: str | Column) -> Column:
    column = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    return F.unix_millis(column.cast("timestamp"))


def elapsed_ms(start: str, end: str) -> Column:
    """Whole milliseconds between two times."""
    return epoch_ms(end) - epoch_ms(start)
