"""Ordered and limited listings. Ties are broken by id or by the group key, so
every listing is repeatable; ``orderBy().limit()`` keeps only n rows per task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.operators.filters import failed

# The columns of an error listing, and the names by which lists may be sorted.
ERROR_COLUMNS = (
    "id", "session_id", "server_name", "tool_name", "status", "error_class", "error_code", "error_msg", "timestamp",
)
TOOL_STAT_ORDER = {"latency_p95": "p95_latency_ms", "error_rate": "error_rate_pct", "call_count": "call_count"}
CALL_ORDER = {"timestamp": "timestamp", "toolName": "tool_name", "status": "status", "latencyMs": "latency_ms"}


def newest(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def recent_calls(df: DataFrame, n: int = 50) -> DataFrame:
    """The newest calls of the whole table; a report's time window does not apply."""
    return newest(df, n)


def recent_errors(df: DataFrame, n: int = 50) -> DataFrame:
    return newest(failed(df).select(*ERROR_COLUMNS), n)


def live_tail(df: DataFrame, n: int = 200) -> DataFrame:
    return newest(df, n)


def list_alerts(alerts: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return alerts.orderBy(F.desc("fired_at"), F.desc("id")).offset(offset).limit(limit)


def top_nodes(usage: DataFrame, by: str = "total_tokens", n: int = 12) -> DataFrame:
    """The first ``n`` rows of a per-node report by tokens or cost."""
    return usage.orderBy(F.desc(by), "server_name", "tool_name").limit(n)


def top_sessions(costs: DataFrame, n: int = 15) -> DataFrame:
    return costs.orderBy(F.desc("cost_usd"), "session_id").limit(n)


def sort_tool_stats(stats: DataFrame, by: str = "latency_p95") -> DataFrame:
    """Descending by P95, error rate or call count; unknown names mean P95."""
    column = TOOL_STAT_ORDER.get(by, TOOL_STAT_ORDER["latency_p95"])
    return stats.orderBy(F.desc(column), "tool_name", "server_name")


def sort_calls(calls: DataFrame, by: str = "timestamp", direction: str | None = None) -> DataFrame:
    """Order the calls of a session. Latency starts descending, the rest ascending."""
    direction = direction or ("desc" if by == "latencyMs" else "asc")
    column = F.col(CALL_ORDER[by])
    return calls.orderBy(column.desc() if direction == "desc" else column.asc(), "id")
