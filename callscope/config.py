"""Job options. Plain values only; nothing here touches Spark."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Pricing:
    """Token estimate and price per million tokens.

    ``per_server`` maps a server name to its (input, output) rates. An override
    replaces both rates; the bytes-per-token divisor is never overridden.
    """

    chars_per_token: float = 4
    input_per_million: float = 3.0
    output_per_million: float = 15.0
    per_server: Mapping[str, tuple[float, float]] = field(default_factory=dict)


@dataclass(frozen=True)
class AlertSettings:
    latency_p95_ms: float = 2000
    error_rate_percent: float = 10
    cooldown_minutes: float = 5

    @property
    def cooldown_ms(self) -> int:
        return int(self.cooldown_minutes * 60_000)


# They decide results, so they are stated once, here.
RESPONSE_LIMIT_BYTES = 10_000
OBJECT_STRING_CHARS = 500
REDACTION_DEPTH = 5
SECRET_WORDS = (
    "token", "key", "secret", "password", "auth",
    "api_key", "apikey", "credential", "bearer", "authorization",
)
REDACTED = "[REDACTED]"
HALLUCINATION_CODES = (-32601, -32602)
HALLUCINATION_TEXT = "unknown tool|tool not found|no such tool|unknown method|method not found|unrecognized"
TIMEOUT_TEXT = r"timed?\s*out|timeout|deadline exceeded"
ERROR_CLASSES = ("hallucination", "tool_failure", "timeout")
SERIES_BUCKET = "15 minutes"
HEALTH_WINDOW = "5 minutes"
HEALTH_DOWN_ERROR_PCT = 20
HEALTH_DEGRADED_ERROR_PCT = 5
HEALTH_DEGRADED_P95_MS = 2000
SESSION_GAP = "5 minutes"
SINCE_WINDOWS = {"1h": "1 hour", "6h": "6 hours", "24h": "24 hours", "7d": "7 days"}
DEFAULT_SINCE = "24h"
ALERT_MIN_CALLS = 5
ALERT_BUFFER_MAX = 200
ALERT_BUFFER_DROP = 100
