"""Streams with ordered state: alerts, sessions, request/response pairing.

State lives in RocksDB under the stream's checkpoint, so it survives restarts
and lost executors. Rows of a micro-batch are taken in event-time order.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from callscope.config import ALERT_BUFFER_DROP, ALERT_BUFFER_MAX, SESSION_GAP, AlertSettings
from callscope.functions.measures import elapsed_ms, epoch_ms
from callscope.operators.alerts import NODE, alert_candidates, alert_rows
from callscope.operators.sessions import END, RESPONSE, activity_points, milliseconds
from callscope.session import use_rocksdb
from callscope.sources.capture import request_fields, response_fields, rpc_messages
from callscope.streaming.series import LATE


class _RollingState(StatefulProcessor):
    """Buffer of one (server, tool) node; one output row per call."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("buffer", "latencies array<bigint>, errors bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(rows).sort_values(["timestamp", "id"], kind="stable")
        latencies, errors = ([], 0)
        if self._state.exists():
            stored = self._state.get()
            latencies, errors = list(stored[0]), stored[1]
        ordered = sorted(latencies)
        counts, p95s, failures = [], [], []
        for latency, failed in zip(calls["latency_ms"], calls["is_error"]):
            latencies.append(int(latency))
            insort(ordered, int(latency))
            errors += int(failed)
            if len(latencies) > ALERT_BUFFER_MAX:
                latencies = latencies[ALERT_BUFFER_DROP:]
                ordered = sorted(latencies)
                errors = max(0, errors - ALERT_BUFFER_DROP)
            n = len(ordered)
            counts.append(n)
            p95s.append(ordered[min(int(n * 0.95), n - 1)])
            failures.append(errors)
        self._state.update((latencies, errors))
        yield pd.DataFrame({
            "id": calls["id"].to_numpy(), "server_name": key[0], "tool_name": key[1],
            "timestamp": calls["timestamp"].to_numpy(), "buffer_calls": counts, "p95_latency_ms": p95s,
            "error_count": failures, "error_rate_pct": [e / n * 100 for e, n in zip(failures, counts)],
        })

    def close(self) -> None:
        pass


class _Cooldown(StatefulProcessor):
    """Lets a candidate of one (tool, metric) through after the cooldown."""

    def __init__(self, cooldown_ms: int):
        self._cooldown_ms = cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last_fired", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        candidates = pd.concat(rows).sort_values(["timestamp", "id"], kind="stable")
        last = self._last.get()[0] if self._last.exists() else None
        fired = []
        for position, at in enumerate(candidates["at_ms"]):
            if last is None or at - last >= self._cooldown_ms:
                last = int(at)
                fired.append(position)
        if fired:
            self._last.update((last,))
        yield candidates.iloc[fired].drop(columns="at_ms")

    def close(self) -> None:
        pass


_STATE = ("id bigint, server_name string, tool_name string, timestamp timestamp, buffer_calls bigint,"
          " p95_latency_ms bigint, error_count bigint, error_rate_pct double")
_CANDIDATE = ("id bigint, server_name string, tool_name string, timestamp timestamp, metric string,"
              " value double, threshold double")


def stream_alerts(calls: DataFrame, settings: AlertSettings = AlertSettings()) -> DataFrame:
    """Alert rows as calls arrive.

    Two chained stateful steps: the buffer per (server, tool) and the cooldown
    per (tool, metric), so the second one only sees candidates. Equal to the
    batch job when calls arrive in event-time order; a call that comes late is
    taken when it arrives.
    """
    use_rocksdb(calls.sparkSession)
    thin = calls.select("id", *NODE, F.col("timestamp").cast("timestamp").alias("timestamp"), "latency_ms",
                        (F.col("status") == "error").alias("is_error"))
    state = thin.groupBy(*NODE).transformWithStateInPandas(
        statefulProcessor=_RollingState(), outputStructType=_STATE, outputMode="Append", timeMode="None")
    candidates = alert_candidates(state, settings).withColumn("at_ms", epoch_ms("timestamp"))
    fired = candidates.groupBy("tool_name", "metric").transformWithStateInPandas(
        statefulProcessor=_Cooldown(settings.cooldown_ms), outputStructType=_CANDIDATE, outputMode="Append", timeMode="None")
    return alert_rows(fired)


#: A connection's points of a micro-batch are ordered by slots of this many milliseconds, and go on in parts of so many points.
SLOT_MS, PART_POINTS = 6 * 3_600_000, 128

_SLOT = "conn string, slot bigint"
_PART = "ids array<bigint>, ats array<bigint>, ends array<boolean>, numbers array<bigint>"
_SLOT_PART = (f"{_SLOT}, is_part boolean, lane bigint, {_PART}, first_at bigint, first_opens boolean, first_ends boolean, last_at bigint,"
              " last_ends boolean, opened bigint")
_BASED_PART = f"{_SLOT}, is_part boolean, {_PART}, first_ends boolean, number bigint, idle boolean"


class _Slots(StatefulProcessor):
    """Points of one slot of a connection in order, numbered from its first session: parts of what is asked for, and one row on the slot."""

    def __init__(self, gap_ms: int):
        self._gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        points = pd.concat(rows).sort_values(["at", "kind", "no_id", "id", "opens"], kind="stable")
        at, ends, opens = points["at"].astype("int64").to_numpy(), (points["kind"] == END).to_numpy(), points["opens"].to_numpy(dtype=bool)
        opened = np.zeros(len(at), dtype="int64")
        opened[1:] = ~ends[1:] & (ends[:-1] | opens[1:] | (np.diff(at) > self._gap_ms))
        # An end after an end closes nothing. What the first of a slot does is up to the slots before.
        asked = (points["kind"] == RESPONSE).to_numpy() | ends & ~np.append(False, ends[:-1])
        ids = points["id"].astype(object).where(~points["no_id"].to_numpy(dtype=bool), None).to_numpy()[asked]
        numbers, ats, shown = opened.cumsum()[asked], at[asked], ends[asked]
        head = {"conn": key[0], "slot": key[1]}
        found = [{**head, "is_part": False, "lane": 0, "ids": [], "ats": [], "ends": [], "numbers": [], "first_at": at[0], "first_opens": opens[0],
                  "first_ends": ends[0], "last_at": at[-1], "last_ends": ends[-1], "opened": opened.sum()}]
        for start in range(0, len(ats), PART_POINTS):
            part = slice(start, start + PART_POINTS)
            found.append({**head, "is_part": True, "lane": key[1], "ids": list(ids[part]), "ats": ats[part], "ends": shown[part],
                          "numbers": numbers[part], "first_at": 0, "first_opens": False, "first_ends": ends[0] and not start, "last_at": 0,
                          "last_ends": False, "opened": 0})
        yield pd.DataFrame(found)

    def close(self) -> None:
        pass


class _ConnectionSessions(StatefulProcessor):
    """Session number and last activity of one connection, from slot to slot. Parts pass in lanes of their own."""

    def __init__(self, gap_ms: int):
        self._gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._current = handle.getValueState("current", "number bigint, last_at bigint, last_ends boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = ["conn", "slot", "is_part", "ids", "ats", "ends", "numbers", "first_ends", "number", "idle"]
        if key[1]:
            for parts in rows:
                yield parts.assign(number=0, idle=False)[columns]
            return
        number, last_at, last_ends = self._current.get() if self._current.exists() else (0, None, None)
        slots = pd.concat(rows).sort_values("slot", kind="stable")
        found = []
        for slot in slots.itertuples(index=False):
            idle = last_at is None or last_ends
            number += not slot.first_ends and (idle or slot.first_opens or slot.first_at - last_at > self._gap_ms)
            found.append((int(number), bool(idle)))
            number, last_at, last_ends = number + slot.opened, slot.last_at, slot.last_ends
        self._current.update((int(number), int(last_at), bool(last_ends)))
        numbers, idles = zip(*found)
        yield slots.assign(number=list(numbers), idle=list(idles))[columns]

    def close(self) -> None:
        pass


class _SlotSessions(StatefulProcessor):
    """Sessions of one slot's points, from the number its connection had before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slot = pd.concat(rows)
        is_part = slot["is_part"].to_numpy(dtype=bool)
        number, idle = slot.loc[~is_part, ["number", "idle"]].iloc[0]
        parts = slot[is_part].sort_values("first_ends", ascending=False, kind="stable")
        if parts.empty:
            return
        first = 1 if idle and parts["first_ends"].iloc[0] else 0  # an end while idle closes nothing
        ids, ats, ends, numbers = (np.concatenate(parts[c].to_list())[first:] for c in ("ids", "ats", "ends", "numbers"))
        yield pd.DataFrame({
            "is_end": ends.astype(bool), "id": pd.array([None if pd.isna(i) else int(i) for i in ids], dtype="Int64"),
            "session_id": pd.Series([f"{key[0]}#{n}" for n in (numbers + number).tolist()], dtype=object), "at": ats})

    def close(self) -> None:
        pass


def _numbered(points: DataFrame, gap: str) -> DataFrame:
    """``(is_end, id, session_id, at)`` of each micro-batch's points, taken in order after those of the batches before.

    No task takes a whole connection: slots are ordered by themselves, one row of each goes through the connection, and
    the slots' points meet the number that comes back. All of it happens within the micro-batch.
    """
    def step(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
        return df.groupBy(*keys).transformWithStateInPandas(
            statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")

    use_rocksdb(points.sparkSession)
    gap_ms = milliseconds(gap)
    slotted = points.select(
        "conn", F.floor(F.col("at") / SLOT_MS).alias("slot"), F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), F.col("id").isNull().alias("no_id"),
        "at", "kind", F.coalesce("opens", F.lit(False)).alias("opens"))
    parts = step(slotted, ["conn", "slot"], _Slots(gap_ms), _SLOT_PART)
    based = step(parts, ["conn", "is_part", "lane"], _ConnectionSessions(gap_ms), _BASED_PART)
    return step(based, ["conn", "slot"], _SlotSessions(), "is_end boolean, id bigint, session_id string, at bigint")


def stream_sessionize(
    calls: DataFrame, connection: str = "server_name", gap: str = SESSION_GAP, request_activity: bool = True,
) -> DataFrame:
    """``(id, session_id)`` as calls arrive, by the rules of ``sessionize``,
    ``initialize`` splits included. Equal to the batch job when activity
    arrives in time order."""
    return _numbered(activity_points(calls, connection, request_activity), gap).select("id", "session_id")


def _ordered_sessions(calls: DataFrame, ends: DataFrame | None, connection: str, gap: str, request_activity: bool, late: str) -> DataFrame:
    points = activity_points(calls, connection, request_activity)
    if ends is not None:
        points = points.unionByName(ends.select(
            "conn", F.lit(-1).cast("long").alias("id"), epoch_ms("ended_at").alias("at"), F.lit(END).alias("kind"), F.lit(False).alias("opens")))
    use_rocksdb(calls.sparkSession)
    # A window of one millisecond is let out when the watermark has passed it: points wait in an aggregate keyed by themselves.
    timed = points.withColumn("time", F.timestamp_millis("at")).withWatermark("time", late)
    passed = timed.groupBy("conn", F.window("time", "1 millisecond"), "kind", "id", "opens").agg(F.count(F.lit(1)).alias("times"))
    each = F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))
    return _numbered(passed.select("conn", "id", epoch_ms("window.start").alias("at"), "kind", "opens", each.alias("each")).drop("each"), gap)


def stream_sessionize_ordered(
    calls: DataFrame, ends: DataFrame | None = None, connection: str = "server_name", gap: str = SESSION_GAP, request_activity: bool = True,
    late: str = LATE,
) -> DataFrame:
    """``(id, session_id)`` by the rules of ``sessionize`` with its ``ends``, in event-time order.

    Unlike ``stream_sessionize``, activity may arrive in any order: a point waits in the state until the watermark
    passes it, and what is due is taken in order. Equal to the batch job
    on all that is no later than ``late``; a call comes out that much after its response.
    """
    found = _ordered_sessions(calls, ends, connection, gap, request_activity, late)
    return found.where("not is_end").select("id", "session_id")


def stream_session_ends(
    calls: DataFrame, ends: DataFrame, connection: str = "server_name", gap: str = SESSION_GAP, request_activity: bool = True, late: str = LATE,
) -> DataFrame:
    """Which session each closing ``(conn, ended_at)`` ends, as the watermark passes it: ``(session_id, ended_at)``,
    equal to the batch ``session_ends``. ``ingest.keep_session_ends`` stores them beside the sessions."""
    found = _ordered_sessions(calls, ends, connection, gap, request_activity, late)
    return found.where("is_end").select("session_id", F.timestamp_millis("at").alias("ended_at"))


class _PendingRequest(StatefulProcessor):
    """The open request of one (connection, id)."""

    def __init__(self, ttl_ms: int | None):
        self._ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._open = handle.getValueState(
            "open", "seq bigint, ts timestamp, method string, params string", self._ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lines = pd.concat(rows).sort_values(["ts", "direction", "seq"], kind="stable")
        open_request = self._open.get() if self._open.exists() else None
        pairs = []
        for line in lines.itertuples(index=False):
            if line.is_request:
                open_request = (line.seq, line.ts.to_pydatetime(), line.method, line.params)
            elif open_request is not None:
                pairs.append((*key, *open_request, line.seq, line.ts, line.result, line.error))
                open_request = None
        if open_request is not None:
            self._open.update(open_request)
        else:
            self._open.clear()
        yield pd.DataFrame(pairs, columns=_PAIR_COLUMNS)

    def close(self) -> None:
        pass


_PAIR = ("conn string, rpc_id string, request_seq bigint, timestamp timestamp, method string, params string,"
         " response_seq bigint, response_ts timestamp, result string, error string")
_PAIR_COLUMNS = [field.split()[0] for field in _PAIR.split(", ")]


def stream_pair_rpc(log: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Requests with their responses as lines arrive (see ``pair_rpc_log``).

    The open request is kept per (connection, id), so ids may be reused at any
    time. ``ttl_ms`` forgets requests that stay unanswered that long (by the
    wall clock, so such a query keeps running and cannot use ``available_now``).
    """
    use_rocksdb(log.sparkSession)
    message = F.col("_message")
    lines = rpc_messages(log).select(
        "conn", "rpc_id", "direction", "seq", F.col("ts").cast("timestamp").alias("ts"), "is_request",
        *request_fields(message), *response_fields(message))
    time_mode = "ProcessingTime" if ttl_ms else "None"
    pairs = lines.groupBy("conn", "rpc_id").transformWithStateInPandas(
        statefulProcessor=_PendingRequest(ttl_ms), outputStructType=_PAIR, outputMode="Append", timeMode=time_mode)
    return pairs.withColumn("latency_ms", elapsed_ms("timestamp", "response_ts"))
