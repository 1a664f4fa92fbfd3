"""Sessions: derive, end, list, replay, and split connections by idle gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.config import SESSION_GAP
from callscope.functions.measures import call_count, epoch_ms
from callscope.functions.ordered import in_chunks, previous, running
from callscope.operators.filters import by_agent_type, by_server
from callscope.session import cut_lineage


def derive_sessions(events: DataFrame) -> DataFrame:
    """One session per session id: server and start time of its first-arrived
    event (smallest id). An empty or missing server name becomes ``unknown``."""
    first = events.groupBy("session_id").agg(
        F.min_by(F.struct("server_name", "timestamp"), "id").alias("first"),
    )
    server = F.when(F.coalesce(F.col("first.server_name"), F.lit("")) == "", "unknown").otherwise(F.col("first.server_name"))
    started = F.col("first.timestamp")
    return first.select(
        F.col("session_id").alias("id"), server.alias("server_name"), started.alias("started_at"),
        F.lit(None).cast(events.schema["timestamp"].dataType).alias("ended_at"),
        F.lit(None).cast("string").alias("label"),
    )


def merge_sessions(existing: DataFrame, events: DataFrame) -> DataFrame:
    """Existing sessions untouched, plus one for every id not seen before."""
    unseen = derive_sessions(events).join(existing.select("id"), "id", "left_anti")
    return existing.unionByName(unseen.select(*existing.columns))


def apply_session_ends(sessions: DataFrame, ends: DataFrame) -> DataFrame:
    """Set ``ended_at`` from end markers ``(session_id, ended_at)``. The latest
    marker wins; markers of unknown sessions are ignored."""
    last = ends.groupBy(F.col("session_id").alias("id")).agg(F.max("ended_at").alias("_ended"))
    joined = sessions.join(last, "id", "left")
    return joined.withColumn("ended_at", F.coalesce("_ended", "ended_at")).select(*sessions.columns)


def list_sessions(
    sessions: DataFrame, calls: DataFrame, limit: int = 20, offset: int = 0,
    server_name: str | None = None, agent_type: str | None = None,
) -> DataFrame:
    """Newest sessions with their number of calls (0 for an empty session).

    Without an agent type the page is cut first and only its calls are
    counted. With one, only sessions with such calls appear and only those
    calls count, so all of them are counted before the page is cut.
    """
    def counted(chosen_calls: DataFrame) -> DataFrame:
        counts = chosen_calls.groupBy("session_id").agg(call_count().alias("call_count"))
        return counts.withColumnRenamed("session_id", "id")

    def page_of(df: DataFrame) -> DataFrame:
        return df.orderBy(*newest).offset(offset).limit(limit)

    chosen = by_server(sessions, server_name)
    newest = (F.desc("started_at"), F.asc("id"))
    if agent_type:
        page = page_of(chosen.join(counted(by_agent_type(calls, agent_type)), "id"))
    else:
        page = page_of(chosen)
        shown = page.select(F.col("id").alias("session_id"))
        page = page.join(counted(calls.join(shown, "session_id", "left_semi")), "id", "left")
    return page.withColumn("call_count", F.coalesce("call_count", F.lit(0))).orderBy(*newest)


def replay(sessions: DataFrame, calls: DataFrame, session_id: str) -> DataFrame:
    """The calls of one session in order, each with the session's header.
    Nothing when the session is unknown."""
    header = sessions.where(F.col("id") == session_id).select(
        F.col("id").alias("session_id"), F.col("server_name").alias("session_server_name"),
        "started_at", "ended_at", "label",
    )
    return calls.where(F.col("session_id") == session_id).join(header, "session_id").orderBy("timestamp", "id")


def call_timeline(calls: DataFrame) -> DataFrame:
    """Bar widths per call: latency in percent of the session's longest call
    (at least 1 ms), linear and on a log scale (at least 3 %).

    The maximum is aggregated and joined back instead of taken over a window,
    so a very long session is not gathered in one task. Payloads stay behind.
    """
    bars = calls.select("id", "session_id", "tool_name", "status", "timestamp", "latency_ms")
    longest = calls.groupBy("session_id").agg(F.greatest(F.max("latency_ms"), F.lit(1)).alias("_longest"))
    joined = bars.join(longest, "session_id")
    log_share = F.log(F.col("latency_ms") + F.lit(1.0)) / F.log(F.col("_longest") + F.lit(1.0)) * 100
    return joined.withColumns({
        "latency_pct": F.col("latency_ms") / F.col("_longest") * 100,
        "log_pct": F.greatest(log_share, F.lit(3.0)),
    }).drop("_longest")


def sessionize(
    calls: DataFrame, connection: str = "server_name", gap: str = SESSION_GAP, request_activity: bool = True,
    touches: DataFrame | None = None, ends: DataFrame | None = None,
) -> DataFrame:
    """Split each connection's calls into sessions ``connection#n``.

    Activity points are the request time (``timestamp``) and the response time
    (plus ``latency_ms``); HTTP capture knows only the response point, hence
    ``request_activity=False``. A new session starts at the first point, at an
    ``initialize`` call, when a point comes strictly later than ``gap`` after
    the previous one, or after the connection was closed. A call belongs to
    the session current at its response. A non-null ``session_id`` column
    overrides the computed id. ``id`` must be unique within a connection.
    Calling this starts jobs, which write the thin points down.

    ``touches`` replaces the calls' own request points by all requests of the
    log, also unanswered ones: ``(conn, timestamp, opens)``. ``ends`` are the
    times connections were closed: ``(conn, ended_at)``.
    """
    points = _numbered_points(calls, connection, gap, request_activity, touches, ends)
    computed = points.where(F.col("kind") == RESPONSE).select(
        F.col("conn").alias(connection), "id", _session_id().alias("_session"))
    joined = calls.join(computed, [connection, "id"])
    if "session_id" in calls.columns:
        return joined.withColumn("session_id", F.coalesce("session_id", "_session")).drop("_session")
    return joined.withColumnRenamed("_session", "session_id")


def sessionize_from(
    calls: DataFrame, before: DataFrame, connection: str = "server_name", gap: str = SESSION_GAP, request_activity: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """``(id, session_id)`` of calls that go on from earlier ones, and the state for the next.

    ``before`` holds each connection's last activity and session number,
    ``(conn, at, kind, n)``. Activity before it counts as of that time.
    """
    points = cut_lineage(_numbered_points(calls, connection, gap, request_activity, None, None, before))
    found = points.where((F.col("kind") == RESPONSE) & F.col("carried").isNull())
    state = points.groupBy("conn").agg(F.max_by(F.struct("at", "kind", "n"), F.struct("at", "kind", "id")).alias("s"))
    return found.select("id", _session_id().alias("session_id")), state.select("conn", "s.*")


def session_ends(
    calls: DataFrame, ends: DataFrame, connection: str = "server_name", gap: str = SESSION_GAP,
    request_activity: bool = True, touches: DataFrame | None = None,
) -> DataFrame:
    """Which session each closing ends: ``(session_id, ended_at)``, the input
    of :func:`apply_session_ends`. Closing an idle connection ends nothing."""
    points = _numbered_points(calls, connection, gap, request_activity, touches, ends)
    closed = points.where((F.col("kind") == END) & (F.col("n") > 0) & (F.col("before.kind") != END))
    return closed.select(_session_id().alias("session_id"), F.timestamp_millis("at").alias("ended_at"))


FIRST, REQUEST, RESPONSE, END = -1, 0, 1, 2


def _session_id():
    return F.concat("conn", F.lit("#"), F.col("n").cast("string"))


def _numbered_points(calls, connection, gap, request_activity, touches, ends, before=None) -> DataFrame:
    """Activity points in order with the number of the session current there."""
    gap_ms = milliseconds(gap)
    keys, order = ["conn"], ["at", "kind", "id"]
    points = activity_points(calls, connection, request_activity, touches)
    if ends is not None:
        points = points.unionByName(ends.select(
            "conn", F.lit(None).cast("long").alias("id"), epoch_ms("ended_at").alias("at"),
            F.lit(END).alias("kind"), F.lit(False).alias("opens")))
    points = points.withColumn("carried", F.lit(None).cast("long"))
    if before is not None:
        last = before.select("conn", F.col("at").alias("_last"))
        points = points.join(last, "conn", "left").withColumn("at", F.greatest("at", "_last")).drop("_last")
        points = points.unionByName(before.select(
            "conn", F.lit(None).cast("long").alias("id"), "at", F.lit(FIRST).alias("kind"), F.lit(False).alias("opens"),
            F.col("n").alias("carried")))
    # Written down first: the payload joins behind the points would run again for sampling the sort ranges.
    chunked = in_chunks(cut_lineage(points), keys, order)
    seen = previous(chunked, keys, order, F.struct("at", "kind"), "before")
    fresh = F.col("before").isNull() | (F.col("before.kind") == END)
    opens = (F.col("kind") != END) & (fresh | F.col("opens") | (F.col("at") - F.col("before.at") > gap_ms))
    # What is carried over stands for all sessions before it.
    counted = seen.withColumn("opens", F.coalesce("carried", opens.cast("long")))
    return running(counted, keys, order, sums={"n": F.col("opens")})


def activity_points(
    calls: DataFrame, connection: str = "server_name", request_activity: bool = True, touches: DataFrame | None = None,
) -> DataFrame:
    """The times at which calls touch their connection: ``(conn, id, at, kind,
    opens)``, kind 0 for a request and 1 for a response. An ``initialize`` that
    was ``lost`` on the way (see ``calls_from_http``) opens nothing."""
    is_init = F.col("method") == "initialize"
    if "lost" in calls.columns:
        is_init = is_init & ~F.coalesce("lost", F.lit(False))
    own_requests = request_activity and touches is None
    opens_late = is_init if not request_activity and touches is None else F.lit(False)
    at = epoch_ms("timestamp")
    response = F.struct((at + F.col("latency_ms")).alias("at"), F.lit(RESPONSE).alias("kind"), opens_late.alias("opens"))
    request = F.struct(at.alias("at"), F.lit(REQUEST).alias("kind"), is_init.alias("opens"))
    points = F.array(request, response) if own_requests else F.array(response)
    exploded = calls.select(F.col(connection).alias("conn"), "id", F.explode(points).alias("p"))
    found = exploded.select("conn", "id", "p.at", "p.kind", "p.opens")
    if touches is None:
        return found
    return found.unionByName(touches.select(
        "conn", F.lit(None).cast("long").alias("id"), at.alias("at"), F.lit(REQUEST).alias("kind"), "opens"))


def milliseconds(interval: str) -> int:
    amount, unit = interval.split()
    scale = {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}
    return int(float(amount) * scale[unit.rstrip("s")])
