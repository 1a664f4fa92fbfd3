"""Threshold alerts: rolling state per tool, candidates, cooldown, severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.config import ALERT_BUFFER_DROP, ALERT_BUFFER_MAX, ALERT_MIN_CALLS, AlertSettings
from callscope.functions.measures import epoch_ms
from callscope.functions.ordered import in_chunks, running
from callscope.functions.percentile import rank_index
from callscope.session import cut_lineage

NODE = ("server_name", "tool_name")
COOLDOWN_KEY = ("tool_name", "metric")
METRICS = ("latency_p95", "error_rate")
CELL_MS = 60_000


#: What a node's calls leave for later ones: how many there were, its failures, the lowest point of the floored walk
#: of its errors, and the latencies in its buffer, the last one last.
NODE_STATE = "server_name string, tool_name string, calls bigint, errors bigint, low bigint, held array<bigint>"
_STATE = ("id", *NODE, "timestamp", "buffer_calls", "p95_latency_ms", "error_count", "error_rate_pct")


def rolling_tool_state(calls: DataFrame) -> DataFrame:
    """State of each node's recent-calls buffer after every call.

    The buffer of a (server, tool) node takes calls in time order. When it
    would exceed 200, the oldest 100 are dropped, the call total becomes the
    buffer length and 100 is taken off the error count, floored at 0, whatever
    the dropped calls were. Only status ``error`` counts.

    Closed form, with n the call's number within its node and q = (n - 1) div
    100: the buffer holds the calls of block q up to n and all of block q - 1,
    so it is a window over groups of at most 200 rows. The floored error count
    is cum(n) - 100 k - min(0, low), with k trims so far and low the smallest
    cum - 100 j seen at any trim j. Both n and the minima are running values
    that are carried between chunks, so a busy node is not sorted in one task.
    """
    return _rolled(calls).select(*_STATE)


def rolling_tool_state_from(calls: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state after every call where calls go on from earlier ones, and what they leave for the next.

    ``before`` has at most one row a node (``NODE_STATE``). It enters the running values as a row before the node's own:
    sums go on from its sums, the minimum from its minimum. So a node's history composes of pieces of any length, and
    what is carried stays at 200 latencies. A late call counts when it comes. The second table has the nodes of ``calls``.
    """
    rows = cut_lineage(_rolled(calls, before).select(*_STATE, "latency_ms", "n", "_cum", "_low"))
    ends = rows.groupBy(*NODE).agg(F.max_by(F.struct("n", "_cum", "_low", "buffer_calls"), "n").alias("_end"))
    held = rows.select(*NODE, "n", "latency_ms").unionByName(_held_before(before)).join(ends, list(NODE))
    held = held.where(F.col("n") > F.col("_end.n") - F.col("_end.buffer_calls")).groupBy(*NODE, "_end").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "latency_ms"))), lambda x: x["latency_ms"]).alias("held"))
    state = held.select(*NODE, F.col("_end.n").alias("calls"), F.col("_end._cum").alias("errors"), F.col("_end._low").alias("low"), "held")
    return rows.select(*_STATE), state


def _held_before(before: DataFrame) -> DataFrame:
    """Carried latencies with their calls' numbers."""
    each = before.select(*NODE, "calls", F.size("held").alias("_size"), F.posexplode("held").alias("_pos", "latency_ms"))
    return each.select(*NODE, (F.col("calls") - F.col("_size") + F.col("_pos") + 1).alias("n"), "latency_ms")


def _rolled(calls: DataFrame, before: DataFrame | None = None) -> DataFrame:
    order = ["timestamp", "id"]
    thin = calls.select(
        "id", *NODE, "timestamp", F.col("latency_ms").cast("long").alias("latency_ms"), (F.col("status") == "error").cast("long").alias("_error"))
    one, error, carried_low = F.lit(1).cast("long"), F.col("_error"), F.lit(None).cast("long")
    own = F.lit(True)
    if before is not None:
        order = ["_own", *order]
        carried = before.select(*NODE, F.lit(False).alias("_own"), *[F.col(c).alias(f"_{c}") for c in ("calls", "errors", "low")])
        thin = thin.withColumn("_own", F.lit(True)).unionByName(carried, allowMissingColumns=True)
        one, error, carried_low, own = F.coalesce("_calls", one), F.coalesce("_errors", "_error"), F.col("_low_before"), F.col("_own")
        thin = thin.withColumnRenamed("_low", "_low_before")
    chunked = in_chunks(thin, NODE, order)
    numbered = running(chunked, NODE, order, sums={"n": one, "_cum": error})

    drop, full = ALERT_BUFFER_DROP, ALERT_BUFFER_MAX
    past = F.col("n") - (full + 1)
    trims = F.when(past >= 0, F.floor(past / drop) + 1).otherwise(F.lit(0)).cast("long")
    at_trim = own & (past >= 0) & (past % drop == 0)
    numbered = numbered.withColumn("_trims", trims)
    low = F.when(at_trim, F.col("_cum") - drop * F.col("_trims"))
    walked = running(numbered, NODE, order, minima={"_low": low if before is None else F.coalesce(low, carried_low)})
    if before is not None:
        walked = walked.where("_own").unionByName(_held_before(before), allowMissingColumns=True)

    block = F.floor((F.col("n") - 1) / drop)
    copies = walked.withColumn("_own_block", block).withColumn("_block", F.explode(F.array(F.col("_own_block"), F.col("_own_block") + 1)))
    buffer = Window.partitionBy(*NODE, "_block").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latencies = F.collect_list("latency_ms").over(buffer)
    held = copies.withColumn("_held", latencies).where(F.col("_block") == F.col("_own_block"))
    if before is not None:
        held = held.where("_own")

    length = F.size("_held")
    p95 = F.element_at(F.sort_array("_held"), (rank_index(length, 0.95) + 1).cast("int"))
    errors = F.col("_cum") - drop * F.col("_trims") - F.least(F.lit(0), F.coalesce("_low", F.lit(0)))
    return held.withColumns({
        "buffer_calls": length.cast("long"), "p95_latency_ms": p95, "error_count": errors, "error_rate_pct": errors / length * 100})


def alert_candidates(state: DataFrame, settings: AlertSettings = AlertSettings()) -> DataFrame:
    """Calls after which a threshold is exceeded (strictly), one row per metric.
    The error rate needs at least five calls in the buffer."""
    def candidate(metric: str, value: Column, threshold: float, exceeded: Column) -> Column:
        return F.when(exceeded, F.struct(
            F.lit(metric).alias("metric"), value.cast("double").alias("value"),
            F.lit(float(threshold)).alias("threshold"),
        ))

    slow = F.col("p95_latency_ms") > settings.latency_p95_ms
    failing = (F.col("buffer_calls") >= ALERT_MIN_CALLS) & (F.col("error_rate_pct") > settings.error_rate_percent)
    found = F.array_compact(F.array(
        candidate(METRICS[0], F.col("p95_latency_ms"), settings.latency_p95_ms, slow),
        candidate(METRICS[1], F.col("error_rate_pct"), settings.error_rate_percent, failing),
    ))
    # The outer form keeps Spark from repeating the percentile in a filter below.
    exploded = state.select("id", *NODE, "timestamp", F.explode_outer(found).alias("c"))
    return exploded.select("id", *NODE, "timestamp", "c.*").where(F.col("metric").isNotNull())


#: When a (tool, metric) fired last, in milliseconds.
FIRED_STATE = "tool_name string, metric string, t bigint"


def fire_alerts(candidates: DataFrame, cooldown_ms: int, before: DataFrame | None = None) -> DataFrame:
    """The candidates that fire: the first one per (tool, metric), then each
    first one at least ``cooldown_ms`` after the last that fired.

    The server is not part of the cooldown key (kept quirk), and event time
    stands in for the wall clock, at its millisecond resolution. Which
    candidates fire depends on all earlier ones, but not row by row: every
    candidate has one possible successor, and the alerts are the chain of
    successors from the first candidate. The chain is marked by doubling the
    jumps (1, 2, 4, ... successors), so a long history takes a logarithmic
    number of joins, and no (tool, metric) is gathered in one task.

    ``before`` (``FIRED_STATE``) has the last alerts of earlier candidates. Such an alert is where its chain starts.
    """
    if cooldown_ms <= 0:
        return alert_rows(candidates)
    timed = cut_lineage(candidates.withColumn("t", epoch_ms("timestamp")))
    points = timed.select(*COOLDOWN_KEY, "t").distinct()
    root = F.min("t")
    if before is not None:
        known = F.lit(True).alias("_fired")
        points = points.withColumn("_fired", F.lit(False)).unionByName(before.select(*COOLDOWN_KEY, "t", known)).groupBy(
            *COOLDOWN_KEY, "t").agg(F.max("_fired").alias("_fired"))
        root = F.coalesce(F.max(F.when(F.col("_fired"), F.col("t"))), root)
    roots = cut_lineage(points.groupBy(*COOLDOWN_KEY).agg(root.alias("t")))

    jumps = [cut_lineage(_successors(points, cooldown_ms))]
    while not jumps[-1].isEmpty():
        jumps.append(cut_lineage(_doubled(jumps[-1], roots)))

    fired = roots
    for jump in reversed(jumps[:-1]):
        both = F.array_compact(F.array("t", "next"))
        fired = fired.join(jump, [*COOLDOWN_KEY, "t"], "left").select(*COOLDOWN_KEY, F.explode(both).alias("t"))
    if before is not None:
        fired = fired.join(before, [*COOLDOWN_KEY, "t"], "left_anti")
    # Of several candidates within one millisecond the first one fires.
    first = F.min(F.struct("timestamp", "id", "server_name", "value", "threshold")).alias("c")
    chosen = timed.join(fired, [*COOLDOWN_KEY, "t"], "left_semi").groupBy(*COOLDOWN_KEY, "t").agg(first)
    return alert_rows(chosen.select(*COOLDOWN_KEY, "c.*"))


def _successors(points: DataFrame, cooldown_ms: int) -> DataFrame:
    """For every candidate time the first candidate at least a cooldown later.

    Times are cut into cells of a minute. The search for t + cooldown looks
    into the cell of that time, which holds two rows per millisecond at most.
    When the cell has no later candidate, the first one of the next cell that
    has any is taken from a table with one row per cell.
    """
    cell = F.floor(F.col("at") / CELL_MS)
    rows = points.select(
        *COOLDOWN_KEY, "t",
        F.explode(F.array(
            F.struct(F.col("t").alias("at"), F.lit(False).alias("probe")),
            F.struct((F.col("t") + cooldown_ms).alias("at"), F.lit(True).alias("probe")),
        )).alias("p"),
    ).select(*COOLDOWN_KEY, "t", "p.*").withColumn("cell", cell)
    candidate = F.when(~F.col("probe"), F.col("at"))

    from_here = Window.partitionBy(*COOLDOWN_KEY, "cell").orderBy(F.desc("at")).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    probes = rows.withColumn("here", F.min(candidate).over(from_here)).where("probe")

    later = Window.partitionBy(*COOLDOWN_KEY).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*COOLDOWN_KEY, "cell").agg(F.min(candidate).alias("first"))
    cells = cells.select(*COOLDOWN_KEY, "cell", F.min("first").over(later).alias("later"))

    found = probes.join(cells, [*COOLDOWN_KEY, "cell"]).withColumn("next", F.coalesce("here", "later"))
    return found.where(F.col("next").isNotNull()).select(*COOLDOWN_KEY, "t", "next")


def _doubled(jump: DataFrame, roots: DataFrame) -> DataFrame:
    """Twice the jump, from the roots and from where a jump lands; no other
    start can lie on a chain, so the table shrinks where chains merge."""
    starts = jump.select(*COOLDOWN_KEY, F.col("next").alias("t")).union(roots.select(*COOLDOWN_KEY, "t"))
    kept = jump.join(starts, [*COOLDOWN_KEY, "t"], "left_semi")
    onward = jump.select(*COOLDOWN_KEY, F.col("t").alias("next"), F.col("next").alias("_onward"))
    return kept.join(onward, [*COOLDOWN_KEY, "next"]).select(*COOLDOWN_KEY, "t", F.col("_onward").alias("next"))


def alert_rows(fired: DataFrame) -> DataFrame:
    """Alert table rows. A call can fire one alert per metric: the latency
    alert has the call's id, the error rate alert its bitwise complement, so
    ids are unique whatever the range of call ids."""
    number = F.when(F.col("metric") == METRICS[0], F.col("id")).otherwise(F.bitwise_not("id"))
    return fired.select(
        number.alias("id"), "tool_name", "server_name", "metric", "value", "threshold",
        F.col("timestamp").alias("fired_at"),
    )


def alerts(calls: DataFrame, settings: AlertSettings = AlertSettings()) -> DataFrame:
    """Alert rows over a calls table."""
    return fire_alerts(alert_candidates(rolling_tool_state(calls), settings), settings.cooldown_ms)


def alert_severity(alerts: DataFrame) -> DataFrame:
    """``CRITICAL`` above twice the threshold, else ``WARNING``."""
    severity = F.when(F.col("value") > 2 * F.col("threshold"), "CRITICAL").otherwise("WARNING")
    return alerts.withColumn("severity", severity)
