"""Streams whose micro-batches are batch jobs, with a thin table carried between them.

The stateful streams keep one key's rows of a micro-batch in one Python worker.
Here a micro-batch goes through the batch operators instead, which spread a busy
connection over many tasks, and what they need from earlier batches is a table
with one row per connection, node or open request. What has a key for good lies
in a keyed table, of which a batch reads and writes the buckets of its own keys;
open requests are written per batch, below the batch's number, and those of the
batch before the last are deleted. A batch that is retried reads and writes the
same again.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callscope.config import SESSION_GAP, AlertSettings
from callscope.functions.measures import epoch_ms
from callscope.operators.alerts import (
    COOLDOWN_KEY, FIRED_STATE, NODE, NODE_STATE, alert_candidates, fire_alerts, rolling_tool_state_from,
)
from callscope.operators.sessions import sessionize_from
from callscope.schema import ALERT_EVENTS
from callscope.session import cut_lineage
from callscope.sources.capture import pair_rpc_log, rpc_messages
from callscope.sources.tables import BATCH, write_alerts
from callscope.streaming.keyed import KeyedTable, delete, latest

_SESSION_STATE = "conn string, at bigint, kind int, n bigint"
_LOG = ("conn", "direction", "seq", "ts", "line")


def _before(spark: SparkSession, folder: str, batch_id: int, schema) -> DataFrame:
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{BATCH}={batch_id - 1}")


def _started(stream: DataFrame, store, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def sessionize_batch(calls: DataFrame, batch_id: int, path: str, carry: str, connection: str = "server_name",
                     gap: str = SESSION_GAP, request_activity: bool = True) -> None:
    """Store ``(id, session_id)`` of one micro-batch, and each connection's last activity and session number."""
    calls.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        known = KeyedTable(carry, ("conn",), _SESSION_STATE, latest("conn"))
        before = known.read(calls.sparkSession, batch_id, of=calls.select(F.col(connection).alias("conn")))
        found, state = sessionize_from(calls, before, connection, gap, request_activity)
        found.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")
        known.update(batch_id, state)
    finally:
        calls.unpersist()


def run_sessionize_stream(calls: DataFrame, path: str, carry: str, checkpoint: str, connection: str = "server_name",
                          gap: str = SESSION_GAP, request_activity: bool = True, available_now: bool = False) -> StreamingQuery:
    """``(id, session_id)`` of arriving calls by the rules of ``sessionize``.

    Equal to the batch job when activity arrives in time order; what comes
    late belongs to the session that is current when it arrives.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        sessionize_batch(batch, batch_id, path, carry, connection, gap, request_activity)

    return _started(calls, store, checkpoint, available_now)


def pair_batch(log: DataFrame, batch_id: int, path: str, carry: str, limit: str = "1 hour") -> None:
    """Store one micro-batch's pairs, and the requests that are still open.

    An open request is its log line, so the next batch just reads it before its
    own lines. A request is given up once half of its own connection's lines of
    a batch are more than ``limit`` later. So a line with a wrong clock gives up no
    request of others, nor of its own connection, and no connection waits for another.
    """
    spark = log.sparkSession
    lines = log.select(*_LOG).withColumn("ts", F.col("ts").cast("timestamp"))
    arrived = lines.groupBy("conn").agg(F.approx_percentile(F.unix_micros("ts"), 0.5, 1000).alias("_middle"))
    lines = cut_lineage(lines.unionByName(_before(spark, carry, batch_id, lines.schema)))
    pair_rpc_log(lines).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")
    last = rpc_messages(lines).groupBy("conn", "rpc_id").agg(
        F.max_by(F.struct(*_LOG, "is_request"), F.struct("ts", "direction", "seq")).alias("m")).select("m.*")
    given_up = F.timestamp_micros("_middle") - F.expr(f"interval {limit}")
    still_open = last.where("is_request").join(arrived, "conn", "left").where(F.col("_middle").isNull() | (F.col("ts") >= given_up))
    still_open.select(*_LOG).write.mode("overwrite").parquet(f"{carry}/{BATCH}={batch_id}")
    delete(spark, f"{carry}/{BATCH}={batch_id - 2}")


def run_pairing_stream(log: DataFrame, path: str, carry: str, checkpoint: str, limit: str = "1 hour",
                       available_now: bool = False) -> StreamingQuery:
    """Requests with their responses as lines arrive (see ``pair_rpc_log``)."""
    def store(batch: DataFrame, batch_id: int) -> None:
        pair_batch(batch, batch_id, path, carry, limit)

    return _started(log, store, checkpoint, available_now)


def alert_batch(calls: DataFrame, batch_id: int, path: str, carry: str, settings: AlertSettings = AlertSettings()) -> None:
    """Store one micro-batch's alerts where ``read_alerts`` looks, and what later calls need: each node's buffer (200
    latencies, counts and the lowest point of its error walk) and when each (tool, metric) fired last."""
    spark = calls.sparkSession
    nodes = KeyedTable(f"{carry}/nodes", NODE, NODE_STATE, latest(*NODE))
    last = KeyedTable(f"{carry}/fired", COOLDOWN_KEY, FIRED_STATE, latest(*COOLDOWN_KEY))
    thin = calls.select("id", *NODE, F.col("timestamp").cast("timestamp").alias("timestamp"), "latency_ms", "status")
    thin = thin.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows, state = rolling_tool_state_from(thin, nodes.read(spark, batch_id, of=thin))
        candidates = cut_lineage(alert_candidates(rows, settings))
        fired = fire_alerts(candidates, settings.cooldown_ms, last.read(spark, batch_id, of=candidates))
        folder = f"{path}/{BATCH}={batch_id}"
        write_alerts(fired, folder, mode="overwrite")
        nodes.update(batch_id, state)
        stored = spark.read.schema(ALERT_EVENTS).parquet(folder)
        last.update(batch_id, stored.groupBy(*COOLDOWN_KEY).agg(F.max(epoch_ms("fired_at")).alias("t")))
    finally:
        thin.unpersist()


def run_carried_alert_stream(calls: DataFrame, path: str, carry: str, checkpoint: str, settings: AlertSettings = AlertSettings(),
                             available_now: bool = False) -> StreamingQuery:
    """Alerts of arriving calls by the rules of ``alerts``, also where one node has most of them.

    Equal to the batch job when calls arrive in time order; a call that comes late counts when it comes.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        alert_batch(batch, batch_id, path, carry, settings)

    return _started(calls, store, checkpoint, available_now)
