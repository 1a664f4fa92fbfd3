"""Starting streams: where checkpoints and results go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from callscope.sources.tables import BATCH, write_alerts


def to_parquet(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append a stream to a Parquet table (exactly once, via the sink's log).

    ``available_now`` processes what is there and stops; otherwise the query
    runs on.
    """
    writer = stream.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_alert_stream(fired: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Alerts of a stream to the alert table, where ``read_alerts`` looks.

    A batch that is retried replaces its own folder.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        write_alerts(batch, f"{path}/{BATCH}={batch_id}", mode="overwrite")

    writer = fired.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_live_tail(calls: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Enriched calls to a table for consumers, who read the newest with ``live_tail``."""
    return to_parquet(calls, path, checkpoint, available_now)
