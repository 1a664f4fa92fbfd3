"""The ingest stream: events in, calls, sessions and rejects out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callscope.config import Pricing
from callscope.operators.enrich import enrich
from callscope.operators.rollup import rollup
from callscope.operators.sessions import apply_session_ends, derive_sessions
from callscope.schema import SESSIONS
from callscope.sources.events import stream_events, stream_session_ends, validate_session_ends, validate_events
from callscope.sources.tables import BATCH, path_exists, read_batch, write_rollup, write_tool_calls
from callscope.streaming.keyed import KeyedTable

_END = "session_id string, ended_at timestamp"


@dataclass(frozen=True)
class IngestPaths:
    calls: str
    sessions: str
    rejected: str
    checkpoint: str

    @property
    def marks(self) -> str:
        """Where each batch notes the ids it gave out."""
        return self.calls.rstrip("/") + "-ids"

    @property
    def rollup(self) -> str:
        """Where the histogram of the calls is kept (see ``operators.rollup``)."""
        return self.calls.rstrip("/") + "-rollup"

    @property
    def ends(self) -> str:
        """Where the ends of sessions are kept."""
        return self.sessions.rstrip("/") + "-ends"


def run_ingest_stream(
    spark: SparkSession, events_path: str, paths: IngestPaths, pricing: Pricing = Pricing(),
    available_now: bool = False,
) -> StreamingQuery:
    """Validate, enrich and store events as they arrive.

    Every micro-batch writes its own ``batch=<id>`` folders in overwrite mode,
    for calls below their day, so a batch that is retried after a failure
    replaces itself, nothing is stored twice, and a report on one day lists
    that day only.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, paths, pricing)

    writer = stream_events(spark, events_path).writeStream.foreachBatch(store)
    writer = writer.option("checkpointLocation", paths.checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest_batch(batch: DataFrame, batch_id: int, paths: IngestPaths, pricing: Pricing = Pricing()) -> None:
    """Store one micro-batch."""
    batch.persist(StorageLevel.MEMORY_AND_DISK)  # parsed once for both outputs
    try:
        valid, rejected = validate_events(batch)
        first = _first_id(batch.sparkSession, paths.marks, batch_id)
        placed, starts, rows, days = _placed(valid)
        numbered = _numbered(placed, starts, first)
        calls = enrich(numbered, pricing)
        folder = f"/{BATCH}={batch_id}"
        write_tool_calls(calls, paths.calls, batch_id=batch_id)
        write_rollup(rollup(read_batch(batch.sparkSession, paths.calls, batch_id, days)), paths.rollup, batch_id)
        rejected.write.mode("overwrite").parquet(paths.rejected + folder)
        mark = batch.sparkSession.range(1).selectExpr(f"{first}L as first", f"{rows}L as rows")
        mark.coalesce(1).write.mode("overwrite").parquet(f"{paths.marks}{folder}")
        arrived = calls.select("id", "session_id", "server_name", "timestamp")  # the payload work is pruned
        session_table(paths.sessions).update(batch_id, derive_sessions(arrived))
    finally:
        batch.unpersist()


def run_session_ends_stream(spark: SparkSession, ends_path: str, paths: IngestPaths, available_now: bool = False) -> StreamingQuery:
    """Keep the end markers that arrive as JSON lines ``{"sessionId", "endedAt"}``; unusable ones go to ``<ends>-rejected``.

    A marker may come before its session's first call, and the latest one wins.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        end_batch(batch, batch_id, paths)

    writer = stream_session_ends(spark, ends_path).writeStream.foreachBatch(store)
    writer = writer.option("checkpointLocation", paths.checkpoint.rstrip("/") + "-ends")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def end_batch(batch: DataFrame, batch_id: int, paths: IngestPaths) -> None:
    """Store one micro-batch of end markers."""
    valid, rejected = validate_session_ends(batch)
    _store_ends(valid, batch_id, paths)
    rejected.write.mode("overwrite").parquet(f"{paths.ends}-rejected/{BATCH}={batch_id}")


def keep_session_ends(ends: DataFrame, paths: IngestPaths, available_now: bool = False) -> StreamingQuery:
    """Keep the ends that a stream finds, ``(session_id, ended_at)`` (see ``stateful.stream_session_ends``)."""
    def store(batch: DataFrame, batch_id: int) -> None:
        _store_ends(batch, batch_id, paths)

    writer = ends.writeStream.foreachBatch(store).option("checkpointLocation", paths.checkpoint.rstrip("/") + "-ends")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _store_ends(ends: DataFrame, batch_id: int, paths: IngestPaths) -> None:
    end_table(paths.ends).update(batch_id, ends.groupBy("session_id").agg(F.max("ended_at").alias("ended_at")))


def session_table(path: str) -> KeyedTable:
    """The sessions that batches have seen. The one of the earliest batch holds, later ones never change it."""
    def first(rows: DataFrame) -> DataFrame:
        columns = [name for name in SESSIONS.fieldNames() if name != "id"]
        return rows.groupBy("id").agg(F.min_by(F.struct(*columns), BATCH).alias("first")).select("id", "first.*")

    return KeyedTable(path, ("id",), SESSIONS, first)


def end_table(path: str) -> KeyedTable:
    """The latest end marker of each session."""
    def last(rows: DataFrame) -> DataFrame:
        return rows.groupBy("session_id").agg(F.max("ended_at").alias("ended_at"))

    return KeyedTable(path, ("session_id",), _END, last)


def read_sessions(spark: SparkSession, path: str, ends: str | None = None) -> DataFrame:
    """The sessions the ingest stream stored, with the ends kept at ``ends`` (``IngestPaths.ends``) if given."""
    stored = session_table(path).read(spark)
    return stored if ends is None else apply_session_ends(stored, end_table(ends).read(spark))


def _first_id(spark: SparkSession, marks: str, batch_id: int) -> int:
    """The id after those of all earlier batches, from the note of the batch
    before; a batch that runs again starts where it started. Batches follow
    each other, so the other notes are only looked through when one is missing."""
    schema = "first bigint, rows bigint"
    for folder, after in ((f"{marks}/{BATCH}={batch_id}", False), (f"{marks}/{BATCH}={batch_id - 1}", True)):
        if path_exists(spark, folder):
            row = spark.read.schema(schema).parquet(folder).first()
            if row is not None:
                return row["first"] + (row["rows"] if after else 0)
    if not path_exists(spark, marks):
        return 0
    noted = spark.read.schema(f"{schema}, {BATCH} bigint").parquet(marks).where(F.col(BATCH) < batch_id)
    return noted.agg(F.max(F.col("first") + F.col("rows"))).first()[0] or 0


def _with_arrival_id(df: DataFrame, first: int) -> tuple[DataFrame, int]:
    """The rows with ids that count on from ``first`` in the order of input
    split and line, and how many there are. The id breaks ties of equal times."""
    placed, starts, total, _ = _placed(df)
    return _numbered(placed, starts, first), total


def _placed(df: DataFrame) -> tuple[DataFrame, DataFrame, int, list[str]]:
    """The rows with split and line, how many rows are in the splits before each, how many in all, and of which days.

    Splits are numbered by adding up their row counts, one row per split.
    """
    line = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = df.withColumns({"_split": F.spark_partition_id(), "_line": line})
    day = F.to_date("timestamp").cast("string") if "timestamp" in df.columns else F.lit(None).cast("string")
    counts = placed.groupBy("_split").agg((F.max("_line") + 1).alias("rows"), F.collect_set(day).alias("days"))
    whole = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.array_distinct(F.flatten(F.collect_list("days")))).first()
    earlier = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_split", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("_start"))
    return placed, starts, whole[0], sorted(whole[1] or [])


def _numbered(placed: DataFrame, starts: DataFrame, first: int) -> DataFrame:
    numbered = placed.join(starts, "_split").withColumn("id", F.lit(first).cast("long") + F.col("_start") + F.col("_line"))
    return numbered.drop("_split", "_line", "_start")
