"""Reading and appending the stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.operators.filters import DATE
from callscope.schema import ALERT_EVENTS, ROLLUP, TOOL_CALLS, normalize_schema


BATCH = "batch"
#: Columns that are looked up by single values. Their values lie all over a file's range, so a bloom filter tells which
#: row groups may hold one. The filters are sized by the values there are.
LOOKED_UP = ("session_id", "id")
_BLOOM = {"parquet.bloom.filter.adaptive.enabled": "true", **{f"parquet.bloom.filter.enabled#{c}": "true" for c in LOOKED_UP}}


def write_tool_calls(df: DataFrame, path: str, mode: str = "append", batch_id: int | None = None) -> None:
    """Append enriched calls, partitioned by day.

    With ``batch_id`` each day has a folder per batch, and a batch that is
    written again replaces its own folders only.

    Rows are rebalanced by day: small days are gathered into few files and a
    busy day is split over many tasks. Inside a file rows are sorted by server,
    tool and time, so the Parquet statistics serve the usual filters; bloom
    filters serve lookups of a session or a call.
    """
    full = normalize_schema(df)
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in TOOL_CALLS.fields if f.name in full.columns]
    dated = full.select(*columns).withColumn(DATE, F.to_date("timestamp"))
    arranged = dated.hint("rebalance", F.col(DATE)).sortWithinPartitions(DATE, "server_name", "tool_name", "timestamp")
    if batch_id is None:
        arranged.write.mode(mode).options(**_BLOOM).partitionBy(DATE).parquet(path)
    else:
        writer = arranged.withColumn(BATCH, F.lit(batch_id).cast("long")).write.mode("overwrite").options(**_BLOOM)
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(DATE, BATCH).parquet(path)


def read_tool_calls(spark: SparkSession, path: str, dates: Sequence[str] | None = None) -> DataFrame:
    """The stored calls with current columns, whenever a file was written.
    Of ``dates`` (``yyyy-MM-dd``) alone, only their folders are listed.

    The schema is given, so no file footers are read for it; a column that an
    old file lacks reads as NULL and then gets its default. The time filters
    prune whole days through the ``date`` partitions.
    """
    reader = spark.read.schema(TOOL_CALLS).option("basePath", path)
    if dates is None:
        stored = reader.parquet(path)
    else:
        folders = [f"{path}/{DATE}={d}" for d in dates]
        present = [f for f in folders if path_exists(spark, f)]
        if not present:
            return normalize_schema(spark.createDataFrame([], TOOL_CALLS))
        stored = reader.parquet(*present)
    return normalize_schema(stored.drop(BATCH))


def read_batch(spark: SparkSession, path: str, batch_id: int, dates: Sequence[str]) -> DataFrame:
    """The calls that one batch stored on ``dates``; only the batch's own folders are listed."""
    folders = [f"{path}/{DATE}={d}/{BATCH}={batch_id}" for d in dates]
    if not folders:
        return normalize_schema(spark.createDataFrame([], TOOL_CALLS))
    return normalize_schema(spark.read.schema(TOOL_CALLS).option("basePath", path).parquet(*folders).drop(BATCH))


def write_rollup(rolled: DataFrame, path: str, batch_id: int) -> None:
    """One batch's rows of the rollup, by day and batch; a batch that is written again replaces its own."""
    dated = rolled.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ROLLUP.fields], F.to_date("bucket").alias(DATE))
    arranged = dated.hint("rebalance", F.col(DATE)).sortWithinPartitions(DATE, "server_name", "tool_name", "bucket")
    writer = arranged.withColumn(BATCH, F.lit(batch_id).cast("long")).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(DATE, BATCH).parquet(path)


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The stored rollup; several batches may have rows of one key, which add up."""
    return spark.read.schema(ROLLUP).parquet(path).drop(BATCH)


def compact_day(spark: SparkSession, path: str, date: str, into: str) -> None:
    """One day's calls of many batches, written to the table ``into`` as few
    sorted files. Run it for days that receive no more batches; readers move
    over when it is done, so a job that dies half-way leaves ``path`` as it was."""
    day = read_tool_calls(spark, path, [date])
    full = day.withColumn(DATE, F.lit(date).cast("date")).drop(BATCH)
    arranged = full.hint("rebalance", F.col(DATE)).sortWithinPartitions("server_name", "tool_name", "timestamp")
    writer = arranged.write.mode("overwrite").options(**_BLOOM)
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(DATE).parquet(into)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was ever written to ``path``."""
    try:
        spark.read.schema("x int").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def write_alerts(df: DataFrame, path: str, mode: str = "append") -> None:
    df.select(*[f.name for f in ALERT_EVENTS.fields if f.name in df.columns]).write.mode(mode).parquet(path)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
