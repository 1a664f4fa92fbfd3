"""Spark session for scripts and tests, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "callscope") -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session that
    leaves it unset gets a folder of its own; on a cluster that is an error,
    because a machine-local folder is lost with the machine.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="callscope-")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below the shared work folder."""
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    Used where a plan would be read several times, or where a value such as
    the partition number must not change when lost tasks run again.
    """
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def allow_duplicate_json_keys(spark: SparkSession) -> None:
    """An object with a repeated key keeps the last value instead of failing."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors need this state store; a join of streams keeps its rows out of the heap with it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
