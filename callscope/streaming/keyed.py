"""A table with one row per key that a stream maintains batch by batch.

Rows lie in hash buckets of the key. A micro-batch appends what it learnt to the
buckets of its keys and touches no other; a bucket that has gathered
``merge_after`` additions is merged into one file set by the batch at hand, so
the cost of a batch follows its own keys and a reader opens few files. Which
files count is noted per batch in a small index (at most ``buckets`` times
``merge_after`` lines). Batch n starts from the newest index below n and writes
its own again if it is retried, so a retry changes nothing; files that neither
the last nor the present index names are deleted.

One stream writes a table; any number may read it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.sources.tables import BATCH, path_exists

BUCKET, MERGED = "bucket", "merged"
_INDEX = "bucket int, part bigint, merged boolean"

Part = tuple[int, int, bool]


def latest(*keys: str) -> Callable[[DataFrame], DataFrame]:
    """Merge rule: of several rows of a key the one of the last batch holds."""
    def merge(rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in (*keys, BATCH)]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), BATCH).alias("_row")).select(*keys, "_row.*")
    return merge


@dataclass(frozen=True)
class KeyedTable:
    """``merge`` gives one row per key of ``schema`` from rows that also have the ``batch`` they came with.

    ``buckets`` is fixed when the table is made: many for many keys (a bucket is merged by one task), few for short batches.
    """

    path: str
    keys: tuple[str, ...]
    schema: T.StructType | str
    merge: Callable[[DataFrame], DataFrame]
    buckets: int = 16
    merge_after: int = 8

    def read(self, spark: SparkSession, batch_id: int | None = None, of: DataFrame | None = None) -> DataFrame:
        """The rows as of before ``batch_id`` (else the newest), only those of the keys in ``of`` if that is given."""
        parts = self._parts(spark, batch_id)
        if of is None:
            return self.merge(self._rows(spark, parts))
        keys = of.select(*self.keys).distinct().persist(StorageLevel.MEMORY_AND_DISK)
        touched = set(self._touched(keys)) if parts else set()
        rows = self._rows(spark, [p for p in parts if p[0] in touched])
        return self.merge(rows.join(keys, list(self.keys), "left_semi"))

    def update(self, batch_id: int, rows: DataFrame) -> None:
        """Add the rows of a batch, one per key."""
        spark = rows.sparkSession
        index = self._index(spark, batch_id)
        before = index[max(index)] if index else []
        self._clean(spark, index, before)
        self._write(rows.withColumns({MERGED: F.lit(False), BUCKET: self._bucket(), BATCH: F.lit(batch_id).cast("long")}))
        touched = self._added(spark, batch_id)
        parts = sorted(before + [(b, batch_id, False) for b in touched])
        many = [b for b in touched if sum(p[0] == b for p in parts) > self.merge_after]
        if many:
            gathered = self.merge(self._rows(spark, [p for p in parts if p[0] in many]))
            self._write(gathered.withColumns({MERGED: F.lit(True), BUCKET: self._bucket(), BATCH: F.lit(batch_id).cast("long")}))
            parts = [p for p in parts if p[0] not in many] + [(b, batch_id, True) for b in many]
        note = spark.createDataFrame(parts, _INDEX).coalesce(1)
        note.write.mode("overwrite").parquet(f"{self.path}/index/{BATCH}={batch_id}")

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(rows.agg(F.collect_set(self._bucket())).first()[0])

    def _added(self, spark: SparkSession, batch_id: int) -> list[int]:
        """The buckets a batch has added to, by their folders. (An attempt that died wrote to no others.)"""
        pattern = hadoop_path(spark, f"{self.path}/rows/{MERGED}=false/{BUCKET}=*/{BATCH}={batch_id}")
        found = file_system(spark, pattern).globStatus(pattern) or []
        return sorted(int(status.getPath().getParent().getName().split("=")[1]) for status in found)

    def _write(self, rows: DataFrame) -> None:
        # keys are spread by their hash, so buckets are alike in size
        writer = rows.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(MERGED, BUCKET, BATCH).parquet(f"{self.path}/rows")

    def _folder(self, part: Part) -> str:
        return f"{self.path}/rows/{MERGED}={str(part[2]).lower()}/{BUCKET}={part[0]}/{BATCH}={part[1]}"

    def _rows(self, spark: SparkSession, parts: list[Part]) -> DataFrame:
        plain = spark.createDataFrame([], self.schema).schema
        schema = T.StructType([*plain.fields, T.StructField(BATCH, T.LongType())])
        if not parts:
            return spark.createDataFrame([], schema)
        everything = T.StructType([*schema.fields, T.StructField(MERGED, T.BooleanType()), T.StructField(BUCKET, T.IntegerType())])
        reader = spark.read.schema(everything).option("basePath", f"{self.path}/rows")
        return reader.parquet(*map(self._folder, parts)).select(*schema.fieldNames())

    def _index(self, spark: SparkSession, batch_id: int | None) -> dict[int, list[Part]]:
        """The files that each index before ``batch_id`` names, the last batch last. There are two of them at most."""
        if not path_exists(spark, f"{self.path}/index"):
            return {}
        index = spark.read.schema(f"{_INDEX}, {BATCH} bigint").parquet(f"{self.path}/index")
        known = index if batch_id is None else index.where(F.col(BATCH) < batch_id)
        lines = known.agg(F.collect_list(F.struct(BATCH, "bucket", "part", "merged"))).first()[0]
        out: dict[int, list[Part]] = {}
        for batch, *part in sorted(map(tuple, lines)):
            out.setdefault(batch, []).append(tuple(part))
        return out

    def _parts(self, spark: SparkSession, batch_id: int | None) -> list[Part]:
        index = self._index(spark, batch_id)
        return index[max(index)] if index else []

    def _clean(self, spark: SparkSession, index: dict[int, list[Part]], named: list[Part]) -> None:
        """Delete the indexes before the last one, and the files that only they name."""
        for batch in sorted(index)[:-1]:
            for part in set(index[batch]) - set(named):
                delete(spark, self._folder(part))
            delete(spark, f"{self.path}/index/{BATCH}={batch}")


def hadoop_path(spark: SparkSession, folder: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)


def file_system(spark: SparkSession, path):
    """The store a path lies in."""
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, folder: str) -> None:
    path = hadoop_path(spark, folder)
    file_system(spark, path).delete(path, True)
