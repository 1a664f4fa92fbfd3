"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from gc import collect as collect_garbage

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.session import cut_lineage

#: Bytes of text that a Python worker turns into objects at a time.
TEXT_BLOCK = 1 << 21
#: Words are runs of characters outside this set (ASCII white space).
SPACE = "[\\x20\\x09-\\x0D]+"

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query of this subpackage, with SQL where SQL can express it."""
    def register(build: Build) -> Build:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder (see :func:`cut_lineage`), its shuffle files let go.

    Spark removes shuffle files once the driver has collected the plans that
    made them. Long jobs of several steps would keep the files of all steps
    until then, so the driver is asked to collect its garbage here.
    """
    out = cut_lineage(df)
    del df
    collect_garbage()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def texts_in_blocks(batches: Iterator[pa.RecordBatch], text: str | int, limit: int = TEXT_BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches holding about ``limit`` bytes of text each, one row at least."""
    for batch in batches:
        column = batch.column(text if isinstance(text, int) else batch.schema.get_field_index(text))
        sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes) // limit
        cuts = np.flatnonzero(np.diff(block)) + 1
        begin = 0
        for end in [*cuts.tolist(), batch.num_rows]:
            if end > begin:
                yield batch.slice(begin, end - begin)
            begin = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column in one array, and each row's bounds in it (NULL: empty)."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
