"""Wire logs as files: one line per message, numbered by where it lies.

A log line is ``time <tab> direction <tab> message``; the file's name tells the
connection and the number of the file among the connection's rotated ones. The
data source ``rpc_log`` splits large files at byte ranges (a line belongs to the
range in which it begins) and gives each line ``seq``, made from the file's
number and the line's first byte. It needs no pass over the data, is the
same however the files are split, and grows with a connection's lines.

As a stream, a file is read as far as its last line end, so a line that is still
being written waits for the next batch. The offset holds the end of every file
in the folder: move closed files away some time after they were read. A closed
file is followed by one with another name; one that became shorter is an error.

Defined results: empty files give nothing; empty lines are lines; the last line of a
batch read may lack its line end; bytes that are not UTF-8 are replaced; a line without
the two tabs or with an unreadable time gets NULLs there. Compressed files are not read.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: ``srv1.log`` or, rotated, ``srv1.12.log``.
NAMES = r"(?:^|/)(?P<conn>[^/]+?)(?:\.(?P<n>\d+))?\.log$"
SPLIT = 64 << 20
BLOCK = 4 << 20
_OFFSET_BITS, _FILE_BITS = 40, 22


@dataclass
class Range(InputPartition):
    """The bytes of a file whose lines one task reads."""

    file: str
    conn: str
    number: int
    begin: int
    end: int


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def lines_between(file, begin: int, end: int, block: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """(first byte, line) of the lines that begin in ``[begin, end)``."""
    at = begin
    if begin:
        # past the line that began before, but no further than this range
        at = begin - 1
        file.seek(at)
        while True:
            data = file.read(block)
            found = data.find(b"\n")
            at += found + 1 if found >= 0 else len(data)
            if found >= 0:
                break
            if not data or at >= end:
                return
    file.seek(at)
    pieces: list[bytes] = []
    while at < end:
        data = file.read(block)
        if not data:
            if pieces:
                yield at, b"".join(pieces)
            return
        *whole, rest = data.split(b"\n")
        for line in whole:
            line = b"".join([*pieces, line])
            pieces = []
            if at >= end:
                return
            yield at, line
            at += len(line) + 1
        if rest:
            pieces.append(rest)


class _Reader:
    def __init__(self, options):
        self.path = options["path"]
        self.names = re.compile(options.get("names", NAMES))
        self.split = int(options.get("splitBytes", SPLIT))

    def files(self) -> dict[str, int]:
        """Sizes of the folder's logs, by their name below it."""
        system, path = _open(self.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        sizes = {os.path.relpath(f.path, path): f.size for f in found if f.type == fs.FileType.File}
        return {name: size for name, size in sorted(sizes.items()) if self.names.search(name)}

    def ranges(self, ends: dict[str, int], begins: dict[str, int]) -> list[Range]:
        out, places = [], Counter()
        for name, end in ends.items():
            match = self.names.search(name)
            conn, number, begin = match["conn"], int(match["n"] or 0), begins.get(name, 0)
            places[conn, number] += 1
            if places[conn, number] > 1:
                raise ValueError(f"two files are number {number} of connection {conn}")
            if number >> _FILE_BITS or end >> _OFFSET_BITS:
                raise ValueError(f"{name}: the number or the size of this file is too large")
            if end < begin:
                raise ValueError(f"{name} became shorter: {begin} bytes were read, {end} are left")
            out += [Range(name, conn, number, at, min(at + self.split, end)) for at in range(begin, end, self.split)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, path = _open(self.path)
        seqs: list[int] = []
        values: list[str] = []
        size = 0

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array([partition.conn] * len(seqs)), pa.array(seqs, pa.int64()), pa.array(values, pa.string())], ["conn", "seq", "value"])

        with system.open_input_file(f"{path}/{partition.file}") as file:
            for at, line in lines_between(file, partition.begin, partition.end):
                seqs.append(partition.number << _OFFSET_BITS | at)
                values.append(line.decode("utf-8", "replace"))
                size += len(line) + 16
                if size > BLOCK:
                    yield batch()
                    seqs, values, size = [], [], 0
        if seqs:
            yield batch()


class _BatchReader(_Reader, DataSourceReader):
    def partitions(self):
        return self.ranges(self.files(), {}) or [Range("", "", 0, 0, 0)]

    def read(self, partition):
        return super().read(partition) if partition.end else iter(())


class _StreamReader(_Reader, DataSourceStreamReader):
    def __init__(self, options):
        super().__init__(options)
        self.seen: dict[str, tuple[int, int]] = {}

    def _whole_lines(self, name: str, size: int) -> int:
        """The end of the file's last whole line."""
        if self.seen.get(name, (-1, 0))[0] != size:
            system, path = _open(self.path)
            with system.open_input_file(f"{path}/{name}") as file:
                end = size
                while end:
                    begin = max(0, end - BLOCK)
                    file.seek(begin)
                    found = file.read(end - begin).rfind(b"\n")
                    end = begin + found + 1 if found >= 0 else begin
                    if found >= 0:
                        break
            self.seen[name] = size, end
        return self.seen[name][1]

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return {name: self._whole_lines(name, size) for name, size in self.files().items()}

    def partitions(self, start, end):
        return self.ranges(end, start)


class RpcLogSource(DataSource):
    """``format("rpc_log")``: columns ``conn``, ``seq``, ``value``; options ``names`` (a pattern with ``conn`` and ``n``), ``splitBytes``."""

    @classmethod
    def name(cls):
        return "rpc_log"

    def schema(self):
        return "conn string, seq long, value string"

    def reader(self, schema):
        return _BatchReader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


def _as_log(lines: DataFrame) -> DataFrame:
    """``(conn, direction, seq, ts, line)`` for :mod:`callscope.sources.capture`."""
    parts = F.split("value", "\t", 3)
    return lines.select(
        "conn", F.try_element_at(parts, F.lit(2)).alias("direction"), "seq",
        F.try_to_timestamp(parts[0]).alias("ts"), F.try_element_at(parts, F.lit(3)).alias("line"))


def read_rpc_log(spark: SparkSession, path: str, names: str = NAMES, split_bytes: int = SPLIT) -> DataFrame:
    """The wire logs below a folder."""
    spark.dataSource.register(RpcLogSource)
    return _as_log(spark.read.format("rpc_log").option("names", names).option("splitBytes", split_bytes).load(path))


def stream_rpc_log(spark: SparkSession, path: str, names: str = NAMES, split_bytes: int = SPLIT) -> DataFrame:
    """The same as a stream over files that grow and a folder that receives more."""
    spark.dataSource.register(RpcLogSource)
    return _as_log(spark.readStream.format("rpc_log").option("names", names).option("splitBytes", split_bytes).load(path))
