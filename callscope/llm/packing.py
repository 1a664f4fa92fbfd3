"""Packing of tokenised documents into sequences of a fixed size, with certified bin counts.

Documents over the size are cut into pieces; only their first piece may be
shorter. Whole pieces fill a sequence each. The others are packed by best-fit
decreasing, partition by partition. Dual feasible functions give a lower bound
for the number of sequences of a partition; one that meets its bound is
certified and done, but for sequences that are far from full. Those, and all
that are not filled well where there is a gap, are taken apart; their pieces
move to half as many partitions, and best-fit decreasing runs again. A round
that saves no sequence is not used. What moves shrinks by each round, and no task ever holds
more than ``per_partition`` pieces times two to the number of rounds.

Defined results: a NULL text counts as empty and is one end token; repeated
rows are packed one by one; an empty table gives no rows. Calling :func:`pack`
starts jobs.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import query, table, texts_in_blocks
from callscope.llm.tokens import VOCABULARY, encoder
from callscope.session import cut_lineage

PER_PARTITION = 50_000


def _cut(batches, size, end, vocabulary) -> Iterator[pa.RecordBatch]:
    """The pieces of each document, with their ids' checksum, and a number that no other row has."""
    encode = encoder(vocabulary)
    serial = TaskContext.get().partitionId() << 33
    for batch in texts_in_blocks(batches, 1):
        docs, pieces, starts, lengths, sums = [], [], [], [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            ids = np.append(encode.ids(text or ""), np.uint32(end)).astype("<u4")
            head = len(ids) % size or size
            cuts = [0, *range(head, len(ids) + 1, size)]
            for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                docs.append(row)
                pieces.append(piece)
                starts.append(a)
                lengths.append(b - a)
                sums.append(zlib.crc32(ids[a:b].tobytes()))
        if docs:
            serials = np.arange(serial, serial + len(docs))
            serial += len(docs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(docs)), *(pa.array(x, pa.int64()) for x in (pieces, starts, lengths, sums)), pa.array(serials)],
                ["doc", "piece", "start", "length", "crc", "serial"])


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin and the offset of each item, and what each bin has left.

    Bins are kept by the space they have left; the set of spaces that occur is
    the bits of one number, so the tightest bin is found without a search.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_space: list[list[int]] = [[] for _ in range(size + 1)]
    occurring, left = 0, []
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        fitting = occurring >> need
        if fitting:
            space = need + (fitting & -fitting).bit_length() - 1
            chosen = by_space[space].pop()
            if not by_space[space]:
                occurring &= ~(1 << space)
        else:
            space, chosen = size, len(left)
            left.append(size)
        bins[item], offsets[item] = chosen, size - space
        left[chosen] = space - need
        by_space[space - need].append(chosen)
        occurring |= 1 << (space - need)
    return bins, offsets, np.array(left, np.int64)


def lower_bound(lengths: np.ndarray, size: int, most: int = 64) -> int:
    """Sequences that any packing needs, by dual feasible functions on exact integers.

    The sum; rounding up to multiples of 1/k where an item is no multiple; and
    counting items over ``size - a`` as full while dropping those under ``a``.
    """
    count = np.bincount(lengths, minlength=size + 1)[:size + 1]
    x = np.arange(size + 1)
    best = -(-int((count * x).sum()) // size)
    for k in range(1, most + 1):
        scaled = (k + 1) * x
        value = np.where(scaled % size == 0, x * k, (scaled // size) * size)  # times k * size
        best = max(best, -(-int((count * value).sum()) // (k * size)))
    items, weight = np.cumsum(count), np.cumsum(count * x)
    for a in range(1, size // 2 + 1):
        full = int(items[size] - items[size - a])
        between = int(weight[size - a] - weight[a - 1])
        best = max(best, full + -(-between // size))
    return best


def _pack(batches, size, round_no) -> Iterator[pa.RecordBatch]:
    """Packs what is in the partition; tells each row its bin's free space and the partition's gap."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    rows = pa.Table.from_batches(batches).select(["doc", "piece", "start", "length", "crc", "serial"]).sort_by("serial")
    lengths = rows.column("length").to_numpy()
    bins, offsets, left = best_fit_decreasing(lengths, size)
    number = (round_no << 56) + (TaskContext.get().partitionId() << 32) + bins
    gap = len(left) - lower_bound(lengths, size)
    for name, value in (("bin", number), ("offset", offsets), ("left", left[bins]), ("gap", np.full(len(lengths), gap))):
        rows = rows.append_column(name, pa.array(value))
    yield from rows.to_batches(max_chunksize=10_000)


def pack(df: DataFrame, id: str = "doc_id", text: str = "text", size: int = 1024, end: int = 2, vocabulary: str = VOCABULARY,
         per_partition: int = PER_PARTITION, slack: int = 4, rounds: int = 4) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32, sequence_id, offset).

    ``slack``: sequences with no more free tokens than this are not taken apart.
    """
    kind = df.schema[id].dataType.simpleString()
    plain = f"doc {kind}, piece long, start long, length long, crc long, serial long"
    packed = f"{plain}, bin long, offset long, left long, gap long"
    texts = df.select(F.col(id).alias("doc"), F.col(text).cast("string").alias("text"))
    pieces = cut_lineage(texts.mapInArrow(partial(_cut, size=size, end=end, vocabulary=vocabulary), plain))

    def answer(rows, sequence, offset):
        return rows.select(F.col("doc").alias(id), F.col("piece").cast("int").alias("piece"), "start", "length", F.col("crc").alias("ids_crc32"),
                           sequence.alias("sequence_id"), offset.alias("offset"))

    out = answer(pieces.where(F.col("length") == size), F.col("serial") * 2, F.lit(0).cast("long"))
    todo = pieces.where(F.col("length") < size)
    parts = max(1, math.ceil(todo.count() / per_partition))

    def packing(rows, parts, round_no):
        return cut_lineage(rows.repartition(parts, F.xxhash64("serial")).mapInArrow(partial(_pack, size=size, round_no=round_no), packed))

    now = packing(todo, parts, 0)
    for round_no in range(1, rounds + 1):
        # gaps, and what rounding up costs: sequences that are far from full even where the bound is met
        loose = ((F.col("gap") > 0) & (F.col("left") > slack)) | (F.col("left") * 8 >= size)
        before = now.where(loose).select("bin").distinct().count()
        parts = math.ceil(parts / 2)
        if before < 2:
            break
        after = packing(now.where(loose), parts, round_no)
        if after.select("bin").distinct().count() < before:
            out = out.union(answer(now.where(~loose), F.col("bin") * 2 + 1, F.col("offset")))
            now = after
        if parts == 1:
            break
    return out.union(answer(now, F.col("bin") * 2 + 1, F.col("offset")))


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark, sf_dir):
    """Every document's pieces with their place in sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
