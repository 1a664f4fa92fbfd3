"""Nearest neighbours by multi-index hashing of learned binary codes.

A rotation learned on a bounded sample (principal axes, then alternating
least-squares rotations that bring the sample near the corners of a cube) turns
a vector into ``bits`` signs. The code is cut into substrings, each with an
index from its value to the rows. Two codes within a Hamming radius ``r`` agree
in one of ``m`` substrings up to ``r // m`` bits, so probing every substring's
neighbours up to that distance reaches every code within the radius. Those are
ranked by the true distance of the original vectors.

The radius is calibrated on the sample: it holds ``recall`` of the sample's own
nearest neighbours, which lie further apart than those of the whole table. A
query that finds fewer than ``k`` rows is run again without a radius.

All rows are indexed. Queries come in blocks of a bounded size, and a task keeps
``k`` rows for each query of the block. Of equal vectors the ``k + 1`` smallest
ids are enough, as ties go to the smaller id; map tasks drop the others before
the shuffle, so one very common vector fills no task.

Defined results: vectors that are NULL, zero, of another length than most of
the sample, or hold NULL or non-finite components take no part; an id that
repeats counts as one query, and its rows are not its own neighbours; ties go
to the smaller id. Calling :func:`search` starts jobs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.common import query, table, written

SAMPLE = 4096
BITS = 64
SUBSTRING = 8
BLOCK = 8192


@dataclass(frozen=True)
class Codes:
    """What turns vectors into codes, and the radius to search."""

    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """One byte per substring; the last may hold fewer bits."""
        return np.packbits((vectors - self.mean) @ self.rotation >= 0, axis=1, bitorder="little")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``a`` to the vector or the rows ``b``."""
    return np.sqrt(((a - b) ** 2).sum(axis=1))


def fit(sample: np.ndarray, bits: int = BITS, k: int = 10, recall: float = 0.98, rounds: int = 30, seed: int = 7) -> Codes:
    """Codes from at most a few thousand vectors."""
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0)
    centred = sample - mean
    axes = np.linalg.svd(centred.T @ centred)[0]
    bits = min(bits, axes.shape[1])
    axes = axes[:, :bits]
    low = centred @ axes
    turn = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        corners = np.where(low @ turn >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(corners.T @ low)
        turn = (u @ vt).T
    codes = Codes(mean, axes @ turn, bits)
    packed = codes.encode(sample)
    found = []
    for i in rng.permutation(len(sample))[:256].tolist():
        apart = distances(sample, sample[i])
        apart[i] = np.inf
        near = np.argsort(apart, kind="stable")[:min(k, len(sample) - 1)]
        found += np.bitwise_count(packed[near] ^ packed[i]).sum(axis=1).tolist()
    radius = int(np.quantile(found, recall, method="higher")) if found else bits
    return Codes(mean, codes.rotation, radius)


def _balls(most: int) -> np.ndarray:
    """All bytes with at most ``most`` bits set."""
    return np.array([sum(1 << b for b in bits) for n in range(min(most, 8) + 1) for bits in combinations(range(8), n)], np.uint8)


class Index:
    """The rows of one batch, by the value of each substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable")
        sizes = np.stack([np.bincount(column, minlength=256) for column in codes.T])
        self.ends = np.cumsum(sizes, axis=1)
        self.starts = self.ends - sizes

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows whose codes are within the radius, in order."""
        probes = _balls(radius // self.codes.shape[1])
        seen = np.zeros(len(self.codes), bool)
        for j in range(self.codes.shape[1]):
            values = probes ^ code[j]
            begin, size = self.starts[j][values], (self.ends - self.starts)[j][values]
            at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
            seen[self.order[at, j]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]


def _vectors(column: pa.Array) -> np.ndarray:
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(rows, -1)


def _nearest(batches, block, codes, radius, k) -> Iterator[pa.RecordBatch]:
    """The ``k`` nearest rows of this partition for each query of the block."""
    names, queries = block.value
    packed = codes.encode(queries)
    best = [(np.zeros(0), np.zeros(0, np.int64))] * len(names)
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, vectors = batch.column(0).to_numpy(), _vectors(batch.column(1))
        index = Index(codes.encode(vectors))
        for q, name in enumerate(names.tolist()):
            rows = index.within(packed[q], radius)
            rows = rows[ids[rows] != name]
            if len(rows):
                score = np.concatenate([best[q][0], distances(vectors[rows], queries[q])])
                who = np.concatenate([best[q][1], ids[rows]])
                if len(score) > 4 * k:
                    # ties of the k-th stay in for the order by id
                    near = score <= np.partition(score, k - 1)[k - 1]
                    score, who = score[near], who[near]
                first = np.lexsort((who, score))[:k]
                best[q] = score[first], who[first]
    sizes = [len(b[0]) for b in best]
    if sum(sizes):
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(names, sizes)), pa.array(np.concatenate([b[1] for b in best])), pa.array(np.concatenate([b[0] for b in best]))],
            ["query_id", "vec_id", "score"])


def usable(vector: Column) -> Column:
    """True for vectors that take part, whatever their length."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(rows: DataFrame, queries: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 10, bits: int = BITS,
           sample: int = SAMPLE, block: int = BLOCK, codes: Codes | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its nearest rows of ``rows``."""
    spark = rows.sparkSession
    kinds = "query_id long, vec_id long, score double"

    def plain(df):
        return df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))

    drawn = plain(rows).orderBy(F.xxhash64("id"), "id").limit(sample).toArrow().column("v").to_pylist()
    lengths = [len(v) for v in drawn]
    result = None
    if drawn:
        dim = max(set(lengths), key=lambda n: (lengths.count(n), n))
        drawn = np.array([v for v in drawn if len(v) == dim], np.float64)
        codes = codes or fit(drawn, bits, k)
        copies = Window.partitionBy("v").orderBy("id")
        stored = plain(rows).where(F.size("v") == dim).withColumn("_r", F.row_number().over(copies)).where(F.col("_r") <= k + 1).drop("_r")
        stored = written(stored)
        asked = written(plain(queries).where(F.size("v") == dim).dropDuplicates(["id"]))
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")

        def run(asked, radius):
            blocks = max(1, -(-asked.count() // block))
            out = None
            for b in range(blocks):
                part = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").toArrow()  # about ``block`` rows
                if not part.num_rows:
                    continue
                column = part.column("v").combine_chunks()
                column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
                shared = spark.sparkContext.broadcast((part.column("id").to_numpy(), _vectors(column)))
                found = stored.mapInArrow(partial(_nearest, block=shared, codes=codes, radius=radius, k=k), kinds)
                out = found if out is None else out.union(found)
            if out is None:
                return None
            return written(out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))

        result = run(asked, codes.radius)
        if result is not None and codes.radius < codes.bits:
            full = result.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
            short = written(asked.join(full, "id", "left_anti"))
            again = run(short, codes.bits)
            if again is not None:
                result = result.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").union(
                    again.select(*result.columns))
    if result is None:
        result = spark.createDataFrame([], f"{kinds}, rank int")
    return result.select("query_id", "rank", "vec_id", "score")


@query("op8_multi_index_hashing")
def op8_multi_index_hashing(spark, sf_dir):
    """The ten nearest of all embeddings for those whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 100 = 0"))
