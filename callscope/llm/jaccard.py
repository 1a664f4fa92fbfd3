"""Similarity join of word shingle sets: groups of texts linked by their Jaccard similarity.

Two texts are linked when ``den * intersection >= num * union``. The join works
on distinct sets, one per group of equal texts, and never lists all pairs:

1. *Order.* A table of 2**18 counters over all shingles (fixed size, so it may be
   broadcast) orders every set from rare to common.
2. *Prefixes.* Sets that reach the threshold share ``s`` shingles in their first
   ``n - ceil(t * n) + s`` places. Only prefixes move, and only shingles that
   occur in the prefixes of two different sets count. The few sets that hold
   enough of them (``s`` is one in twenty of the smaller set) are the candidates.
3. *Exact order.* Among the candidates every shingle is counted exactly. A
   set's own shingles come first and fill places without joining anything, so
   the positional filter becomes sharp; sets are joined anew on this order.
4. *Pairs.* A prefix shingle with many sets is handled in rounds. In the first,
   only its set with the earliest place is paired with the others; links merge
   sets into groups, and later rounds pair only sets of different groups, with
   64 times as many of them each round. A pair must pass the length filter,
   the positional filter and the suffix filter (what follows the shared shingle
   in eight ranges of values bounds the overlap), and is verified once.

So a group of near copies costs about as many pairs as it has members, and
every link between sets of different groups is still found.

Defined results: NULL, empty or wordless texts have no shingles, link with
nothing and form a group of their own; fewer words than the width make one
shingle; rows that repeat an id are rows of their own with the same result;
sets are told apart by 64-bit numbers. Calling :func:`components` starts jobs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.llm.common import mix, query, table, texts_in_blocks, written
from callscope.llm.shingles import distinct, shingles
from callscope.session import cut_lineage

COUNTERS = 1 << 18
#: The most bits that tell candidates from other sets (4 MB).
BLOOM_BITS = 1 << 25
BLOCK = 1 << 20
RANGES = 8
#: Rows of (key, group) that may be broadcast or labelled in one task: a few MB.
SMALL = 200_000


def _count(batches, text, width):
    counts = np.zeros(COUNTERS, np.int64)
    for block in texts_in_blocks(batches, text, BLOCK):
        values, _ = shingles(block.column(0), width)
        counts += np.bincount((values % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["counter", "n"])


def _starts(texts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.bincount(texts, minlength=rows)
    return np.concatenate([[0], np.cumsum(sizes)]), sizes


def _set_numbers(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One number per set, whatever the order of its members."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(0x5851F42D4C957F2D)))])
    return mix(sums[starts[1:]] - sums[starts[:-1]]).view(np.int64)


def _sets(batches, text, width) -> Iterator[pa.RecordBatch]:
    """id, size and number of each text's set."""
    for block in texts_in_blocks(batches, text, BLOCK):
        values, texts = distinct(*shingles(block.column(1), width))
        starts, sizes = _starts(texts, block.num_rows)
        keys = _set_numbers(values, starts)
        yield pa.RecordBatch.from_arrays([block.column(0), pa.array(sizes), pa.array(keys, mask=sizes == 0)], ["id", "n", "k"])


def _first_rows(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One row of each set, none of empty ones."""
    _, first = np.unique(keys, return_index=True)
    return np.sort(first[sizes[first] > 0])


def prefix_length(n, num: int, den: int, shared: int | np.ndarray = 1):
    """Places among which a set has ``shared`` shingles in common with every set it links to."""
    return np.minimum(n, n - -(-num * n // den) + shared)


def shared_in_prefix(n):
    """How many shingles of its first prefix a set is to share; one in twenty, one at least."""
    return 1 + n // 20


def _prefixes(batches, text, width, num, den, classes) -> Iterator[pa.RecordBatch]:
    """The prefix shingles of each set, by the shared counters' order."""
    for block in texts_in_blocks(batches, text, BLOCK):
        values, texts = shingles(block.column(0), width)
        rank = classes.value[(values % np.uint64(COUNTERS)).astype(np.int64)]
        values, texts = distinct(values, texts, rank)
        starts, sizes = _starts(texts, block.num_rows)
        keys = _set_numbers(values, starts)
        wanted = np.zeros(block.num_rows, bool)
        wanted[_first_rows(keys, sizes)] = True
        place = np.arange(len(values)) - starts[texts]
        taken = wanted[texts] & (place < prefix_length(sizes, num, den, shared_in_prefix(sizes))[texts])
        yield pa.RecordBatch.from_arrays([pa.array(values[taken].view(np.int64)), pa.array(keys[texts[taken]]), pa.array(sizes[texts[taken]])], ["h", "k", "n"])


def _members(batches, text, width, bloom) -> Iterator[pa.RecordBatch]:
    """All shingles of the sets that may be candidates."""
    for block in texts_in_blocks(batches, text, BLOCK):
        values, texts = distinct(*shingles(block.column(0), width))
        starts, sizes = _starts(texts, block.num_rows)
        keys = _set_numbers(values, starts)
        rows = _first_rows(keys, sizes)
        bit = keys[rows].view(np.uint64) % np.uint64(8 * len(bloom.value))
        rows = rows[(bloom.value[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        if len(rows):
            lists = [values[starts[r]:starts[r + 1]].view(np.int64) for r in rows.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[rows]), pa.array(sizes[rows]), pa.array(lists, pa.list_(pa.int64()))], ["k", "n", "sh"])


def _places(batches, num, den) -> Iterator[pa.RecordBatch]:
    """Prefix places of sets whose shared shingles come ordered from rare to common.

    A set's ``n - len(sh)`` own shingles fill the first places. ``s0..`` count
    what follows the shingle, by the value's range.
    """
    for batch in batches:
        out = {"h": [], "k": [], "n": [], "at": [], **{f"s{r}": [] for r in range(RANGES)}}
        for k, n, sh in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            sh = sh.values.to_numpy()
            own = n - len(sh)
            taken = min(prefix_length(n, num, den) - own, len(sh))
            if taken <= 0:
                continue
            ranges = (sh.view(np.uint64) >> np.uint64(61)).astype(np.int64)
            left = np.bincount(ranges, minlength=RANGES) - np.cumsum(np.eye(RANGES, dtype=np.int64)[ranges[:taken]], axis=0)
            out["h"].append(sh[:taken])
            out["at"].append(np.arange(own, own + taken))
            out["k"].append(np.full(taken, k))
            out["n"].append(np.full(taken, n))
            for r in range(RANGES):
                out[f"s{r}"].append(left[:, r])
        if out["h"]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out.values()], list(out))


def _least_overlap(a, b, num: int, den: int):
    return F.ceil((a + b) * num / (num + den))


def _union_find(batches) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up)), pa.array([top(k) for k in up])], ["k", "c"])


def label_groups(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(k, c) for every end of an edge (a, b): c is the smallest number reachable.

    Up to ``small`` edges go through one task; more are labelled by rounds of
    joins in which every label also jumps to its label's label.
    """
    if edges.count() <= small:
        return written(edges.select("a", "b").coalesce(1).mapInArrow(_union_find, "k long, c long"))
    both = cut_lineage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("k")).agg(F.least(F.min("b"), F.first("a")).alias("c")))
    while True:
        near = both.join(labels.select(F.col("k").alias("b"), "c"), "b").groupBy(F.col("a").alias("k")).agg(F.min("c").alias("m"))
        hop = labels.select(F.col("k").alias("c"), F.col("c").alias("up"))
        after = labels.join(near, "k", "left").join(hop, "c", "left").select(
            "k", F.least("c", "m", "up").alias("c"), (F.least("c", "m", "up") < F.col("c")).alias("moved"))
        after = written(after)
        if not after.where("moved").limit(1).count():
            return after.select("k", "c")
        labels = after.select("k", "c")


def _maybe_broadcast(df: DataFrame, small: int) -> DataFrame:
    """``df``, a written table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= small else df


def _links(sets: DataFrame, places: DataFrame, num: int, den: int, small: int) -> DataFrame:
    """Verified links between sets, enough of them to connect every group."""
    columns = places.columns
    verified = labels = None
    pivots = 1
    least = F.col("n") - F.col("at") >= _least_overlap(F.col("n"), F.greatest(F.col("least_n"), F.ceil(F.col("n") * num / den)), num, den)
    while True:
        marked = places.withColumn("c", F.col("k"))
        if labels is not None:
            marked = places.join(_maybe_broadcast(labels, small), "k", "left").withColumn("c", F.coalesce("c", "k"))
        # Drop buckets of one group, and what no other set of the bucket can reach.
        bounds = marked.groupBy("h").agg(F.min("n").alias("least_n"), F.min("c").alias("low"), F.max("c").alias("high"))
        marked = marked.join(bounds.where("low < high").select("h", "least_n"), "h").where(least).drop("least_n")
        active = written(marked)
        row = F.struct(*active.columns)
        if pivots == 1:
            chosen = active.groupBy("h").agg(F.min_by(row, F.struct("at", "k")).alias("p")).select("p.*")
        else:
            order = Window.partitionBy("h").orderBy("at", "k")
            largest = active.groupBy("h", "c").count().groupBy("h").agg(F.max_by("c", F.struct("count", "c")).alias("main"))
            chosen = active.join(largest, "h").where("c <> main").drop("main")
            chosen = chosen.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= pivots).drop("_r")
        chosen = cut_lineage(chosen)
        if not chosen.limit(1).count():
            return verified.where("linked").select("a", "b") if verified is not None else chosen.select(F.col("k").alias("a"), F.col("k").alias("b"))
        x, y = chosen.alias("x"), active.alias("y")
        need = _least_overlap(F.col("x.n"), F.col("y.n"), num, den)
        suffix = sum((F.least(f"x.s{r}", f"y.s{r}") for r in range(1, RANGES)), F.least("x.s0", "y.s0"))
        pairs = x.join(y, F.col("x.h") == F.col("y.h")).where(
            (F.col("x.c") != F.col("y.c"))
            & (F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num)
            & (F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= need)
            & (suffix + 1 >= need)
        ).select(F.least("x.k", "y.k").alias("a"), F.greatest("x.k", "y.k").alias("b")).distinct()
        if verified is not None:
            pairs = pairs.join(verified, ["a", "b"], "left_anti")
        pairs = cut_lineage(pairs)
        # few sets are in pairs, so only those move
        named = cut_lineage(pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b").alias("k"))).distinct())
        used = sets.join(_maybe_broadcast(named, small), "k", "left_semi")
        sides = [used.select(F.col("k").alias(s), F.col("n").alias(f"n{s}"), F.col("sh").alias(f"sh{s}")) for s in "ab"]
        shared = F.size(F.array_intersect("sha", "shb"))
        judged = pairs.join(sides[0], "a").join(sides[1], "b").select(
            "a", "b", (shared * den >= (F.col("na") + F.col("nb") - shared) * num).alias("linked"))
        verified = written(judged if verified is None else verified.union(judged))
        labels = label_groups(verified.where("linked"), small)
        places = active.select(*columns).join(chosen.select("h", "k"), ["h", "k"], "left_anti")
        pivots *= 64


def components(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 4, num: int = 85, den: int = 100,
               small: int = SMALL) -> DataFrame:
    """(id, n_shingles, component_id) per row: ``component_id`` is the smallest id of its group.

    ``num`` / ``den`` is the least similarity; tables of up to ``small`` rows may be broadcast or go through one task. Ids are integers; a NULL id only
    stands for its group where no other id does.
    """
    spark = df.sparkSession
    texts = df.select(F.col(text).cast("string").alias("text"))
    counted = texts.mapInArrow(partial(_count, text="text", width=width), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    counters = counted.toArrow()  # at most COUNTERS rows, whatever the input
    counts = np.zeros(COUNTERS)
    counts[counters.column("counter").to_numpy()] = counters.column("n").to_numpy()
    classes = spark.sparkContext.broadcast(np.minimum(255, np.round(8 * np.log2(counts + 1))).astype(np.uint8))

    thin = df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        partial(_sets, text="text", width=width), f"id {df.schema[id].dataType.simpleString()}, n long, k long")
    thin = cut_lineage(thin)

    prefixes = texts.mapInArrow(partial(_prefixes, text="text", width=width, num=num, den=den, classes=classes), "h long, k long, n long")
    several = prefixes.groupBy("h").agg(F.min("k").alias("low"), F.max("k").alias("high")).where("low < high").select("h")
    # the partner may be smaller, down to the threshold, and both need to share as many as the smaller one asks for
    asked = F.expr(f"1 + ceil(n * {num} / {den}) div 20")
    candidates = prefixes.join(several, "h", "left_semi").groupBy("k", "n").agg(F.countDistinct("h").alias("shared"))
    candidates = written(candidates.where(F.col("shared") >= asked).select("k").distinct())
    del prefixes, several

    # a bit for each candidate lets their sets be picked out without moving the others
    found = candidates.count()
    bits = min(max(1 << 16, 1 << (16 * found).bit_length()), BLOOM_BITS)
    filled = candidates.select(F.expr(f"cast((k & {bits - 1}) >> 3 as int)").alias("byte"), F.expr("cast(1 << cast(k & 7 as int) as int)").alias("bit"))
    filled = filled.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    bloom = np.zeros(bits // 8, np.uint8)
    bloom[filled.column("byte").to_numpy()] = filled.column("bits").to_numpy()
    bloom = spark.sparkContext.broadcast(bloom)
    whole = texts.mapInArrow(partial(_members, text="text", width=width, bloom=bloom), "k long, n long, sh array<long>")
    if 16 * found > BLOOM_BITS:  # too many for the bits to tell them apart
        whole = whole.join(candidates, "k", "left_semi")
    whole = written(whole.dropDuplicates(["k"]))
    each = whole.select("k", F.explode("sh").alias("h"))
    common = each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = each.join(common, "h").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("df", "h")))["h"].alias("sh"))
    sets = written(shared.join(whole.select("k", "n"), "k").select("k", "n", "sh"))
    del each, common, shared, whole
    places = sets.mapInArrow(partial(_places, num=num, den=den), "h long, k long, n long, at long, " + ", ".join(f"s{r} long" for r in range(RANGES)))
    links = _links(sets, written(places), num, den, small)
    least = thin.where("k is not null").groupBy("k").agg(F.min("id").alias("least_id"))
    labels = label_groups(links, small)
    grouped = cut_lineage(least.join(_maybe_broadcast(labels, small), "k", "left").withColumn("c", F.coalesce("c", "k")))
    least = grouped.select("k", "c").join(grouped.groupBy("c").agg(F.min("least_id").alias("least_id")), "c").select("k", "least_id")
    with_words = thin.where("k is not null").join(least, "k").select("id", "n", F.col("least_id").alias("component_id"))
    alone = thin.where("k is null").select("id", "n", F.col("id").alias("component_id"))
    return with_words.union(alone).select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id")


@query("op5_ngram_jaccard")
def op5_ngram_jaccard(spark, sf_dir):
    """Every document with its group of texts whose 4-word shingle sets are at least 0.85 similar."""
    return components(table(spark, sf_dir, "documents"))
