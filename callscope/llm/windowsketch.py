"""Removal of word windows that an earlier document holds too, behind a count-min sketch.

A word goes if a window of ``width`` words that covers it also starts in a
document of a smaller id. All windows of a large corpus are too many to be
grouped, and most occur once:

1. *Sketch.* Each window is counted under the least of its grams of ``gram``
   words (by a hash; the leftmost of equals), once for a document. Equal windows
   have equal least grams, so the count of that gram is never below the
   window's; neighbouring windows mostly share one, so there is one count for
   about 16 words. Each partition counts for itself in a count-min sketch of two
   rows, of which it sends the counters it touched; they are merged counter by
   counter, up to 2. A merged counter is no less than any count that fell on it.
2. *Exact grouping.* A second pass takes only the windows whose estimate, the
   lesser of both counters, is 2. Neighbours under one gram move together as a
   *run*. Of runs with equal text the one of the smallest id stays, the others
   are repeated from end to end. Where a gram has several run texts, the windows
   of their first runs are grouped one by one.

Nothing is lost: a window that two documents share has an estimate of 2 or
more. A full sketch lets more windows through, and changes no result; the second
pass then moves 11 bytes for a word at most. The sketch has a fixed size
(``counters`` in each row, 2**27: 32 MB), which is broadcast; half of its counters
stay below 2 up to about 3 billion words.

A busy passage fills no task: equal runs, and later equal windows, are merged
before each shuffle, and what is known to be repeated is dealt out evenly.

Defined results: a NULL text has no words; a text under ``width`` words loses
none; rows with a NULL id take no part and stay whole; rows that repeat an id
are one document, whose rows do not count against each other. Words are
compared as 64-bit numbers, windows as pairs of them. A worker holds about 4 MB
of texts, or one longer text. Calling these functions starts jobs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm.common import mix, query, table, texts_in_blocks, unused, written
from callscope.llm.shingles import word_numbers

WIDTH, GRAM = 50, 20
#: Counters in each of the two rows of the sketch (a power of two), and those merged together.
COUNTERS, SLICE = 1 << 27, 1 << 22
#: Words looked at together; places must fit into the low bits of a 64-bit number.
PLACE_BITS = 20
BLOCK = 1 << (PLACE_BITS - 1)
#: Bytes of text whose equal runs are merged before the shuffle; touched counters held by a task; windows merged together.
MERGED, TOUCHED, EXPLODED = 1 << 22, 1 << 22, 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ROWS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
_powers: dict[np.uint64, np.ndarray] = {}


def _powers_of(base: np.uint64) -> np.ndarray:
    if base not in _powers:
        steps = np.full(BLOCK + 1, base)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    rest = width - size
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def _parts(bounds: np.ndarray, width: int) -> Iterator[list[tuple[int, int, int]]]:
    """Blocks of (row, first word, end) of up to ``BLOCK`` words. Longer texts are cut so that each window is in one part."""
    block, size = [], 0
    for row in np.flatnonzero(np.diff(bounds) >= width).tolist():
        begin, end = int(bounds[row]), int(bounds[row + 1])
        while end - begin >= width:
            stop = min(end, begin + BLOCK)
            if size + stop - begin > BLOCK:
                yield block
                block, size = [], 0
            block.append((row, begin, stop))
            size += stop - begin
            begin = stop - width + 1
    if block:
        yield block


def runs_of(numbers: np.ndarray, bounds: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> Iterator[dict[str, np.ndarray]]:
    """The runs of the texts, a block at a time: ``a`` least gram, ``c`` hash of the run's words, ``row``, ``lo`` first
    word in the text, ``nw`` windows. ``window`` has the hashes of the block's windows, ``at`` where a run's begin."""
    mask = np.uint64((1 << PLACE_BITS) - 1)
    for block in _parts(bounds, width):
        rows, begins, stops = (np.array(x) for x in zip(*block))
        sizes = stops - begins
        ends = np.cumsum(sizes)
        part = np.concatenate([numbers[b:s] for b, s in zip(begins.tolist(), stops.tolist())])
        up, down = _powers_of(_BASE), _powers_of(_INVERSE)
        sums = np.append(np.uint64(0), np.cumsum(part * up[:len(part)]))
        hashes = lambda at, n: mix((sums[at + n] - sums[at]) * down[at])
        grams = hashes(np.arange(len(part) - gram + 1), gram)
        least = _least((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), width - gram + 1)
        owner = np.repeat(np.arange(len(block)), sizes)
        starts = np.flatnonzero(owner[:len(part) - width + 1] == owner[width - 1:])
        place = (least[starts] & mask).astype(np.int64)
        first = np.ones(len(starts), bool)
        first[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(first)
        nw = np.diff(np.append(first, len(starts)))
        at = starts[first]
        piece = owner[at]
        yield {"a": grams[place[first]].view(np.int64), "c": (hashes(at, nw + width - 1) ^ mix(nw.astype(np.uint64))).view(np.int64),
               "row": rows[piece], "lo": at - (ends - sizes)[piece] + begins[piece] - bounds[rows[piece]], "nw": nw,
               "window": hashes(starts, width).view(np.int64), "at": first}


def _blocks(batches, width: int, gram: int) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """Ids of rows, and runs, of blocks of (id, text) rows."""
    known = (batch.filter(batch.column(0).is_valid()) for batch in batches)
    for batch in texts_in_blocks(known, 1, MERGED):
        ids = batch.column(0).to_numpy()
        for runs in runs_of(*word_numbers(batch.column(1), lower=False), width, gram):
            yield ids, runs


def counters_of(a: np.ndarray, counters: int) -> list[np.ndarray]:
    """The counters of a gram in both rows, the second row's behind the first's."""
    shift = np.uint64(64 - counters.bit_length() + 1)
    return [(mix(a.view(np.uint64) ^ seed) >> shift).astype(np.int64) + i * counters for i, seed in enumerate(_ROWS)]


def _touched(batches, width: int, gram: int, counters: int) -> Iterator[pa.RecordBatch]:
    """The counters that a partition touches, by slice, those it touches more than once twice."""
    held: list[np.ndarray] = []

    def sent() -> Iterator[pa.RecordBatch]:
        places = np.sort(np.concatenate(held))
        held.clear()
        needed = np.ones(len(places), bool)
        needed[2:] = places[2:] != places[:-2]
        places = places[needed]
        cuts = np.flatnonzero(np.append(True, places[1:] // SLICE != places[:-1] // SLICE))
        parts = [p.astype(np.uint32).tobytes() for p in np.split(places % SLICE, cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array((places[cuts] // SLICE).astype(np.int32)), pa.array(parts, pa.binary())], ["slice", "places"])

    for _, runs in _blocks(batches, width, gram):
        a, row = runs["a"], runs["row"]
        order = np.lexsort((a, row))
        a, row = a[order], row[order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (row[1:] != row[:-1])
        held += counters_of(a[fresh], counters)
        if sum(map(len, held)) >= TOUCHED:
            yield from sent()
    if held:
        yield from sent()


def _merged(batches) -> Iterator[pa.RecordBatch]:
    """Reads touched counters in the order of slices; one row a slice with a bit for each counter that is 2 or more."""
    current, counts = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())], ["slice", "bits"])

    for batch in batches:
        for number, places in zip(batch.column(0).to_pylist(), batch.column(1)):
            if number != current:
                if current is not None:
                    yield done()
                current, counts = number, np.zeros(SLICE, np.uint8)
            places = np.frombuffer(places.as_buffer(), np.uint32)
            twice = places[1:][places[1:] == places[:-1]]
            counts[places] = np.minimum(counts[places] + 1, 2)
            counts[twice] = 2
    if current is not None:
        yield done()


def sketch(texts: DataFrame, width: int = WIDTH, gram: int = GRAM, counters: int = COUNTERS) -> np.ndarray:
    """One bit for each counter of the merged sketch: does it stand at 2 or more? ``texts`` has (id, text).

    The bits are put together in the driver: ``counters / 4`` bytes, whatever the corpus.
    """
    touched = texts.mapInArrow(partial(_touched, width=width, gram=gram, counters=counters), "slice int, places binary")
    merged = touched.repartition("slice").sortWithinPartitions("slice").mapInArrow(_merged, "slice int, bits binary").toArrow()
    bits = np.zeros(counters // 4, np.uint8)
    for number, part in zip(merged.column("slice").to_pylist(), merged.column("bits")):
        begin = number * (SLICE // 8)
        room = bits[begin:begin + SLICE // 8]
        room[:] = np.frombuffer(part.as_buffer(), np.uint8)[:len(room)]
    return bits


def estimated_repeated(a: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the estimate of each gram's count is 2 or more."""
    out = np.ones(len(a), bool)
    for place in counters_of(a, len(bits) * 4):
        out &= (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 > 0
    return out


def _order(k1, k2, ids, at):
    """The order by key, id and place, and for each row of it the first id of its key."""
    order = np.lexsort((at, ids, k2, k1))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
    return order, ids[order][np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]


def _dealt(known, ids, at, k1, k2):
    """The numbers by which rows are dealt to tasks: open ones by key, known repeats evenly."""
    by_key = mix(k1.view(np.uint64) * np.uint64(31) + k2.view(np.uint64))
    evenly = mix(ids.view(np.uint64) * np.uint64(31) + at.view(np.uint64))
    return np.where(known, evenly, by_key).view(np.int64)


def _candidates(batches, width: int, gram: int, bits) -> Iterator[pa.RecordBatch]:
    """The runs that the sketch lets through with the hashes of their windows; without them if known to be repeated."""
    for ids, runs in _blocks(batches, width, gram):
        taken = np.flatnonzero(estimated_repeated(runs["a"], bits.value))
        if not len(taken):
            continue
        a, c, lo, nw, at = (runs[k][taken] for k in ("a", "c", "lo", "nw", "at"))
        own = ids[runs["row"][taken]]
        order, least = _order(a, c, own, lo)
        a, c, lo, nw, at, own = (x[order] for x in (a, c, lo, nw, at, own))
        known = own != least
        raw = runs["window"].tobytes()
        windows = [None if k else raw[8 * b:8 * (b + n)] for k, b, n in zip(known.tolist(), at.tolist(), nw.tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(_dealt(known, own, lo, a, c)), *map(pa.array, (a, c, own, lo, nw)), pa.array(windows, pa.binary())],
            ["p", "a", "c", "id", "lo", "nw", "windows"])


def _judged(batches, width: int, firsts: bool) -> Iterator[pa.RecordBatch]:
    """Reads (p, key, key, id, at, n, ...) by key, id and place; ``n`` windows begin at ``at``, no last column if known.

    Yields (key NULL, id, lo, length) for stretches that a smaller id holds too, and the rows of the smallest ids if asked for.
    """
    last = None  # the last key, and its smallest id
    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2, ids, at, n = (batch.column(i).to_numpy() for i in range(1, 6))
        open_rows = batch.column(6).is_valid().to_numpy(zero_copy_only=False)
        repeated = np.ones(batch.num_rows, bool)
        rows = np.flatnonzero(open_rows)
        if len(rows):
            key = np.stack([k1[rows], k2[rows]])
            fresh = np.append(last is None or tuple(key[:, 0].tolist()) != last[0], (key[:, 1:] != key[:, :-1]).any(axis=0))
            index = np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), -1))
            least = np.where(index >= 0, ids[rows][index], last[1] if last else 0)
            repeated[rows] = ids[rows] != least
            last = tuple(key[:, -1].tolist()), int(least[-1])
        kept = repeated | firsts
        mark = pa.array(repeated[kept])
        none = pa.nulls(int(kept.sum()), pa.binary())
        columns = [pa.array(x[kept]) for x in (k1, k2, ids, at, n + width - 1)]
        windows = pc.if_else(mark, none, batch.column(6).filter(pa.array(kept))) if firsts else none
        yield pa.RecordBatch.from_arrays([pc.if_else(mark, pa.nulls(len(mark), pa.int64()), columns[0]), *columns[1:], windows],
                                         ["a", "c", "id", "lo", "length", "windows"])


def _exploded(batches) -> Iterator[pa.RecordBatch]:
    """The windows of runs one by one; those that the runs at hand show to be repeated come as known."""
    def merged(rows: pa.Table) -> pa.RecordBatch:
        n = (pc.binary_length(rows.column("windows")).to_numpy() // 8).astype(np.int64)
        w = np.frombuffer(b"".join(rows.column("windows").to_pylist()), np.int64)
        step = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
        a, ids, at = (np.repeat(rows.column(c).to_numpy(), n) for c in ("a", "id", "lo"))
        at = at + step
        order, least = _order(a, w, ids, at)
        a, w, ids, at = a[order], w[order], ids[order], at[order]
        known = ids != least
        return pa.RecordBatch.from_arrays(
            [pa.array(_dealt(known, ids, at, a, w)), *map(pa.array, (a, w, ids, at, np.ones(len(a), np.int64))),
             pa.array(np.ones(len(a), np.int8), mask=known)], ["p", "a", "w", "id", "at", "n", "open"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column("windows"))).as_py() or 0
        if size >= 8 * EXPLODED:
            yield merged(pa.Table.from_batches(held))
            held, size = [], 0
    if size:
        yield merged(pa.Table.from_batches(held))


def repeated_spans(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM,
                   counters: int = COUNTERS) -> DataFrame:
    """(id, lo, length): the stretches of words that a smaller id holds too; they may overlap."""
    if not 0 < gram <= width or counters & (counters - 1) or counters < 8:
        raise ValueError("a gram must fit into a window, and the counters must be a power of two")
    texts = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    bits = df.sparkSession.sparkContext.broadcast(sketch(texts, width, gram, counters))
    judged = "a long, c long, id long, lo long, length long, windows binary"

    runs = texts.mapInArrow(partial(_candidates, width=width, gram=gram, bits=bits), "p long, a long, c long, id long, lo long, nw long, windows binary")
    runs = runs.repartition("p").sortWithinPartitions("a", "c", "id", "lo")
    found = written(runs.mapInArrow(partial(_judged, width=width, firsts=True), judged))

    firsts = found.where("a is not null").select("a", "c", "id", "lo", "windows")
    # written, so that the join reads it as it is and may split the partition of a busy gram
    several = written(firsts.groupBy("a").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("a"))
    edges = firsts.join(several, "a", "left_semi").select("a", "id", "lo", "windows")
    windows = edges.mapInArrow(_exploded, "p long, a long, w long, id long, at long, n long, open byte")
    windows = windows.repartition("p").sortWithinPartitions("a", "w", "id", "at")
    return found.where("a is null").select("id", "lo", "length").union(
        windows.mapInArrow(partial(_judged, width=width, firsts=False), judged).select("id", "lo", "length"))


def _kept(batches, text: str, spans: str, keep: tuple[str, ...], whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in texts_in_blocks(batches, text):
        names = batch.schema.names
        at, found = names.index(text), batch.column(names.index(spans))
        figures, texts = [], []
        for row, value in enumerate(batch.column(at).cast(pa.large_binary())):
            parts = (value.as_py() or b"").split()  # at ASCII white space, as word_numbers does
            n = len(parts)
            if found[row].is_valid:
                pairs = found.slice(row, 1).flatten()
                lo, length = pairs.field(0).to_numpy(), pairs.field(1).to_numpy()
                change = np.bincount(np.minimum(lo, n), minlength=n + 1) - np.bincount(np.minimum(lo + length, n), minlength=n + 1)
                parts = [parts[i] for i in np.flatnonzero(np.cumsum(change[:n]) == 0).tolist()]
            kept = b" ".join(parts)
            texts.append(kept.decode("utf-8", "replace") if whole and value.is_valid else None)
            figures.append((n, n - len(parts), hashlib.sha256(kept).hexdigest()))
        columns = {c: batch.column(names.index(c)) for c in keep}
        if whole:
            columns[text] = pa.array(texts, batch.schema.field(at).type)
        n, removed, digest = zip(*figures) if figures else ((), (), ())
        yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())],
                                         [*columns, "n_words", "n_removed", "kept_sha256"])


def remove_windows(df: DataFrame, id: str = "doc_id", text: str = "text", keep_text: bool = True, **settings: int) -> DataFrame:
    """Each row with the words that stay, joined by one space (a NULL text stays NULL), and ``n_words``, ``n_removed`` and
    ``kept_sha256`` of the words that stay. Columns of ``df`` that have the names of these figures are replaced.
    """
    figures = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType())]
    columns = [c for c in df.columns if c in (id, text) or c not in dict(figures)]
    own, spans = unused(df.columns, "span_id"), unused([*df.columns, "span_id"], "spans")
    by_row = repeated_spans(df, id, text, **settings).groupBy(F.col("id").alias(own)).agg(F.collect_list(F.struct("lo", "length")).alias(spans))
    joined = df.select(*columns).join(by_row, F.col(id).cast("long") == F.col(own), "left").drop(own)
    keep = tuple(c for c in columns if keep_text or c != text)
    schema = T.StructType([*[df.schema[c] for c in keep], *[T.StructField(n, t) for n, t in figures]])
    return joined.mapInArrow(partial(_kept, text=text, spans=spans, keep=keep, whole=keep_text), schema)


OP11_SQL = """
with w as (
  select doc_id, [x for x in string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if x <> ''] as u from documents),
windows as (
  select doc_id, i, sha256(array_to_string(u[i:i + 49], ' ')) as h
  from (select doc_id, u, unnest(range(1, len(u) - 48)) as i from w where len(u) >= 50)),
first as (
  select h, min(doc_id) as least from windows group by h),
gone as (
  select distinct doc_id, k
  from (select doc_id, unnest(range(i, i + 50)) as k from windows join first using (h) where doc_id > least)),
words as (
  select doc_id, unnest(u) as word, unnest(range(1, len(u) + 1)) as k from w),
stays as (
  select doc_id, count(gone.k) as removed, string_agg(word, ' ' order by k) filter (gone.k is null) as kept
  from words left join gone using (doc_id, k) group by doc_id)
select doc_id, cast(len(u) as bigint) as n_words, cast(coalesce(removed, 0) as bigint) as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from w left join stays using (doc_id)
"""


@query("op11_window_sketch", OP11_SQL)
def op11_window_sketch(spark, sf_dir):
    """What is left of every document without the words in 50-word windows that a smaller id holds too."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_windows(documents, keep_text=False)
