"""Removal of passages that occur earlier in the corpus, by maximal repeats of a suffix array.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts earlier
(in a document of a smaller id, or earlier in the same one). All suffixes of a
large corpus cannot be sorted, and need not be:

1. *Anchors.* Each window is assigned the least of its 32-byte grams (by a
   hash; the leftmost of equals). That choice depends on the window alone, so
   equal windows have equal anchors. Neighbouring windows mostly share one,
   which makes a *run* of windows: about one run for 36 bytes of text, and only
   their hashes move.
2. *Runs.* Of runs with equal text only the first occurrence matters; the
   others are repeats from end to end. Runs whose anchor occurs in no other run
   are done. Equal runs are merged in the map tasks first, so a passage in a
   third of all documents does not fill one task.
3. *Suffix arrays.* What is left are runs that share an anchor and differ
   somewhere: where repeats begin and end. For each anchor, the suffixes that
   start a window are sorted with their common prefixes, and one scan with a
   stack visits the tree of common-prefix intervals. An interval whose
   occurrences do not all extend to the left by one byte is a maximal repeat
   with all its occurrences, all but the first of which are removed. Of nested
   ones an occurrence needs the longest in which it is not the first, and those
   of one run overlap: at most one stretch is output for a run.
   An anchor with more than ``GROUP_LIMIT`` different runs is resolved window
   by window instead (step 2 with runs of one window), which has no large group.

Defined results: a NULL text counts as empty; texts under ``WINDOW`` bytes
lose nothing; rows with a NULL id take no part and stay whole; rows that repeat an id
are one document given several times, and each gets its result. Calling these
functions starts jobs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm.common import mix, query, table, text_bytes, texts_in_blocks, unused, written

WINDOW = 100
GRAM = 32
#: Bytes looked at together; places must fit into the low bits of a 64-bit number.
PLACE_BITS = 20
BLOCK = 1 << (PLACE_BITS - 1)
#: Bytes of text whose equal runs are merged before the shuffle.
MERGED = 1 << 23
#: Different runs of one anchor that are sorted together.
GROUP_LIMIT = 16384
#: Anchors that may be broadcast (8 bytes each); beyond it they are joined.
BROADCAST_LIMIT = 1 << 21

_BYTES = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full((1 << PLACE_BITS) + 1, base)
            table[0] = 1
            _powers[name] = np.cumprod(table)
    return _powers["up"], _powers["down"]


def _rolling(values: np.ndarray, width: int) -> np.ndarray:
    """The polynomial hash of every ``width`` neighbours, built from powers of two."""
    factor = lambda n: np.uint64(pow(int(_BASE), n, 1 << 64))
    done, have, h, size = None, 0, values, 1
    while True:
        if width & size:
            done = h if done is None else done[:len(h) - have] * factor(size) + h[have:]
            have += size
            done = done[:len(values) - have + 1]
        if have == width:
            return done
        h, size = h[:-size] * factor(size) + h[size:], size * 2


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        values, size = np.minimum(values[:-size], values[size:]), size * 2
    return np.minimum(values[:len(values) - (width - size)], values[width - size:]) if size < width else values


def _pieces(data: np.ndarray, bounds: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """Blocks of (row, first byte, end byte) below ``BLOCK`` bytes. A longer text is cut
    into parts that overlap by a window less one byte, so that each window is in one part."""
    block, size = [], 0
    for row, (begin, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        while end - begin >= WINDOW:
            stop = min(end, begin + BLOCK)
            if block and size + stop - begin > BLOCK:
                yield block
                block, size = [], 0
            block.append((row, begin, stop))
            size += stop - begin
            if stop == end:
                break
            begin = stop - WINDOW + 1
    if block:
        yield block


def runs_of(data: np.ndarray, bounds: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
    """The runs of the texts, a block at a time: ``a`` anchor, ``c`` hash of the run's text,
    ``row``, ``lo`` first byte in the text, ``nw`` windows; ``at`` is the first byte in ``bytes``."""
    up, down = _power_tables()
    mask = np.uint64((1 << PLACE_BITS) - 1)
    for block in _pieces(data, bounds):
        sizes = np.array([stop - begin for _, begin, stop in block])
        part = np.concatenate([data[begin:stop] for _, begin, stop in block])
        ends = np.cumsum(sizes)
        weights = _BYTES[part]
        grams = mix(_rolling(weights, GRAM))
        least = _least((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), WINDOW - GRAM + 1)
        owner = np.repeat(np.arange(len(block)), sizes)
        starts = np.flatnonzero(owner[:len(part) - WINDOW + 1] == owner[WINDOW - 1:])
        place = (least[starts] & mask).astype(np.int64)
        first = np.ones(len(starts), bool)
        # a gram in an overlap belongs to windows of two texts; the text is compared too
        first[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(first)
        nw = np.diff(np.append(first, len(starts)))
        at = starts[first]
        end = at + nw + WINDOW - 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weights * up[:len(part)])])
        text = mix((sums[end] - sums[at]) * down[at]) ^ mix(nw.astype(np.uint64))
        piece = owner[at]
        begins = np.array([begin for _, begin, _ in block])
        rows = np.array([row for row, _, _ in block])[piece]
        yield {"a": grams[place[first]].view(np.int64), "c": text.view(np.int64), "row": rows,
               "lo": at - (ends - sizes)[piece] + begins[piece] - bounds[rows], "nw": nw, "at": at, "bytes": part}


def _known(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.filter(batch.column(0).is_valid())


def _merged(a, c, ids, lo):
    """The order by (a, c, id, lo), whether a row is the first of its (a, c), and the first's index."""
    order = np.lexsort((lo, ids, c, a))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (a[order][1:] != a[order][:-1]) | (c[order][1:] != c[order][:-1])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    return order, fresh, first


def _packed(lo, nw):
    """First byte and windows of a run in one number, ordered by the first byte. The windows of a run share a gram, so they are fewer than 128."""
    return (lo << 8) + nw + 128


def _unpacked(place):
    return place >> 8, (place & 255) - 128


def _runs(batches, hot=None) -> Iterator[pa.RecordBatch]:
    """One row per run text and block; runs equal to an earlier one of the block come with their windows negated.

    With ``hot`` anchors: the single windows of their runs instead.
    """
    for batch in texts_in_blocks(map(_known, batches), 1, MERGED):
        ids = batch.column(0).to_numpy()
        found = list(_windows(runs_of(*text_bytes(batch.column(1))), hot.value) if hot else runs_of(*text_bytes(batch.column(1))))
        if not found:
            continue
        a, c, row, lo, nw = (np.concatenate([f[k] for f in found]) for k in ("a", "c", "row", "lo", "nw"))
        ids = ids[row]
        order, fresh, first = _merged(a, c, ids, lo)
        a, c, ids, lo, nw = a[order], c[order], ids[order], lo[order], nw[order]
        same = ~fresh & (ids == ids[first]) & (lo == lo[first])  # the same place of a repeated row
        # known repeats need no partner any more, so they are dealt out evenly
        spread = mix(ids.view(np.uint64) * np.uint64(31) + lo.view(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[~same]) for x in (np.where(fresh, a, spread), c, ids, _packed(lo, np.where(fresh, nw, -nw)))], ["a", "c", "id", "place"])


def _windows(runs, anchors: np.ndarray):
    for run in runs:
        taken = np.isin(run["a"], anchors)
        if taken.any():
            nw = run["nw"][taken]
            step = np.arange(nw.sum()) - np.repeat(np.cumsum(nw) - nw, nw)
            at = np.repeat(run["at"][taken], nw) + step
            window = mix(_rolling(_BYTES[run["bytes"]], WINDOW))[at].view(np.int64)
            yield {"a": window, "c": window, "row": np.repeat(run["row"][taken], nw),
                   "lo": np.repeat(run["lo"][taken], nw) + step, "nw": np.ones(len(at), np.int64)}


def _resolve(batches) -> Iterator[pa.RecordBatch]:
    """Reads runs in the order (a, c, id, place). Yields repeated runs (``a`` NULL), and the first
    run of each text where the anchor has several texts. Keeps one run between batches."""
    held = np.zeros((5, 0), np.int64)  # the first run of the last text so far
    told = False  # it has been yielded
    for batch in batches:
        *keys, place = (batch.column(i).to_numpy() for i in range(4))
        rows = np.stack([*keys, *_unpacked(place)])
        repeats = rows[:, rows[4] < 0]
        rows = np.concatenate([held, rows[:, rows[4] > 0]], axis=1)
        if rows.shape[1]:
            a, c, ids, lo, _ = rows
            fresh = np.ones(len(a), bool)
            fresh[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(a)), 0))
            later = ~fresh & ((ids != ids[first]) | (lo != lo[first]))
            firsts = rows[:, fresh]
            same = firsts[0][1:] == firsts[0][:-1]
            several = np.append(False, same) | np.append(same, False)
            out = several.copy()
            if told:
                out[0] = False
            told = bool(several[-1]) if len(several) > 1 or not told else told
            held = firsts[:, -1:]
            edges = firsts[:, out]
            repeats = np.concatenate([repeats, rows[:, later]], axis=1)
        else:
            edges = rows
        both = np.concatenate([repeats, edges], axis=1)
        if both.shape[1]:
            none = np.arange(both.shape[1]) < repeats.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[0], mask=none), pa.array(both[2]), pa.array(both[3]), pa.array(np.abs(both[4]))], ["a", "id", "lo", "nw"])


def _contents(batches, anchors=None) -> Iterator[pa.RecordBatch]:
    """The texts of runs, once per block; only of the given anchors if they were broadcast."""
    for batch in texts_in_blocks(map(_known, batches), 1, MERGED):
        ids = batch.column(0).to_numpy()
        for run in runs_of(*text_bytes(batch.column(1))):
            own = ids[run["row"]]
            order, fresh, _ = _merged(run["a"], run["c"], own, run["lo"])
            taken = order[fresh]
            if anchors is not None:
                known = anchors.value
                near = np.minimum(np.searchsorted(known, run["a"][taken]), len(known) - 1)
                taken = taken[known[near] == run["a"][taken]]
            if not len(taken):
                continue
            raw = run["bytes"].tobytes()
            at, nw = run["at"][taken].tolist(), run["nw"][taken].tolist()
            texts = [raw[p:p + n + WINDOW - 1] for p, n in zip(at, nw)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(run["a"][taken]), pa.array(own[taken]), pa.array(run["lo"][taken]), pa.array(texts, pa.binary())], ["a", "id", "lo", "run"])


def _sorted_suffixes(groups: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """The suffixes that start a window which other suffixes of the group start too, in sorted order: their text, their
    first byte in it, the byte before it (256: none), and the prefix in common with the next one (0: none).

    A window that the same byte precedes everywhere is left out; the one that starts there says more.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes) - sizes
    nw = sizes - WINDOW + 1
    text = np.repeat(np.arange(len(texts)), nw)
    offset = np.arange(len(text)) - np.repeat(np.cumsum(nw) - nw, nw)
    at = begins[text] + offset
    key = mix(_rolling(_BYTES[data], WINDOW))[at] ^ mix(groups[text].view(np.uint64))
    before = np.where(offset > 0, data[at - 1].astype(np.int64), 256)
    order = np.argsort(key, kind="stable")
    key, before = key[order], before[order]
    cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    many = np.diff(np.append(cuts, len(key)))
    low, high = np.minimum.reduceat(before, cuts), np.maximum.reduceat(before, cuts)
    open_left = np.repeat((many > 1) & ((low != high) | (high == 256)), many)
    order, key, before = order[open_left], key[open_left], before[open_left]
    if not len(order):
        return order, order, [], []
    # The suffixes of equal first windows, sorted by what follows the window.
    tail = WINDOW - GRAM + 1
    follow = at[order][:, None] + WINDOW + np.arange(tail)
    length = begins[text[order]] + sizes[text[order]] - at[order] - WINDOW
    tails = np.where(np.arange(tail) < length[:, None], data[np.minimum(follow, len(data) - 1)], 0).astype(np.uint8)
    ranked = np.lexsort((np.ascontiguousarray(tails).view(f"S{tail}").ravel(), key))
    key, before, length, tails, order = key[ranked], before[ranked], length[ranked], tails[ranked], order[ranked]
    equal = tails[1:] == tails[:-1]
    common = np.where(equal.all(axis=1), tail, np.argmin(equal, axis=1))
    common = WINDOW + np.minimum(common, np.minimum(length[1:], length[:-1]))
    common = np.append(np.where(key[1:] == key[:-1], common, 0), 0)
    return text[order], offset[order], before.tolist(), common.tolist()


def _intervals(before: list[int], common: list[int]) -> Iterator[tuple[int, int, int]]:
    """The intervals of sorted suffixes that are maximal repeats, as (length, first, last), inner ones before outer ones."""
    # A stack entry: [common prefix, first index, the one byte before all its occurrences or 256].
    stack: list[list[int]] = []
    for i, depth in enumerate(common):
        begin, byte = i, before[i]
        while stack and stack[-1][0] > depth:
            size, begin, other = stack.pop()
            byte = byte if byte == other else 256
            if byte == 256:
                yield size, begin, i
            if stack and stack[-1][0] >= depth:
                stack[-1][2] = byte if byte == stack[-1][2] else 256
        if depth and (not stack or stack[-1][0] < depth):
            stack.append([depth, begin, byte])
        elif depth and stack[-1][2] != byte:
            stack[-1][2] = 256


def maximal_repeats(groups: np.ndarray, ids: np.ndarray, lo: np.ndarray, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeats among the texts of each group, as (length, occurrences by (id, first byte)).

    Texts of a group are compared from their window starts on, ``WINDOW`` bytes
    at least; what precedes a text is taken to differ. All occurrences of all
    nested repeats can be many more than the texts: :func:`repeated_stretches`
    has what a removal needs.
    """
    text, offset, before, common = _sorted_suffixes(groups, texts)
    places = list(zip(ids[text].tolist(), (lo[text] + offset).tolist()))
    for size, first, last in _intervals(before, common):
        yield size, places[first:last + 1]


def repeated_stretches(groups: np.ndarray, ids: np.ndarray, lo: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text that holds a maximal repeat which starts earlier elsewhere: its id, and first byte and length of the
    stretch that such repeats cover. All windows of a text hold its anchor, so it is one stretch.

    A suffix counts with the longest interval in which it is not the earliest. Intervals come inner ones first; each
    settles all its open suffixes but the earliest, which stays open for the outer ones, so every suffix is settled once.
    """
    text, offset, before, common = _sorted_suffixes(groups, texts)
    place = lo[text] + offset
    rank = np.empty(len(text), np.int64)
    rank[np.lexsort((place, ids[text]))] = np.arange(len(text))
    rank = rank.tolist()
    longest = [0] * len(text)
    later = list(range(len(text) + 1))  # the next open suffix from here on, or a step towards it
    for size, first, last in _intervals(before, common):
        least, i = -1, first
        while True:
            start = i
            while later[i] != i:
                i = later[i]
            while later[start] != i:
                start, later[start] = later[start], i
            if i > last:
                break
            if least < 0 or rank[i] < rank[least]:
                settled, least = least, i
            else:
                settled = i
            if settled >= 0:
                longest[settled], later[settled] = size, settled + 1
            i += 1
    length = np.array(longest, np.int64)
    found = np.flatnonzero(length)
    begin, end = np.full(len(texts), np.iinfo(np.int64).max), np.zeros(len(texts), np.int64)
    np.minimum.at(begin, text[found], place[found])
    np.maximum.at(end, text[found], (place + length)[found])
    held = np.flatnonzero(end)
    return ids[held], begin[held], (end - begin)[held]


def _spans(batches) -> Iterator[pa.RecordBatch]:
    """Reads runs by anchor; yields at most one stretch for each."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush(rows: pa.Table):
        rows = rows.combine_chunks()
        keys = np.stack([rows.column(i).to_numpy() for i in range(3)])
        fresh = np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))  # repeated rows give a place several times
        rows, args = rows.filter(pa.array(fresh)), keys[:, fresh]
        found = repeated_stretches(*args, rows.column(3).to_pylist())
        if len(found[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["id", "lo", "length"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= 4096:
            rows = pa.Table.from_batches(held)
            a = rows.column(0).to_numpy()
            cut = int(np.searchsorted(a, a[-1]))  # the last anchor may go on
            if cut:
                yield from flush(rows.slice(0, cut))
            held, size = rows.slice(cut).to_batches(), rows.num_rows - cut
    if held:
        yield from flush(pa.Table.from_batches(held))


def repeated_spans(df: DataFrame, id: str = "doc_id", text: str = "text", group_limit: int = GROUP_LIMIT,
                   broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(id, lo, length): the stretches of bytes that start earlier elsewhere; they may overlap."""
    spark = df.sparkSession
    texts = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    schema = "a long, c long, id long, place long"

    def resolved(runs: DataFrame) -> DataFrame:
        return runs.repartition("a").sortWithinPartitions("a", "c", "id", "place").mapInArrow(_resolve, "a long, id long, lo long, nw long")

    found = written(resolved(texts.mapInArrow(_runs, schema)))
    anchors = written(found.where("a is not null").groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    hot = anchors.where(F.col("n") > group_limit).select("a")
    several = anchors.where(F.col("n") <= group_limit).select("a")
    out = found.where("a is null").select("id", "lo", (F.col("nw") + WINDOW - 1).alias("length"))

    kinds = "a long, id long, lo long, run binary"
    if anchors.count() <= broadcast_limit:
        known = np.sort(several.toArrow().column("a").to_numpy())
        if len(known):
            contents = texts.mapInArrow(partial(_contents, anchors=spark.sparkContext.broadcast(known)), kinds)
        else:
            contents = None
    else:
        contents = texts.mapInArrow(_contents, kinds).join(several, "a", "left_semi")
    if contents is not None:
        # copies of a run's text from other blocks are known to be repeated: only the first one is compared with others
        firsts = found.where("a is not null").select("a", "id", "lo")
        contents = contents.join(firsts, ["a", "id", "lo"], "left_semi").select("a", "id", "lo", "run")
        sorted_runs = contents.repartition("a").sortWithinPartitions("a", "id", "lo")
        out = out.union(sorted_runs.mapInArrow(_spans, "id long, lo long, length long"))

    hot_anchors = hot.toArrow().column("a").to_numpy()  # each stands for more than group_limit runs
    if len(hot_anchors):
        windows = texts.mapInArrow(partial(_runs, hot=spark.sparkContext.broadcast(hot_anchors)), schema)
        out = out.union(resolved(windows).where("a is null").select("id", "lo", F.lit(WINDOW).cast("long").alias("length")))
    return out


def _cut(batches, text: str, whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in texts_in_blocks(batches, text):
        at = batch.schema.get_field_index(text)
        data, bounds = text_bytes(batch.column(at))
        spans = batch.column(batch.num_columns - 1)
        kept, figures = [], []
        for row in range(batch.num_rows):
            raw = data[bounds[row]:bounds[row + 1]]
            n = len(raw)
            removed = n_spans = 0
            if spans[row].is_valid:
                pairs = spans.slice(row, 1).flatten()
                lo = pairs.field(0).to_numpy()
                hi = np.minimum(lo + pairs.field(1).to_numpy(), n)
                change = np.bincount(np.minimum(lo, n), minlength=n + 1) - np.bincount(hi, minlength=n + 1)
                gone = np.cumsum(change[:n]) > 0
                removed, n_spans = int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum())
                raw = raw[~gone]
            raw = raw.tobytes()
            kept.append(raw if whole else None)
            figures.append((n, removed, n_spans, hashlib.sha256(raw).hexdigest()))
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        if whole:
            texts = [k.decode("utf-8", "ignore") if v.is_valid else None for k, v in zip(kept, batch.column(at))]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
        else:
            columns.pop(at)
        n, removed, n_spans, digest = zip(*figures) if figures else ((), (), (), ())
        columns += [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string())]
        names = [f for f in batch.schema.names[:-1] if whole or f != text]
        yield pa.RecordBatch.from_arrays(columns, [*names, "n_bytes", "n_removed", "n_spans", "kept_sha256"][:len(columns)])


def remove_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", keep_text: bool = True, **limits: int) -> DataFrame:
    """Each row with what stays of its text (characters that were cut through go),
    and n_bytes, n_removed, n_spans and kept_sha256 of the bytes that stay.

    Columns of ``df`` that have the names of these figures are replaced.
    """
    figures = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    df = df.drop(*[f for f in figures if f not in (id, text)])
    spans = repeated_spans(df, id, text, **limits)
    own, found = unused(df.columns, "span_id"), unused([*df.columns, "span_id"], "spans")
    by_row = spans.groupBy(F.col("id").alias(own)).agg(F.collect_list(F.struct("lo", "length")).alias(found))
    joined = df.join(by_row, F.col(id).cast("long") == F.col(own), "left").drop(own)
    fields = [f for f in df.schema.fields if keep_text or f.name != text]
    out = T.StructType([*fields, *[T.StructField(f, T.LongType() if f != "kept_sha256" else T.StringType()) for f in figures]])
    return joined.mapInArrow(partial(_cut, text=text, whole=keep_text), out)


OP6_SQL = """
with raw as (
  select doc_id, encode(coalesce(text, '')) as b from documents),
starts as (
  select doc_id, i, array_slice(b, i, i + 99) as w
  from (select doc_id, b, unnest(range(1, octet_length(b) - 98)) as i from raw where octet_length(b) >= 100)),
later as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by w order by doc_id, i) as n from starts) where n > 1),
marked as (
  select doc_id, i, coalesce(i - lag(i) over (partition by doc_id order by i) > 100, true) as opens from later),
numbered as (
  select doc_id, i, sum(cast(opens as int)) over (partition by doc_id order by i) as span from marked),
spans as (
  select doc_id, min(i) as first, max(i) + 99 as last from numbered group by doc_id, span),
gaps as (
  select doc_id, first, last, coalesce(lag(last) over (partition by doc_id order by first), 0) as done from spans),
left_over as (
  select doc_id, count(*) as n_spans, sum(last - first + 1) as n_removed, max(last) as done,
         string_agg(hex(array_slice(b, done + 1, first - 1)), '' order by first) as kept
  from gaps join raw using (doc_id) group by doc_id)
select doc_id, cast(octet_length(b) as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       cast(coalesce(n_spans, 0) as bigint) as n_spans,
       case when done is null then sha256(b)
            else sha256(unhex(kept || hex(array_slice(b, done + 1, octet_length(b))))) end as kept_sha256
from raw left join left_over using (doc_id)
"""


@query("op6_suffix_dedup", OP6_SQL)
def op6_suffix_dedup(spark, sf_dir):
    """What is left of every document without the bytes in 100-byte strings that start earlier."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(documents, keep_text=False)
