"""Sampled segmentation into the pieces of a SentencePiece model, and its inverse.

Every way to cut a text into pieces is a path through a lattice; a path's weight is the
product of its pieces' weights, ``(2 + rank) ** -alpha`` by the model's order of
pieces. Forward filtering sums the weights of all paths up to each place, and
backward sampling walks from the end, taking each piece with the probability
that these sums give. The random numbers are a hash of the row's key, the seed and the place
in the text, so a row has the same segmentation in whatever batch, partition or
attempt it is cut.

No piece holds a word boundary (a meta symbol after another character), so the
lattice falls apart into words; equal words of a block share their sums, and
all words advance together, as array operations. Long words, such as texts without
blanks, fall apart further, at places that no piece of the model crosses there: all paths
pass them, so chances and draws stay the same. A character without a piece,
the meta symbol itself included, becomes the bytes of its UTF-8 form, so
decoding returns every text unchanged.

Defined results: NULL texts have NULL pieces, empty ones an empty list; a NULL
key counts as 0; repeated rows with equal keys are cut alike.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm.common import mix, query, table, texts_in_blocks

MODEL = public_tokenizers.path("piece_bpe_32k.model")
META = 0x2581
#: Stands for a literal meta symbol of a text; no code point of Unicode.
LITERAL = 0x110000
BLOCK = 1 << 19
#: Words above this length are looked through for places that no piece crosses.
LONG = 48
#: Weight of a character written as bytes.
BYTES_WEIGHT = 1e-6
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _key(text: str) -> int:
    key = 0
    for c in text:
        key = (key * int(_BASE) + ord(c) + 1) % (1 << 64)
    return key


class Pieces:
    """The pieces of a model, found by a hash of their characters."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        self.surface, self.byte_ids = [b""] * count, np.zeros(256, np.int64)
        names, ids, ranks = [], [], []
        for i in range(count):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(name[3:5], 16)
                self.byte_ids[value], self.surface[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if name.lstrip("▁").find("▁") >= 0:
                    raise ValueError("a piece holds a word boundary")
                self.surface[i] = name.replace("▁", " ").encode()
                names.append(name)
                ids.append(i)
                ranks.append(-model.get_score(i))
        self.longest = max(map(len, names))
        keys = np.array([_key(name) for name in names], np.uint64)
        weights = (2.0 + np.array(ranks)) ** -alpha
        # open addressing, in a table with eight places for each piece
        size = 1 << (8 * len(names)).bit_length()
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.keys, self.ids, self.weights = np.zeros(size, np.uint64), np.zeros(size, np.int32), np.zeros(size)
        for key, slot, i, w in zip(keys.tolist(), (keys * _BASE >> self.shift).tolist(), ids, weights.tolist()):
            while self.keys[slot]:
                slot = (slot + 1) % size
            self.keys[slot], self.ids[slot], self.weights[slot] = key, i, w
        self.lengths = np.array([len(s) for s in self.surface])
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.surface), np.uint8)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the hashed strings are pieces, their ids and weights."""
        slot = (keys * _BASE >> self.shift).astype(np.int64)
        found = self.keys[slot]
        hit = found == keys
        at, where = [np.flatnonzero(hit)], [slot[hit]]
        left = np.flatnonzero(~hit & (found != 0))
        slot = slot[left]
        while len(left):  # another piece is in the place
            slot = (slot + 1) & (len(self.ids) - 1)
            found = self.keys[slot]
            hit = found == keys[left]
            at.append(left[hit])
            where.append(slot[hit])
            more = ~hit & (found != 0)
            left, slot = left[more], slot[more]
        where = np.concatenate(where)
        return np.concatenate(at), self.ids[where], self.weights[where]


@functools.lru_cache(maxsize=4)
def pieces_of(path: str, alpha: float) -> Pieces:
    return Pieces(path, alpha)


def _words(points: np.ndarray, row_starts: np.ndarray) -> np.ndarray:
    """Where words begin: at the first of a run of meta symbols, and at each row."""
    first = points == META
    first[1:] &= points[:-1] != META
    first[row_starts] = True
    return np.flatnonzero(first)


def _uncrossed(pieces: Pieces, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places within long words before which every path has a border."""
    sizes = np.diff(np.append(starts, len(points)))
    long = sizes > LONG
    if not long.any():
        return starts[:0]
    sizes = sizes[long]
    begins = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(begins, sizes)
    at = np.repeat(starts[long], sizes) + place
    letters = points[at].astype(np.uint64) + np.uint64(1)
    keys, crossings = letters, np.zeros(len(at) + 1, np.int32)
    for length in range(2, pieces.longest + 1):
        # the strings that end at each place; those that begin in another word are left out
        keys = letters + np.append(np.uint64(0), keys[:-1]) * _BASE
        ends = np.flatnonzero(place >= length - 1)
        ends = ends[pieces.find(keys[ends])[0]]
        crossings[ends - length + 2] += 1  # of one length no two ends are equal
        crossings[ends + 1] -= 1
    return at[(np.cumsum(crossings[:-1]) == 0) & (place > 0)]


def _lattice(pieces: Pieces, points: np.ndarray, levels: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the cumulative chances of the length of the piece that ends there, and the piece by length.

    Places are in levels: first the first characters of all words, longest word first, then the
    second characters of the ``counts[1]`` words that have one, and so on.
    """
    n, most, depth = len(points), pieces.longest, len(counts)
    weight, ids = np.zeros((most, n)), np.full((n, most), -1, np.int32)
    keys = np.zeros(n, np.uint64)
    letters = points.astype(np.uint64) + np.uint64(1)
    for length in range(1, min(most, depth) + 1):
        # the strings that end at each place, one character longer than before
        longer = keys if length > 1 else None
        keys = letters.copy()
        if longer is not None:
            for j in range(length - 1, depth):
                keys[levels[j]:levels[j] + counts[j]] += longer[levels[j - 1]:levels[j - 1] + counts[j]] * _BASE
        begin = int(levels[length - 1])
        at, found, w = pieces.find(keys[begin:])
        ids[begin + at, length - 1], weight[length - 1, begin + at] = found, w
    alone = ids[:, 0] < 0
    weight[0, alone] = BYTES_WEIGHT
    # forward sums, one level after the other; sums[j] is that before the characters of level j
    sums = [np.ones(counts[0])]
    for j in range(depth):
        here = slice(int(levels[j]), int(levels[j]) + int(counts[j]))
        total = np.zeros(counts[j])
        for length in range(1, min(j + 1, most) + 1):
            weight[length - 1, here] *= sums[j + 1 - length][:counts[j]]
            total += weight[length - 1, here]
        sums.append(total)
        if j >= most:
            sums[j - most] = None
        if j % 16 == 15:  # only ratios count, so what the next levels look at is kept near one
            for back in range(max(0, j + 2 - most), j + 2):
                sums[back] = sums[back][:counts[j]] / total
    for length in range(1, most):
        weight[length] += weight[length - 1]
    weight /= weight[-1]
    # in full width, as the draws are: rounded ones would reach the last chance, which is exactly one
    return np.ascontiguousarray(weight.T), ids


def sample(pieces: Pieces, texts: list[str], keys: np.ndarray, seed: int) -> list[np.ndarray]:
    """The pieces of each text."""
    raw = [np.frombuffer((" " + t).encode("utf-32-le"), np.uint32) if t else np.zeros(0, np.uint32) for t in texts]
    counts = np.array([len(r) for r in raw], np.int64)
    if not counts.sum():
        return [np.zeros(0, np.int32) for _ in texts]
    points = np.concatenate(raw).astype(np.int64)
    points[points == META] = LITERAL
    points[points == 32] = META
    row_starts = np.cumsum(counts) - counts
    starts = _words(points, row_starts[counts > 0])
    starts = np.sort(np.concatenate([starts, _uncrossed(pieces, points, starts)]))
    sizes = np.diff(np.append(starts, len(points)))
    # equal words are weighed once
    word = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(len(points)) - starts[word]
    powers = np.full(int(sizes.max()), _BASE)
    powers[0] = 1
    hashes = mix(np.add.reduceat(mix(points.astype(np.uint64)) * np.cumprod(powers)[place], starts)) + sizes.astype(np.uint64)
    _, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
    by_size = np.argsort(-sizes[first], kind="stable")
    rank = np.empty(len(first), np.int64)
    rank[by_size] = np.arange(len(first))
    first, kind = first[by_size], rank[kind]
    counts_by_level = np.searchsorted(-sizes[first], -np.arange(int(sizes.max())))  # words longer than each level
    levels = np.cumsum(counts_by_level) - counts_by_level
    level = np.repeat(np.arange(len(levels)), counts_by_level)
    taken = starts[first][np.arange(counts_by_level.sum()) - levels[level]] + level
    chances, ids = _lattice(pieces, points[taken], levels, counts_by_level)
    # all words walk back together, each from its end
    row = np.repeat(np.arange(len(texts)), counts)
    stream = mix(keys.astype(np.int64).view(np.uint64) + mix(np.array([seed], np.int64).view(np.uint64))[0])
    out = np.full(len(points), -1, np.int64)
    active, left = np.arange(len(starts)), sizes.copy()
    while len(active):
        end = starts[active] + left - 1
        rows = row[end]
        number = mix(stream[rows] + (end - row_starts[rows]).astype(np.uint64) * _BASE)
        u = (number >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
        node = levels[left - 1] + kind[active]
        length = (chances[node] <= u[:, None]).sum(axis=1) + 1
        piece = ids[node, length - 1]
        out[end] = np.where(piece < 0, -2, piece)
        left = left - length
        active, left = active[left > 0], left[left > 0]
    return _expanded(pieces, points, out, row, len(texts))


def _expanded(pieces: Pieces, points: np.ndarray, out: np.ndarray, row: np.ndarray, rows: int) -> list[np.ndarray]:
    """The pieces by row, characters without one as bytes."""
    at = np.flatnonzero(out != -1)
    found, row = out[at], row[at]
    strange = np.flatnonzero(found == -2)
    if len(strange):
        codes = points[at[strange]]
        raw = [chr(META if c == LITERAL else 32 if c == META else c).encode("utf-8", "surrogatepass") for c in codes.tolist()]
        many = np.ones(len(found), np.int64)
        many[strange] = [len(r) for r in raw]
        begin = np.cumsum(many) - many
        row, found = np.repeat(row, many), np.repeat(found, many)
        values = np.frombuffer(b"".join(raw), np.uint8)
        places = np.repeat(begin[strange] - (np.cumsum(many[strange]) - many[strange]), many[strange]) + np.arange(len(values))
        found[places] = pieces.byte_ids[values]
    ends = np.cumsum(np.bincount(row, minlength=rows))
    return np.split(found.astype(np.int32), ends[:-1])


def decode(pieces: Pieces, ids: np.ndarray) -> str:
    """The text of pieces; the blank that encoding puts before a text goes."""
    if not len(ids):
        return ""
    lengths = pieces.lengths[ids]
    at = np.repeat(pieces.offsets[ids] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    return pieces.bytes[at].tobytes()[1:].decode("utf-8", "surrogatepass")


def _keys(column: pa.Array) -> np.ndarray:
    if pa.types.is_integer(column.type):
        return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    return np.array([0 if v is None else zlib.crc32(str(v).encode()) for v in column.to_pylist()], np.int64)


def _encode(batches, key, text, into, model, alpha, seed, verified) -> Iterator[pa.RecordBatch]:
    pieces = pieces_of(model, alpha)
    for block in texts_in_blocks(batches, text, BLOCK):
        values = block.column(block.schema.get_field_index(text)).to_pylist()
        keys = _keys(block.column(block.schema.get_field_index(key)))
        found = sample(pieces, [v or "" for v in values], keys, seed)
        sizes = np.array([len(f) for f in found])
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(0, np.cumsum(sizes)), pa.int32(), mask=np.append([v is None for v in values], False)), pa.array(np.concatenate(found)))
        columns, names = [*block.columns, lists], [*block.schema.names, into]
        if verified:
            columns.append(pa.array([decode(pieces, f) == (v or "") for f, v in zip(found, values)]))
            names.append(verified)
        yield pa.RecordBatch.from_arrays(columns, names)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", into: str = "pieces", model: str = MODEL, alpha: float = 1.0, seed: int = 0,
           verified: str | None = None) -> DataFrame:
    """``df`` with ``into``: one sampled segmentation of ``text``, seeded by ``key``.

    A larger ``alpha`` favours common and few pieces. ``verified`` names a column that tells
    whether decoding the pieces returns the text, found out where they are made.
    """
    df = df.drop(*[c for c in (into, verified) if c and c not in (key, text)])
    added = [T.StructField(into, T.ArrayType(T.IntegerType())), *([T.StructField(verified, T.BooleanType())] if verified else [])]
    run = partial(_encode, key=key, text=text, into=into, model=model, alpha=alpha, seed=seed, verified=verified)
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def _decode(batches, column, into, model) -> Iterator[pa.RecordBatch]:
    pieces = pieces_of(model, 1.0)
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index(column))
        texts = [decode(pieces, lists.slice(i, 1).flatten().to_numpy()) if lists[i].is_valid else None for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, into])


def decoded(df: DataFrame, column: str = "pieces", into: str = "decoded", model: str = MODEL) -> DataFrame:
    """``df`` with the texts of its pieces."""
    df = df.drop(into) if into != column else df
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.StringType())])
    return df.mapInArrow(partial(_decode, column=column, into=into, model=model), schema)


@query("op7_piece_sampling")
def op7_piece_sampling(spark, sf_dir):
    """A sampled segmentation of every document, and whether decoding returns the text."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = encode(documents, verified="lossless")
    return cut.select("doc_id", "pieces", F.size("pieces").cast("long").alias("n_pieces"), "lossless")
