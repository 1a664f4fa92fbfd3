"""Fill-in-the-middle documents, cut and rearranged as piece tables.

A document is never spliced as a string. It is a *piece table*: a list of
descriptors (buffer, begin, end) over buffers that do not change, the bytes of
its text and one buffer per sentinel. Cutting splits a descriptor, an
arrangement is a permutation of descriptors with sentinels before them, hashes
read the descriptors one after the other, and only the text that is asked for
is put together at the end. Restoring is the same with the roles exchanged: the
output is the buffer, its sentinels give the cuts, and the inverse permutation
brings the descriptors back.

A text is cut into units (lines by default); prefix, middle and suffix are runs
of whole units, chosen by a hash of the seed and the row key, so the result
depends on no partition and no order. No sentinel overlaps itself or another one,
therefore the first occurrence of each in an output is the one that was set, as
long as the text holds none; such texts stay plain, as do empty ones.

Defined results: a NULL text counts as empty; a NULL key counts as an empty key;
rows that repeat a key are cut alike if their texts are alike. A column of the
input that has the name of a result is replaced. Rows are independent of each
other: there is no shuffle, and a worker holds one text of any length at a time,
with about :data:`callscope.llm.common.TEXT_BLOCK` bytes of further texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm.common import query, table, texts_in_blocks, unused

#: Buffer names of the sentinels, and of the text.
PREFIX, SUFFIX, MIDDLE, TEXT = "prefix", "suffix", "middle", "text"
#: What each form writes, by the part of the document: prefix 0, middle 1, suffix 2.
FORMS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
PLAIN = "plain"
_MARK_OF_PART = (PREFIX, MIDDLE, SUFFIX)


class Piece(NamedTuple):
    """Bytes ``begin`` to ``end`` of a buffer."""

    buffer: str
    begin: int
    end: int


@dataclass(frozen=True)
class Settings:
    """How documents are cut. ``rate`` and ``spm`` are percentages."""

    seed: str = "7"
    rate: int = 100
    spm: int = 50
    unit: str = "[^\\n]*\\n|[^\\n]+"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = [m.encode() for m in (self.prefix, self.suffix, self.middle)]
        for one in marks:
            for other in marks:
                shared = any(one[-n:] == other[:n] for n in range(1, min(len(one), len(other)) + (one is not other)))
                if not one or shared or (one is not other and one in other):
                    raise ValueError("sentinels must be non-empty and must not overlap each other or themselves")

    def buffers(self) -> dict[str, bytes]:
        return {PREFIX: self.prefix.encode(), SUFFIX: self.suffix.encode(), MIDDLE: self.middle.encode()}


class PieceTable:
    """Descriptors over immutable buffers."""

    def __init__(self, buffers: dict[str, bytes], pieces: Iterable[Piece]):
        self.buffers = buffers
        self.pieces = list(pieces)

    def cut(self, *places: int) -> PieceTable:
        """The same bytes with a border at each of the ascending places, also where a part is empty."""
        out: list[Piece] = []
        left, done = list(reversed(self.pieces)), 0
        for place in places:
            before = len(out)
            while left and done + left[-1].end - left[-1].begin <= place:
                piece = left.pop()
                out.append(piece)
                done += piece.end - piece.begin
            if done < place:
                name, begin, end = left.pop()
                out.append(Piece(name, begin, begin + place - done))
                left.append(Piece(name, begin + place - done, end))
                done = place
            if len(out) == before:
                out.append(Piece(TEXT, 0, 0))
        return PieceTable(self.buffers, [*out, *(reversed(left) if left else [Piece(TEXT, 0, 0)])])

    def arranged(self, order: Iterable[int], marks: Iterable[str] = ()) -> PieceTable:
        """The pieces in another order, each with the sentinel of that name before it."""
        moved = [self.pieces[i] for i in order]
        names = list(marks) or [None] * len(moved)
        return PieceTable(self.buffers, [
            p for name, piece in zip(names, moved)
            for p in ([Piece(name, 0, len(self.buffers[name]))] if name else []) + [piece]])

    def chunks(self) -> Iterator[memoryview]:
        views = {name: memoryview(data) for name, data in self.buffers.items()}
        for name, begin, end in self.pieces:
            yield views[name][begin:end]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for chunk in self.chunks():
            digest.update(chunk)
        return digest.hexdigest()

    def bytes(self) -> bytes:
        return b"".join(self.chunks())


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    """The permutation that undoes ``order``."""
    out = [0] * len(order)
    for place, part in enumerate(order):
        out[part] = place
    return tuple(out)


def draws(seed: str, key: str) -> tuple[int, int, int, int]:
    """The first four 32-bit numbers of the hash of seed and row key."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digest[8 * i:8 * i + 8], 16) for i in range(4))


def unit_ends(text: str, raw: bytes, unit: re.Pattern) -> list[int]:
    """Byte places where the units of a text end."""
    if unit.pattern == Settings.unit:  # lines: the bytes tell
        ends = [m.end() for m in re.finditer(b"\n", raw)]
        return ends if not raw or raw.endswith(b"\n") else [*ends, len(raw)]
    ends, done, size = [], 0, 0
    for m in unit.finditer(text):
        size += len(text[done:m.end()].encode())
        done = m.end()
        ends.append(size)
    return ends


def arrange(key: str, raw: bytes, settings: Settings, unit: re.Pattern) -> tuple[str, int, PieceTable, tuple[int, int] | None]:
    """The form of a document, its number of units, its piece table, and the places of the cuts (None if plain)."""
    buffers = settings.buffers()
    whole = PieceTable({TEXT: raw, **buffers}, [Piece(TEXT, 0, len(raw))])
    ends = unit_ends(raw.decode("utf-8", "replace") if unit.pattern != Settings.unit else "", raw, unit)
    n = len(ends)
    h1, h2, h3, h4 = draws(settings.seed, key)
    if not raw or h3 % 100 >= settings.rate or any(mark in raw for mark in buffers.values()):
        return PLAIN, n, whole, None
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = (ends[k - 1] if k else 0 for k in (low, high))
    form = "spm" if h4 % 100 < settings.spm else "psm"
    order = FORMS[form]
    return form, n, whole.cut(first, second).arranged(order, [_MARK_OF_PART[p] for p in order]), (first, second)


def restored(output: bytes, form: str, settings: Settings) -> PieceTable:
    """The document's piece table over the bytes of an output."""
    buffers = {TEXT: output, **settings.buffers()}
    if form == PLAIN:
        return PieceTable(buffers, [Piece(TEXT, 0, len(output))])
    order, places, at = FORMS[form], [], 0
    for part in order:
        mark = buffers[_MARK_OF_PART[part]]
        begin = output.index(mark, at)
        at = begin + len(mark)
        places += [begin, at]
    pieces = PieceTable(buffers, [Piece(TEXT, 0, len(output))]).cut(*places).pieces
    # every second piece from the third on is a part, the others are what precedes the first mark and the marks
    return PieceTable(buffers, pieces[2::2]).arranged(inverse(order))


_TABLE = T.ArrayType(T.StructType([T.StructField("buffer", T.StringType(), False), T.StructField("begin", T.LongType(), False),
                                   T.StructField("end", T.LongType(), False)]), False)
_ADDED = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()),
          ("output", T.StringType()), ("output_sha256", T.StringType()), ("restored_sha256", T.StringType()), ("pieces", _TABLE)]


def _chars(raw: bytes) -> int:
    return len(raw.decode("utf-8", "replace"))


def _transformed(batches, text: str, settings: Settings, keep: tuple[str, ...], added: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    unit = re.compile(settings.unit)
    for batch in texts_in_blocks(batches, text):
        out: dict[str, list] = {name: [] for name in added}
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        for key, value in zip(batch.column(batch.num_columns - 1), column):
            raw = value.as_py() or b""
            form, n, pieces, places = arrange(key.as_py() or "", raw, settings, unit)
            output = pieces.bytes()
            row = {"n": n, "form": form, "output": output, "output_sha256": pieces.sha256(),
                   "restored_sha256": restored(output, form, settings).sha256(), "pieces": [p._asdict() for p in pieces.pieces],
                   "prefix_chars": None if places is None else _chars(raw[:places[0]]),
                   "middle_chars": None if places is None else _chars(raw[places[0]:places[1]])}
            for name in added:
                out[name].append(row[name])
        arrays = [batch.column(batch.schema.get_field_index(name)) for name in keep]
        for name in added:
            if name == "output":
                arrays.append(pa.array([v.decode("utf-8", "replace") for v in out[name]], pa.string()))
            elif name == "pieces":
                arrays.append(pa.array(out[name], pa.list_(pa.struct([("buffer", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))))
            else:
                arrays.append(pa.array(out[name], pa.int64() if dict(_ADDED)[name] == T.LongType() else pa.string()))
        yield pa.RecordBatch.from_arrays(arrays, [*keep, *added])


def fill_in_middle(df: DataFrame, key: str | Column = "doc_id", text: str = "text", settings: Settings = Settings(),
                   columns: Iterable[str] = tuple(name for name, _ in _ADDED)) -> DataFrame:
    """Rows with their documents rearranged for infilling.

    Adds, of the names in ``columns``: ``n`` units, ``form`` (``plain``, ``psm`` or ``spm``), ``prefix_chars`` and
    ``middle_chars`` (code points; NULL if plain), ``output`` (the rearranged text), ``output_sha256``,
    ``restored_sha256`` (of the text that is rebuilt from output and form, equal to the text's own), and ``pieces``
    (the descriptors of the output over the UTF-8 bytes of the text and the sentinels).
    ``key`` names or is what tells a document from the others; it enters the hash as text.
    """
    wanted = set(columns)
    if wanted - {name for name, _ in _ADDED}:
        raise ValueError(f"unknown columns {sorted(wanted - {name for name, _ in _ADDED})}")
    added = tuple(name for name, _ in _ADDED if name in wanted)
    keep = tuple(c for c in df.columns if c not in added)
    own = (F.col(key) if isinstance(key, str) else key).cast("string")
    rows = df.select(*df.columns, own.alias(unused(df.columns, "key")))
    schema = T.StructType([*[df.schema[c] for c in keep], *[T.StructField(n, t) for n, t in _ADDED if n in wanted]])
    return rows.mapInArrow(partial(_transformed, text=text, settings=settings, keep=keep, added=added), schema)


def _restored(batches, output: str, form: str, settings: Settings, keep: tuple[str, ...], into: str) -> Iterator[pa.RecordBatch]:
    for batch in texts_in_blocks(batches, output):
        names = batch.schema.names
        pairs = zip(batch.column(names.index(output)).cast(pa.large_binary()), batch.column(names.index(form)))
        texts = [restored(o.as_py(), f.as_py(), settings).bytes().decode("utf-8", "replace") if o.is_valid and f.is_valid else None for o, f in pairs]
        yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in keep], pa.array(texts, pa.string())], [*keep, into])


def restore(df: DataFrame, output: str = "output", form: str = "form", into: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The documents behind rearranged texts, in column ``into``; NULL where output or form is NULL."""
    keep = tuple(c for c in df.columns if c != into)
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(into, T.StringType())])
    return df.mapInArrow(partial(_restored, output=output, form=form, settings=settings, keep=keep, into=into), schema)


OP12_SQL = """
with cut as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') as u,
         sha256('7:' || cast(doc_id as varchar)) as h
  from documents),
drawn as (
  select *, len(u) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
         cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4
  from cut),
parts as (
  select doc_id, t, n,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain'
              when h4 % 100 < 50 then 'spm' else 'psm' end as form,
         array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') as p,
         array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') as m,
         array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') as s
  from drawn)
select doc_id, cast(n as bigint) as n, form,
       case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars,
       case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
              else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(t) as restored_sha256
from parts
"""


@query("op12_piece_table", OP12_SQL)
def op12_piece_table(spark, sf_dir):
    """Form, sizes and hashes of every document rearranged for infilling."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fill_in_middle(
        documents, columns=["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]).drop("text")
