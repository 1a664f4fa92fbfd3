"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton is built over a bounded sample of labelled
text. A text is parsed against each of them: from the current place the longest
stretch that occurs anywhere in the sample is one phrase, then the next begins.
The fewer phrases, the nearer the language; counts are normalised by the
logarithm of the sample's size, as in cross-parsing estimates of relative
entropy. The transitions of an automaton lie interleaved in one flat array whose
length follows their number, whatever the alphabet.

Texts are parsed whole, in parts side by side, one character a step: each part first as if a
phrase began with it, then from the state in which the part before ends, until both are
in the same state, from which on they agree. A part in which they never meet hands its
own end on to the next. So the phrases are those of one pass over the text.

Only letters count: text is lower-cased, and every run of other characters is
one space.

Defined results: a text that is NULL or has no letter is ``und`` with score 0;
where languages tie, the first in alphabetic order wins with score 0; letters
no sample holds are a phrase each; repeated rows are judged one by one; without
any labelled text everything is ``und``. Calling :func:`learn` starts a job; a model
of more than ``MODEL_BYTES`` is an error, as it is handed to every worker. A very long text takes
memory in proportion to it (about 40 bytes a character).
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm.common import query, table, texts_in_blocks

PART = 256
BLOCK = 1 << 20
#: Bounds of the training sample per language: documents, and characters of each.
SAMPLE_DOCS = 64
SAMPLE_CHARS = 800
#: Models above this are not broadcast; a language of the sample above takes about 2 MB.
MODEL_BYTES = 256 << 20
_LETTER_BITS = 21
_LETTER = (1 << _LETTER_BITS) - 1


def normalised(text: str) -> str:
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """The transitions of each state; state 0 is the start. Every path spells a substring of ``text``."""
    steps: list[dict[str, int]] = [{}]
    links, lengths, last = [-1], [0], 0
    for c in text:
        new = len(steps)
        steps.append({})
        links.append(0)
        lengths.append(lengths[last] + 1)
        at = last
        while at >= 0 and c not in steps[at]:
            steps[at][c] = new
            at = links[at]
        if at >= 0:
            target = steps[at][c]
            if lengths[target] == lengths[at] + 1:
                links[new] = target
            else:
                clone = len(steps)
                steps.append(dict(steps[target]))
                links.append(links[target])
                lengths.append(lengths[at] + 1)
                while at >= 0 and steps[at].get(c) == target:
                    steps[at][c] = clone
                    at = links[at]
                links[target] = links[new] = clone
        last = new
    return steps


@dataclass(frozen=True)
class Table:
    """The transitions of an automaton: ``places[base[state] + letter]`` holds ``next state, letter``, or another letter where
    there is none. ``start`` has the state after each letter alone."""

    base: np.ndarray
    places: np.ndarray
    start: np.ndarray

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase begins with the letter."""
        place = self.places[self.base[state] + letter]
        begins = (place & _LETTER) != letter
        return np.where(begins, self.start[letter], place >> _LETTER_BITS), begins


@dataclass(frozen=True)
class Model:
    """Tables of the languages over one numbering of letters; 1 is for letters not learned."""

    languages: tuple[str, ...]
    letters: str
    tables: tuple[Table, ...]
    sizes: tuple[int, ...]

    @property
    def nbytes(self) -> int:
        return sum(t.base.nbytes + t.places.nbytes + t.start.nbytes for t in self.tables)


def interleaved(steps: list[dict[str, int]], code: dict[str, int], width: int, seed: int = 7) -> Table:
    """States with many transitions are placed first, each where its letters' places are free; no two
    states have the same base, so the letter tells whose a transition is."""
    size = 2 * sum(map(len, steps)) + 16
    rng = random.Random(seed)
    used, taken = bytearray(size + width), bytearray(size)
    # behind all others is room for the states without transitions, also that after a letter not learned
    strange, empty = len(steps), size + width
    base = np.full(len(steps) + 1, empty, np.int64)
    places = np.full(empty + width, -1, np.int64)
    for state in sorted(range(len(steps)), key=lambda i: -len(steps[i])):
        letters = [code[c] for c in steps[state]]
        if not letters:
            break
        at = rng.randrange(size)
        while taken[at] or any(used[at + c] for c in letters):
            at = rng.randrange(size)
        taken[at], base[state] = 1, at
        for c, target in zip(letters, steps[state].values()):
            used[at + c] = 1
            places[at + c] = target << _LETTER_BITS | c
    start = np.full(width, strange, np.int64)
    for c, target in steps[0].items():
        start[code[c]] = target
    return Table(base, places, start)


def train(samples: dict[str, str]) -> Model:
    """A model of normalised sample texts, keyed by language."""
    letters = "".join(sorted({c for text in samples.values() for c in text}))
    code = {c: i + 2 for i, c in enumerate(letters)}
    languages = tuple(sorted(samples))
    tables = tuple(interleaved(suffix_automaton(samples[x]), code, len(letters) + 2) for x in languages)
    return Model(languages, letters, tables, tuple(max(2, len(samples[x])) for x in languages))


def _coded(model: Model, texts: list[str]) -> np.ndarray:
    codes = np.ones(0x110000 if any(ord(c) > 0xFFFF for c in model.letters) else 0x10000, np.uint8 if len(model.letters) < 254 else np.int32)
    for i, c in enumerate(model.letters):
        codes[ord(c)] = i + 2
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    coded = codes[np.minimum(points, len(codes) - 1)]
    coded[points >= len(codes)] = 1
    return coded


def _walk(table: Table, state: int, letters: list[int], known: list[int], counted: list[int]) -> tuple[int, int]:
    """One part from ``state`` on, as far as its states are not the known ones: how many phrases begin, its last state."""
    count = 0
    for at, letter in enumerate(letters):
        place = int(table.places[table.base[state] + letter])
        if place & _LETTER == letter:
            state = place >> _LETTER_BITS
        else:
            state = int(table.start[letter])
            count += 1
        if state == known[at]:
            return count + counted[-1] - counted[at], known[-1]
    return count, state


def _begins(table: Table, grid: np.ndarray, lengths: np.ndarray, before: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Phrases that begin within each part behind its first character, or with it too where a part comes before.

    ``grid`` [place, part] holds the letters, longer parts first; ``before`` is the part before in the text, or -1; ``number`` is in
    the order of the text.
    """
    parts = len(lengths)
    live = np.searchsorted(-lengths, -np.arange(len(grid)), side="left")  # parts that reach each place
    states, counts = np.zeros(grid.shape, np.int32), np.zeros(grid.shape, np.int32)
    state, count = table.start[grid[0]], np.zeros(parts, np.int32)
    states[0] = state
    for at in range(1, len(grid)):
        n = live[at]
        state[:n], begins = table.step(state[:n], grid[at, :n])
        count[:n] += begins
        states[at, :n], counts[at, :n] = state[:n], count[:n]

    # again, from where the part before ends, until the states are the same
    total, last = count.copy(), state.copy()
    rows = np.flatnonzero(before >= 0)
    now, extra = state[before[rows]], np.zeros(len(rows), np.int32)
    for at in range(len(grid)):
        if not len(rows):
            break
        now, begins = table.step(now, grid[at, rows])
        extra += begins
        met = now == states[at, rows]
        over = ~met & (lengths[rows] == at + 1)
        total[rows[met]] = extra[met] + count[rows[met]] - counts[at, rows[met]]
        total[rows[over]], last[rows[over]] = extra[over], now[over]
        stay = ~(met | over)
        rows, now, extra = rows[stay], now[stay], extra[stay]

    # parts whose end became another one than that with which the next went on
    changed = np.flatnonzero(last != state)
    if len(changed):
        after = np.full(parts, -1)
        after[before[before >= 0]] = np.flatnonzero(before >= 0)
        walked = set()
        for row in changed[np.argsort(number[changed])].tolist():
            while (then := int(after[row])) >= 0 and then not in walked and last[row] != state[row]:
                size = int(lengths[then])
                total[then], last[then] = _walk(
                    table, int(last[row]), grid[:size, then].tolist(), states[:size, then].tolist(), counts[:size, then].tolist())
                walked.add(then)
                row = then
    return total


def phrases(model: Model, texts: list[str]) -> np.ndarray:
    """How many phrases each text takes per language; [text, language]."""
    coded = _coded(model, texts)
    sizes = np.array([len(t) for t in texts])
    parts = -(-sizes // PART)
    owner = np.repeat(np.arange(len(texts)), parts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    lengths = np.minimum(PART, sizes[owner] - number * PART)
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    at = np.arange(len(coded)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row, place = rank[np.repeat(np.cumsum(parts) - parts, sizes) + at // PART], at % PART
    grid = np.zeros((min(PART, int(lengths.max(initial=1))), len(owner)), np.int64)
    grid[place, row] = coded
    before = np.where(number > 0, rank[np.arange(len(owner)) - 1], -1)[order]
    out = np.zeros((len(texts), len(model.languages)))
    for k, steps in enumerate(model.tables):
        begins = _begins(steps, grid, lengths[order], before, order)
        out[:, k] = 1 + np.bincount(owner[order], weights=begins, minlength=len(texts))
    return out


def _letters_only(text: str) -> str:
    """As :func:`normalised`, faster for texts that are mostly letters and blanks."""
    low = text.lower()
    return normalised(text) if not low.isascii() else " ".join(low.translate(_ASCII).split())


_ASCII = {i: " " for i in range(128) if not chr(i).isalpha()}


def judge(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language of each text, and a score: by how much fewer phrases than the second it takes."""
    clean = [_letters_only(t) if t else "" for t in texts]
    known = [i for i, t in enumerate(clean) if t]
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    if known and model.languages:
        cost = phrases(model, [clean[i] for i in known]) * np.log2(model.sizes)
        order = np.argsort(cost, axis=1, kind="stable")
        best = np.take_along_axis(cost, order[:, :1], 1)[:, 0]
        second = np.take_along_axis(cost, order[:, 1:2], 1)[:, 0] if len(model.languages) > 1 else np.full(len(best), np.inf)
        for i, k, score in zip(known, order[:, 0].tolist(), (1 - best / second).tolist()):
            names[i], scores[i] = model.languages[k], score
    return names, scores


def _judge(batches, model, text) -> Iterator[pa.RecordBatch]:
    for block in texts_in_blocks(batches, text, BLOCK):
        names, scores = judge(model.value, block.column(block.schema.get_field_index(text)).to_pylist())
        keep = [i for i, f in enumerate(block.schema.names) if f != text]
        yield pa.RecordBatch.from_arrays(
            [*(block.column(i) for i in keep), pa.array(names), pa.array(scores, pa.float64())],
            [*(block.schema.names[i] for i in keep), "lang_pred", "score"])


def learn(df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Model:
    """A model of at most ``docs`` documents per language (drawn by a hash of the id), ``chars`` characters of each.

    Map tasks keep no more than ``docs`` rows per language before the shuffle.
    """
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    rows = df.select(F.col(id).alias("id"), F.col(lang).alias("lang"), F.substring(text, 1, chars).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    sample = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= docs).orderBy("lang", "_r").toArrow()
    texts: dict[str, list[str]] = {}
    for language, piece in zip(sample.column("lang").to_pylist(), sample.column("text").to_pylist()):
        texts.setdefault(language, []).append(normalised(piece))
    return train({language: " ".join(pieces) for language, pieces in texts.items()})


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` without ``text``, with ``lang_pred`` and ``score`` (0 to 1)."""
    if model.nbytes > MODEL_BYTES:
        raise ValueError(f"a model of {model.nbytes} bytes is above MODEL_BYTES; learn from fewer documents or characters")
    df = df.drop("lang_pred", "score")
    schema = T.StructType([*(f for f in df.schema.fields if f.name != text), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return df.mapInArrow(partial(_judge, model=df.sparkSession.sparkContext.broadcast(model), text=text), schema)


def held_out(id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 4 == 2, F.lit(False))


@query("op10_cross_parsing")
def op10_cross_parsing(spark, sf_dir):
    """The language of every document, learned from those that are not held out."""
    documents = table(spark, sf_dir, "documents")
    model = learn(documents.where(~held_out()))
    return identify(documents.select("doc_id", held_out().alias("held_out"), "text"), model)
