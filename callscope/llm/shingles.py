"""Word shingles of texts as 64-bit numbers, a block of texts at a time.

Everything is a few passes of array arithmetic over the bytes of the block; no
Python object is made per word. Two different shingles share a number with
probability 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from callscope.llm.common import mix, text_bytes

_BASE = np.uint64(0x9E3779B97F4A7C15)
_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks for the first 0 to 8 bytes of a little-endian number.
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_numbers(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of the texts, in order, and the words' bounds by text.

    A word is read eight bytes at a time.
    """
    data, bounds = text_bytes(column)
    inside = _IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = np.diff(bounds) > 0
    opening, closing = bounds[:-1][filled], bounds[1:][filled] - 1
    first[opening], last[closing] = inside[opening], inside[closing]
    starts, lengths = np.flatnonzero(first), np.flatnonzero(last) + 1
    lengths -= starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = _LOWER[data] if lower else data
    eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,))
    numbers = mix((eight[starts] & _FIRST_BYTES[np.minimum(lengths, 8)]) * _BASE + lengths.astype(np.uint64))
    longer, done = np.flatnonzero(lengths > 8), 8
    while len(longer):
        left = lengths[longer] - done
        numbers[longer] = mix(numbers[longer] * _BASE + (eight[starts[longer] + done] & _FIRST_BYTES[np.minimum(left, 8)]))
        longer, done = longer[left > 8], done + 8
    return numbers, np.searchsorted(starts, bounds)


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each text, with repeats, and the index of their text.

    A text of fewer words has one shingle of all of them; one without words has none.
    """
    numbers, bounds = word_numbers(column)
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(counts)), counts)
    n = len(numbers) - width + 1
    values, texts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n > 0:
        chain = np.full(n, np.uint64(width))
        for j in range(width):
            chain = mix(chain * _BASE + numbers[j:j + n])
        whole = owner[:n] == owner[width - 1:]
        values, texts = chain[whole], owner[:n][whole]
    for few in range(1, width):
        short = np.flatnonzero(counts == few)
        chain = np.full(len(short), np.uint64(few))
        for j in range(few):
            chain = mix(chain * _BASE + numbers[bounds[short] + j])
        values, texts = np.concatenate([values, chain]), np.concatenate([texts, short])
    return values, texts


def distinct(values: np.ndarray, texts: np.ndarray, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, by text and then by (``rank``, value)."""
    order = np.argsort(values)
    if rank is not None:
        order = order[np.argsort(rank[order], kind="stable")]
    order = order[np.argsort(texts[order].astype(np.uint16 if len(texts) and texts.max() < 1 << 16 else np.uint32), kind="stable")]
    values, texts = values[order], texts[order]
    if len(values):
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (texts[1:] != texts[:-1])
        values, texts = values[fresh], texts[fresh]
    return values, texts
