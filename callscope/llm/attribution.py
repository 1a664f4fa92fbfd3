"""Token counts of the sections of a text, from one encoding of the whole text.

Encoding sections by themselves gives other tokens than they have within their
document. Here a document is encoded once, each token is mapped to the stretch of the
text it stands for, and the stretches are joined with the sections' intervals
by their ends, both being in order. A token that crosses a border is allocated
by the rule that is asked for:

* ``majority``: to the section with most of its bytes, the first of equals;
* ``start``: to the section that holds its first byte;
* ``split``: to every section, by the share of its bytes.

So the counts of a document always add up to its tokens; what lies in no
section is counted under section -1.

Defined results: sections are (begin, end) in characters, in order and without
overlaps, empty ones allowed (they get nothing); others raise an error. A NULL or
empty text, and one without sections, gives a row for section -1. Repeated rows
are counted one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from callscope.llm.common import query, table, texts_in_blocks
from callscope.llm.tokens import VOCABULARY, encoder

Sections = Callable[[str], list[tuple[int, int]]]
RULES = ("majority", "start", "split")


def lines(text: str) -> list[tuple[int, int]]:
    """Each line with the break that ends it."""
    ends = [i + 1 for i, c in enumerate(text) if c == "\n"] if "\n" in text else []
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return list(zip([0, *ends], ends)) if text else []


def allocate(starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Counts per section, how many tokens each shares with others, and what lies outside.

    Tokens are the stretches ``starts`` to ``ends``, sections ``begin`` to ``end``, all in bytes.
    """
    counts, shared = np.zeros(len(begin)), np.zeros(len(begin), np.int64)
    if not len(starts):
        return counts, shared, 0.0
    full = np.flatnonzero(end > begin)
    if not len(full):
        return counts, shared, float(len(starts))
    low = np.searchsorted(end[full], starts, side="right")  # the first section that ends after the token's start
    high = np.searchsorted(begin[full], ends, side="left") - 1  # the last that begins before its end
    inside = (low == high) & (begin[full][np.minimum(low, len(full) - 1)] <= starts) & (ends <= end[full][np.maximum(high, 0)])
    counts[full] = np.bincount(low[inside], minlength=len(full))
    outside = float(((high < low)).sum())
    for t in np.flatnonzero(~inside & (high >= low)).tolist():
        a, b = int(starts[t]), int(ends[t])
        near = full[low[t]:high[t] + 1]
        parts = np.minimum(b, end[near]) - np.maximum(a, begin[near])
        shared[near] += len(near) > 1
        if rule == "split":
            counts[near] += parts / (b - a)
            outside += 1 - parts.sum() / (b - a)
        elif rule == "majority":
            rest = (b - a) - parts.sum()
            if rest > parts.max():
                outside += 1
            else:
                counts[near[parts.argmax()]] += 1
        elif begin[near[0]] <= a:
            counts[near[0]] += 1
        else:
            outside += 1
    return counts, shared, outside


def _attribute(batches, id, text, sections, rule, vocabulary) -> Iterator[pa.RecordBatch]:
    encode = encoder(vocabulary)
    for batch in texts_in_blocks(batches, 1):
        rows, out = [], {k: [] for k in ("section", "begin", "end", "n_tokens", "n_shared", "doc_tokens")}
        for row, value in enumerate(batch.column(1).to_pylist()):
            value = value or ""
            spans = sections(value)
            edges = np.array(spans, np.int64).reshape(-1, 2)
            flat = edges.ravel()
            if len(flat) and (flat[0] < 0 or flat[-1] > len(value) or (np.diff(flat) < 0).any()):
                raise ValueError("sections must lie in the text, in order and without overlaps")
            ids = encode.ids(value)
            ends = encode.byte_ends(value, ids)
            raw = np.frombuffer(value.encode(), np.uint8)
            at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # each character's first byte
            counts, shared, outside = allocate(np.append(0, ends)[:-1], ends, at[edges[:, 0]], at[edges[:, 1]], rule)
            n = len(spans) + bool(outside > 1e-9 or not spans)
            rows += [row] * n
            out["section"] += [*range(len(spans)), -1][:n]
            out["begin"] += [*edges[:, 0].tolist(), None][:n]
            out["end"] += [*edges[:, 1].tolist(), None][:n]
            out["n_tokens"] += [*counts.tolist(), outside][:n]
            out["n_shared"] += [*shared.tolist(), None][:n]
            out["doc_tokens"] += [len(ids)] * n
        if rows:
            kinds = {"n_tokens": pa.float64()}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items())], [id, *out])


def token_counts(df: DataFrame, id: str = "doc_id", text: str = "text", sections: Sections = lines, rule: str = "majority",
                 vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, section, begin, end, n_tokens, n_shared, doc_tokens): a row per section.

    ``begin`` and ``end`` are characters; ``n_tokens`` is whole but for ``split``; ``n_shared``
    counts the tokens that reach into another section.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    schema = T.StructType([T.StructField(id, df.schema[id].dataType), *[
        T.StructField(k, T.DoubleType() if k == "n_tokens" else T.LongType()) for k in ("section", "begin", "end", "n_tokens", "n_shared", "doc_tokens")]])
    return df.select(id, text).mapInArrow(partial(_attribute, id=id, text=text, sections=sections, rule=rule, vocabulary=vocabulary), schema)


@query("op1_token_attribution")
def op1_token_attribution(spark, sf_dir):
    """Tokens of each line of every document."""
    return token_counts(table(spark, sf_dir, "documents"))
