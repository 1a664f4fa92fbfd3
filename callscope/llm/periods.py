"""Periodic runs of words: stretches that repeat a short sequence over and over.

A run is a stretch of words with smallest period q (words q apart are equal), at
least ``exponent`` times as long as q and ``least`` words, which neither
neighbour extends. Seed and extend, for all lags of a document at once:

1. *Seeds.* A run of period q keeps its words q apart equal over at least
   max(least, exponent * q) - q places, so on the diagonal of lag q there is a
   common k-gram of that length. Lags are taken in classes, q from 2**j to
   2**(j+1) - 1, and each class indexes the k-grams of the overlap that all its
   lags guarantee. Such a k-gram is no shorter than any lag of the class.
   Inside a run of smallest period q it therefore recurs every q words and not
   sooner, so of all pairs of equal k-grams only *neighbouring* occurrences are
   enumerated: at most one pair for a word and class, also where one gram fills
   a document.
2. *Extension.* Pairs of a lag of the class are extended to both sides while
   words at that lag are equal. A table holds for each lag how far it has been
   covered; a pair inside a stretch that is known is not extended again.
3. Stretches that are long enough are runs. One with a smaller period cannot
   turn up: its seed would have recurred sooner.

Words are compared as 64-bit numbers. There is no shuffle; a worker holds one
text of any length at a time, about 50 bytes for each of its words.

Defined results: a NULL text has no words and no runs, and stays NULL; rows with
equal ids or texts are independent of each other. A column of the input that has
the name of a result is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm.common import mix, query, table, texts_in_blocks
from callscope.llm.shingles import word_numbers

#: Shortest run, and how many times its period a run is long.
LEAST, EXPONENT = 6, 4
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _grams(size: int, low: int, doubled: dict[int, np.ndarray]) -> np.ndarray:
    """A number for every ``size`` neighbours, a multiple of ``low``, made of those of powers of two in ``doubled``."""
    out, have, power = None, 0, low
    while have < size:
        if power not in doubled:
            half = doubled[power // 2]
            doubled[power] = mix(half[:-(power // 2)] * _BASE + half[power // 2:])
        if size & power:
            part = doubled[power]
            out = part if out is None else mix(out[:len(part) - have] * _BASE + part[have:])
            have += power
        power *= 2
    return out


def guaranteed(low: int, least: int = LEAST, exponent: int = EXPONENT) -> int:
    """Over how many places a run of a period from ``low`` to ``2 * low - 1`` equals itself at that lag, at least."""
    turn = least // exponent
    return min(max(least, exponent * q) - q for q in {low, 2 * low - 1, turn, turn + 1} if low <= q < 2 * low)


def seeds(words: np.ndarray, bounds: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each class of lags: first places and lags of neighbouring equal k-grams, and k.

    ``words`` are the words of several texts, ``bounds`` the texts' first words and the end.
    """
    sizes = np.diff(bounds)
    every = np.repeat(np.arange(len(sizes)), sizes)
    stop = np.repeat(bounds[1:], sizes)
    doubled, low, last = {1: words}, 1, len(words) + 1
    place = np.zeros(0, np.int64)
    while True:
        size = guaranteed(low, least, exponent) // low * low
        if not (sizes >= size + low).any():
            return
        if size < last:
            place = np.arange(len(words))
        last = size
        place = place[place + size <= stop[place]]
        key = _grams(size, low, doubled)[place] ^ mix(every[place].astype(np.uint64))
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
        same = key[1:] == key[:-1]
        lag = place[1:] - place[:-1]
        pair = same & (lag >= low) & (lag < 2 * low)
        if pair.any():
            yield place[:-1][pair], lag[pair], size
        # what is the only one of its kind in its text has no longer equal either
        several = np.zeros(len(place), bool)
        several[1:] |= same
        several[:-1] |= same
        place = np.sort(place[several])
        _grams(2 * low, 2 * low, doubled)
        del doubled[low]
        low *= 2


def _alike(words: np.ndarray, at: int, lag: int, end: int) -> int:
    """How many words from ``at`` on equal those ``lag`` later, which lie before ``end``."""
    done, step, most = 0, 16, end - lag - at
    while done < most:
        a, b = at + done, min(at + done + step, end - lag)
        unlike = np.flatnonzero(words[a:b] != words[a + lag:b + lag])
        if len(unlike):
            return done + int(unlike[0])
        done, step = b - at, step * 2
    return done


def _alike_before(words: np.ndarray, at: int, lag: int, begin: int) -> int:
    """How many words before ``at``, back to ``begin``, equal those ``lag`` later."""
    done, step, most = 0, 16, at - begin
    while done < most:
        a, b = max(at - done - step, begin), at - done
        unlike = np.flatnonzero(words[a:b] != words[a + lag:b + lag])
        if len(unlike):
            return at - a - int(unlike[-1]) - 1
        done, step = at - a, step * 2
    return done


def runs_of(words: np.ndarray, bounds: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int, int]]:
    """All runs as (text, first word in the text, length, period), in this order by text, first word and period."""
    out = []
    for places, lags, size in seeds(words, bounds, least, exponent):
        texts = np.searchsorted(bounds, places, "right") - 1
        order = np.lexsort((places, texts))
        places, lags, texts = places[order], lags[order], texts[order]
        # a seed whose left neighbour is one of the same lag lies in the same stretch
        fresh = np.ones(len(places), bool)
        fresh[1:] = (places[1:] != places[:-1] + 1) | (lags[1:] != lags[:-1]) | (texts[1:] != texts[:-1])
        covered: dict[int, int] = {}
        last = -1
        for text, place, lag in zip(texts[fresh].tolist(), places[fresh].tolist(), lags[fresh].tolist()):
            if text != last:
                covered, last = {}, text
                begin, end = int(bounds[text]), int(bounds[text + 1])
            if place < covered.get(lag, -1):
                continue
            first = place - _alike_before(words, place, lag, begin)
            stop = place + size + _alike(words, place + size, lag, end)
            covered[lag] = stop
            length = stop + lag - first
            if length >= max(least, exponent * lag):
                out.append((text, first - begin, length, lag))
    return sorted(out, key=lambda r: (r[0], r[1], r[3]))


_RUN = T.StructType([T.StructField(f, T.LongType(), False) for f in ("start", "length", "period")])
_RUN_ARROW = pa.struct([pa.field(f, pa.int64(), False) for f in ("start", "length", "period")])


def _with_runs(batches, text: str, least: int, exponent: int, keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in texts_in_blocks(batches, text):
        column = batch.column(batch.schema.get_field_index(text))
        words, bounds = word_numbers(column, lower=False)
        found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for row, start, length, period in runs_of(words, bounds, least, exponent):
            found[row].append({"start": start, "length": length, "period": period})
        collapsed = []
        for value, runs in zip(column.cast(pa.large_binary()), found):
            if not value.is_valid:
                collapsed.append(None)
                continue
            parts = value.as_py().split()  # at ASCII white space, as word_numbers does
            if runs:
                gone = np.zeros(len(parts) + 1, np.int64)
                for run in runs:
                    gone[run["start"] + run["period"]] += 1
                    gone[run["start"] + run["length"]] -= 1
                parts = [parts[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
            collapsed.append(b" ".join(parts).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(batch.schema.get_field_index(c)) for c in keep], pa.array(np.diff(bounds), pa.int64()),
             pa.array(found, pa.list_(pa.field("element", _RUN_ARROW, False))), pa.array(collapsed, pa.string())],
            [*keep, "n_words", "runs", "collapsed"])


def periodic_runs(df: DataFrame, text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """Rows with ``n_words``, ``runs`` (structs of first word ``start``, ``length`` and ``period``, ordered by start and
    period) and ``collapsed``: the words, joined by one space, without those that a run holds after its first period.
    """
    if exponent < 3 or least < 2:
        raise ValueError("neighbouring seeds find every run from three periods and two words on")
    keep = tuple(c for c in df.columns if c not in ("n_words", "runs", "collapsed"))
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(_RUN, False)), T.StructField("collapsed", T.StringType())])
    return df.mapInArrow(partial(_with_runs, text=text, least=least, exponent=exponent, keep=keep), schema)


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period (ties: first start, then shortest period); NULL if there is none."""
    ahead = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, run: F.when(ahead(run, best), run).otherwise(best))


def planted(batches, id: str, text: str) -> Iterator[pa.RecordBatch]:
    """The texts with the repetitions that the check prescribes for every tenth id or so (by its CRC-32)."""
    for batch in texts_in_blocks(batches, text):
        at = batch.schema.get_field_index(text)
        texts = []
        for key, value in zip(batch.column(batch.schema.get_field_index(id)), batch.column(at).cast(pa.large_binary())):
            h, raw = zlib.crc32(str(key.as_py()).encode()), value.as_py()
            if raw is not None and key.is_valid and h % 10 == 0:
                parts = raw.split()
                n, g = len(parts), h // 10
                if n:
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    raw = b" ".join(parts[:a] + [parts[a + (i - a) % p] for i in range(a, n)])
            texts.append(None if raw is None else raw.decode("utf-8", "replace"))
        columns = batch.columns
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    """Number of runs, the strongest one, and hashes of all runs and of the collapsed words of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs(documents.mapInArrow(partial(planted, id="doc_id", text="text"), documents.schema))
    best = strongest(F.col("runs"))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), "collapsed",
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
    ).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256",
        F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"))
