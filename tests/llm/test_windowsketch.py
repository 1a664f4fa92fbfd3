import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callscope.llm import windowsketch
from callscope.llm.shingles import word_numbers


def brute(rows, width=50):
    """Figures per row by looking every window up in a dictionary."""
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for p in range(len(w) - width + 1) if i is not None else ():
            key = tuple(w[p:p + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - width + 1):
            if i is not None and first[tuple(w[p:p + width])] < i:
                gone.update(range(p, p + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, **kw):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in windowsketch.remove_windows(df, **kw).collect()), key=str)


def corpus(seed, n=80):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(["a", "b", "é", "語", "word"]) + str(rng.randrange(3)) for _ in range(k))
    passages = [text(rng.choice([20, 49, 50, 51, 60, 130])) for _ in range(8)]
    texts = [None, "", "x " * 49, "x " * 50, "x\t" * 51, "x\n" * 300, "y " * 120, "y " * 120, text(49), text(700)]
    for _ in range(n):
        texts.append(rng.choice([" ", "\n", "  "]).join(rng.choice(passages) if rng.random() < 0.5 else text(rng.randrange(60)) for _ in range(rng.randrange(1, 7))))
    texts += rng.sample(texts, 10)
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed, kw", [(1, {}), (2, {"counters": 8}), (3, {"counters": 1 << 12}), (4, {"gram": 50}), (5, {"gram": 1, "width": 20})])
def test_removes_what_a_dictionary_of_windows_removes(docs_of, seed, kw):
    rows = corpus(seed)
    assert found(docs_of(rows).repartition(5), **kw) == brute(rows, kw.get("width", 50))


def test_the_sketch_lets_every_shared_window_through_and_few_others(docs_of):
    rows = corpus(6)
    bits = windowsketch.sketch(docs_of(rows).select("doc_id", "text").repartition(4))
    holders, estimate = {}, {}
    numbers, bounds = word_numbers(pa.array([t for _, t in rows]), lower=False)
    for runs in windowsketch.runs_of(numbers, bounds):
        passed = windowsketch.estimated_repeated(runs["a"], bits)
        for a, row, nw, at, p in zip(runs["a"], runs["row"], runs["nw"], runs["at"], passed):
            estimate[int(a)] = bool(p)
            for w in runs["window"][at:at + nw]:
                holders.setdefault((int(a), int(w)), set()).add(int(row))
    shared = {a for (a, _), docs in holders.items() if len(docs) > 1}
    assert shared and all(estimate[a] for a in shared)
    docs_of_gram = {}
    for (a, _), docs in holders.items():
        docs_of_gram.setdefault(a, set()).update(docs)
    assert {a for a, p in estimate.items() if p} == {a for a, docs in docs_of_gram.items() if len(docs) > 1}  # no collision here


def test_long_texts_are_cut_into_overlapping_parts(monkeypatch):
    rows = corpus(7, 30) + [(999, " ".join(t or "" for _, t in corpus(7, 30)))]
    numbers, bounds = word_numbers(pa.array([t for _, t in rows]), lower=False)

    def windows():
        return sorted((int(r), int(lo) + k, int(runs["window"][at + k])) for runs in windowsketch.runs_of(numbers, bounds)
                      for r, lo, nw, at in zip(runs["row"], runs["lo"], runs["nw"], runs["at"]) for k in range(nw))

    whole = windows()
    monkeypatch.setattr(windowsketch, "BLOCK", 300)
    windowsketch._powers.clear()
    assert windows() == whole and len(whole) == sum(max(0, n - 49) for n in np.diff(bounds))
    windowsketch._powers.clear()


def test_many_copies_and_variants_make_few_rows(docs_of, monkeypatch):
    """Rows before the second shuffle grow with the text, not with the copies of a passage in all of it."""
    rng = random.Random(8)
    shared = " ".join(str(rng.random()) for _ in range(80))
    rows = [(i, f"{rng.random()} " * 3 + shared + f" {rng.random()}") for i in range(400)] + [(400 + i, shared) for i in range(400)]
    assert found(docs_of(rows).repartition(3)) == brute(rows)
    sent = []
    plain = windowsketch._dealt
    monkeypatch.setattr(windowsketch, "_dealt", lambda known, *rest: sent.append(int((~known).sum())) or plain(known, *rest))
    batch = docs_of(rows).select("doc_id", "text").toArrow().combine_chunks().to_batches()[0]

    class Bits:
        value = np.full(1 << 10, 255, np.uint8)

    assert sum(b.num_rows for b in windowsketch._candidates(iter([batch]), 50, 20, Bits)) <= 800 * 9
    assert sum(sent) < 1700  # of 800 x 5 runs or so: the edges differ, the middle of the passage is one run


def test_repeated_rows_null_ids_empty_table_long_texts_and_clashing_columns(docs_of):
    rng = random.Random(9)
    long = " ".join(str(rng.randrange(10 ** 6)) for _ in range(60_000))
    rows = [(3, long), (3, long), (4, long + " end"), (None, long), (5, None)]
    df = docs_of(rows).withColumns({"id": F.lit(2), "lo": F.lit(3), "span_id": F.lit(4), "spans": F.lit(5), "n_words": F.lit(6), "a": F.lit(7)})
    assert found(df) == brute(rows)
    kept = {r.doc_id: r for r in windowsketch.remove_windows(df).collect()}
    assert kept[4].text == "end" and kept[5].text is None and kept[3].text == long and kept[4].span_id == 4
    assert windowsketch.remove_windows(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        windowsketch.remove_windows(df, counters=1000)
