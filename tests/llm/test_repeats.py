import hashlib
import random

import pytest
from pyspark.sql import functions as F

from callscope.llm import repeats

SIZE = repeats.WINDOW


def brute(rows):
    """Figures per row by looking every window up in a dictionary."""
    first, out = {}, []
    by_id = {i: (t or "").encode() for i, t in rows if i is not None}
    for i in sorted(by_id):
        raw = by_id[i]
        for p in range(len(raw) - SIZE + 1):
            first.setdefault(raw[p:p + SIZE], (i, p))
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - SIZE + 1):
            if i is not None and first[raw[p:p + SIZE]] != (i, p):
                gone[p:p + SIZE] = b"\1" * SIZE
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df, **kw):
    rows = repeats.remove_repeats(df, **kw).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    letters = "abcdéß語 "
    word = lambda k: "".join(rng.choice(letters) for _ in range(k))
    passages = [word(rng.choice([40, 60, 99, 100, 130, 300])) for _ in range(8)]
    texts = [None, "", "x" * 99, "x" * 100, "x" * 101, "ab" * 400, "abc" * 90 + "ab" * 90, word(250)]
    for _ in range(n):
        texts.append("".join(rng.choice(passages) if rng.random() < 0.6 else word(rng.randrange(80)) for _ in range(rng.randrange(1, 7))))
    texts += rng.sample(texts, 6)
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed, kw", [(1, {}), (2, {"group_limit": 2}), (3, {"broadcast_limit": 0}), (4, {"group_limit": 0})])
def test_removes_what_a_dictionary_of_windows_removes(docs_of, seed, kw):
    rows = corpus(seed)
    assert found(docs_of(rows).repartition(5), **kw) == brute(rows)


def test_long_texts_are_cut_into_overlapping_parts(docs_of, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 700)
    for seed in (5, 6):
        rows = corpus(seed, 20) + [(1000, "".join(t or "" for _, t in corpus(seed, 12)))]
        data, bounds = repeats.text_bytes(__import__("pyarrow").array([t for _, t in rows]))
        windows = sum(int(r["nw"].sum()) for r in repeats.runs_of(data, bounds))
        assert windows == sum(max(0, len((t or "").encode()) - SIZE + 1) for _, t in rows)


def test_maximal_repeats_come_with_all_occurrences():
    import numpy as np

    shared = bytes(range(48, 48 + 70)) * 2
    texts = [b"A" + shared[:120] + b"B", b"C" + shared[:120] + b"D", b"E" + shared[:110] + b"F"]
    groups = dict()
    for length, places in repeats.maximal_repeats(np.zeros(3, np.int64), np.arange(3), np.zeros(3, np.int64), texts):
        groups[length] = sorted(places)
    assert groups == {120: [(0, 1), (1, 1)], 110: [(0, 1), (1, 1), (2, 1)]}


@pytest.mark.parametrize("variants", [4, 64, 256])
def test_one_stretch_for_a_run_however_many_variants(variants):
    """Nested repeats: variant v has v % 16 bytes more in common with those of its kind; whole repeats are many more."""
    import numpy as np

    rng = random.Random(variants)
    core = bytes(rng.randrange(97, 123) for _ in range(110))
    texts = [core + bytes([65 + v % 16] * (v % 7)) + bytes([48 + v % 10, 48 + v // 10 % 10, 48 + v // 100]) for v in range(variants)]
    args = np.zeros(variants, np.int64), np.arange(variants), np.zeros(variants, np.int64), texts
    ids, lo, length = repeats.repeated_stretches(*args)
    assert len(set(ids.tolist())) == len(ids) == variants - 1
    covered = {}
    for size, places in repeats.maximal_repeats(*args):
        for i, p in places:
            if (i, p) != min(places):
                covered.setdefault(i, set()).update(range(p, p + size))
    assert covered == {i: set(range(p, p + n)) for i, p, n in zip(ids.tolist(), lo.tolist(), length.tolist())}


def test_copies_in_many_blocks(docs_of):
    rng = random.Random(11)
    core = "".join(rng.choice("abcdefgh") for _ in range(120))
    rows = [(i, f"{rng.random()} {core}{i % 5}{i % 5} {rng.random()}") for i in range(300)]
    df = docs_of(rows).repartition(12)
    assert repeats.repeated_spans(df).count() < 3 * 300 and found(df) == brute(rows)


def test_repeated_rows_null_ids_empty_table_and_clashing_columns(docs_of):
    long = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(80))
    rows = [(3, long), (3, long), (4, long + "!"), (None, long), (5, None)]
    df = docs_of(rows).withColumns({"a": F.lit(1), "id": F.lit(2), "lo": F.lit(3), "length": F.lit(4), "n_spans": F.lit(5), "_span_id": F.lit(6), "_spans": F.lit(7), "span_id": F.lit(8)})
    assert found(df) == brute(rows)
    assert repeats.remove_repeats(docs_of([])).count() == 0


def test_kept_texts_stay_readable(docs_of):
    shared = "é" * 60  # repeats itself from its second letter on
    rows = repeats.remove_repeats(docs_of([shared + "a", "b" + shared, None])).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["éa", "b", None]


def test_documents_of_the_small_data_set(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert found(repeats.table(spark, sf, "documents")) == brute(docs)


def test_a_run_travels_in_four_numbers():
    """First byte and windows share one, also for the longest text and run and for a run known to be repeated."""
    import numpy as np
    import pyarrow as pa

    lo, nw = np.array([0, 7, 2**31 - 1, 2**31 - 1, 5]), np.array([1, -69, 69, -1, 100])
    packed = repeats._packed(lo, nw)
    assert [x.tolist() for x in repeats._unpacked(packed)] == [lo.tolist(), nw.tolist()]
    assert (np.argsort(packed[:3]) == np.argsort(lo[:3])).all()
    text = "".join(chr(97 + i * i % 23) + chr(97 + i % 19) for i in range(400))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array([text, "x" + text])], ["id", "text"])
    found = next(repeats._runs(iter([batch])))
    assert found.schema.names == ["a", "c", "id", "place"]
    first, windows = repeats._unpacked(found.column(3).to_numpy())
    assert (first >= 0).all() and (abs(windows) <= repeats.WINDOW - repeats.GRAM + 1).all() and (windows < 0).any()
    assert abs(windows).sum() == 2 * len(text) + 1 - 2 * (repeats.WINDOW - 1)
