import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.llm import periods
from callscope.llm.common import mix


def brute(words, least=6, exponent=4):
    """Looks along every lag; keeps a stretch if no smaller lag holds in all of it."""
    out, n = [], len(words)
    for lag in range(1, n):
        i = 0
        while i + lag < n:
            j = i
            while j + lag < n and words[j] == words[j + lag]:
                j += 1
            length = j + lag - i
            if j > i and length >= max(least, exponent * lag):
                part = words[i:i + length]
                if not any(part[:length - d] == part[d:] for d in range(1, lag)):
                    out.append((i, length, lag))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    letters, out = rng.choice([1, 2, 3, 5]), []
    for _ in range(rng.randrange(6)):
        if rng.random() < 0.6:
            unit = [rng.randrange(letters) for _ in range(rng.randrange(1, 9))]
            out += (unit * rng.randrange(1, 7))[:rng.randrange(60)]
        else:
            out += [rng.randrange(letters) for _ in range(rng.randrange(10))]
    return out


@pytest.mark.parametrize("least, exponent", [(6, 4), (12, 3), (2, 3), (20, 5)])
def test_finds_the_runs_of_every_lag(least, exponent):
    rng = random.Random(least)
    for _ in range(400):
        docs = [some_words(rng) for _ in range(rng.randrange(1, 5))]
        words = mix(np.array([w for d in docs for w in d], np.uint64) + np.uint64(9))
        found = periods.runs_of(words, np.cumsum([0, *map(len, docs)]), least, exponent)
        assert found == [(i, *run) for i, d in enumerate(docs) for run in brute(d, least, exponent)]


def test_one_word_fills_a_document_and_long_periods():
    same = mix(np.zeros(200_000, np.uint64))
    assert periods.runs_of(same, np.array([0, 200_000])) == [(0, 0, 200_000, 1)]
    assert sum(len(places) for places, _, _ in periods.seeds(same, np.array([0, 200_000]))) < 200_000
    unit = mix(np.arange(30_000, dtype=np.uint64))
    assert periods.runs_of(np.tile(unit, 5)[:130_000], np.array([0, 130_000])) == [(0, 0, 130_000, 30_000)]


def contract(key, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(key).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    digest = lambda raw: hashlib.sha256(raw).hexdigest()
    return (key, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            digest("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()),
            digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_a_plain_version_on_short_documents(spark, tmp_path, docs_of):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "one", "a " * 7, "\x0b".join("ab" * 9), "é x é x é x é x é x "]
    texts += ["  ".join(map(str, some_words(rng))) for _ in range(250)]
    docs_of(texts).write.parquet(str(tmp_path / "documents.parquet"))
    found = periods.op13_periodic_runs(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [contract(i, t) for i, t in enumerate(texts)]
    assert found[0].collapsed_sha256 == hashlib.sha256(b"").hexdigest()


def test_query_equals_a_plain_version_on_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy(F.length("text")).limit(120).select("doc_id", "text").collect()
    found = {r.doc_id: tuple(r) for r in periods.op13_periodic_runs(spark, sf).collect()}
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in docs:
        assert found[r.doc_id] == contract(r.doc_id, r.text)


def test_strongest_run_breaks_ties(spark):
    run = lambda *r: dict(zip(("start", "length", "period"), r))
    lists = [[], [run(0, 9, 2), run(4, 18, 4)], [run(0, 8, 2), run(4, 17, 4), run(30, 17, 4)], [run(5, 16, 4), run(5, 8, 2)]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, runs array<struct<start:bigint,length:bigint,period:bigint>>")
    best = [r.best and tuple(r.best) for r in df.select("i", periods.strongest(F.col("runs")).alias("best")).orderBy("i").collect()]
    assert best == [None, (0, 9, 2), (4, 17, 4), (5, 16, 4)]


def test_nulls_repeated_rows_long_texts_empty_table_and_clashing_columns(docs_of):
    long = "x y z " * 100_000
    df = docs_of([(1, "a b " * 5), (1, "a b " * 5), (None, "a a a a a a"), (3, None), (4, long)]).withColumns({"runs": F.lit(1), "start": F.lit(7)})
    rows = sorted((str(r.doc_id), r.collapsed, len(r.runs), r.start) for r in periods.periodic_runs(df).collect())
    assert rows == [("1", "a b", 1, 7), ("1", "a b", 1, 7), ("3", None, 0, 7), ("4", "x y z", 1, 7), ("None", "a", 1, 7)]
    assert periods.periodic_runs(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        periods.periodic_runs(df, exponent=2)
