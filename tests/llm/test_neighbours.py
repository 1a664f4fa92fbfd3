import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=10):
    """{query: [(distance, id)]} for ids divisible by 100."""
    good = [(i, np.array(v, np.float64)) for i, v, _ in rows
            if v is not None and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 8]
    ids, vectors = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    out = {}
    for i, v in good:
        if i % 100 == 0:
            apart = neighbours.distances(vectors, v)
            ranked = sorted(zip(apart.tolist(), ids.tolist()))
            out[i] = [x for x in ranked if x[1] != i][:k]
    return out


def table(rng, n):
    vectors = rng.standard_normal((n, 8)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    for i in range(0, n, 3):
        rows[i] = (i, vectors[0].tolist(), 0)  # a third of the rows are equal
    rows[100] = (100, None, 0)
    rows[101] = (101, [0.0] * 8, 0)
    rows[102] = (102, [1.0] * 7 + [float("nan")], 0)
    rows[103] = (103, [1.0] * 7 + [None], 0)
    rows[104] = (104, [float("inf")] * 8, 0)
    rows[105] = (105, [1.0] * 5, 0)
    rows[106] = (106, [], 0)
    return rows


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("v", F.lit(1)).withColumn("id", F.lit(2))
    out = {}
    for r in neighbours.search(df, df.where("vec_id % 100 = 0"), **kw).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_probing_reaches_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (500, 4)).astype(np.uint8)
    index = neighbours.Index(codes)
    for radius in (0, 3, 7, 11, 32):
        near = np.bitwise_count(codes ^ codes[7]).sum(axis=1) <= radius
        assert index.within(codes[7], radius).tolist() == np.flatnonzero(near).tolist()


def test_without_a_radius_the_search_is_exact(spark):
    rows = table(np.random.default_rng(1), 700)
    codes = neighbours.fit(np.array([r[1] for r in rows[200:]], np.float64), 8)
    whole = neighbours.Codes(codes.mean, codes.rotation, 8)
    assert found(spark, rows, codes=whole, block=3) == brute(rows)


def test_copies_odd_vectors_and_recall(spark):
    rows = table(np.random.default_rng(3), 900)
    expected, got = brute(rows), found(spark, rows)
    assert set(got) == set(expected) and all(len(got[q]) == 10 for q in got)
    hits = [len(set(got[q]) & set(expected[q])) for q in expected]
    assert np.mean(hits) >= 9


def test_few_rows_repeated_ids_and_empty_tables(spark):
    rows = [(0, [1.0] * 8, 0), (0, [1.0] * 8, 0), (5, [2.0] * 8, 0), (7, [1.0] * 8, 0), (None, [1.0] * 8, 0)]
    assert found(spark, rows) == {0: [(0.0, 7), (float(np.sqrt(8.0)), 5)]}
    assert found(spark, []) == {} and found(spark, [(3, [1.0] * 8, 0)]) == {}


@pytest.mark.parametrize("name", ["0.001", "0.1"])
def test_recall_on_the_given_tables(spark, sf, name):
    folder = sf.replace("0.001", name)
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in neighbours.table(spark, folder, "embeddings").collect() if r.embedding}
    ids, vectors = np.array(list(rows)), np.stack(list(rows.values()))
    hits, asked = 0, {}
    for r in neighbours.op8_multi_index_hashing(spark, folder).collect():
        asked.setdefault(r.query_id, set()).add(r.vec_id)
        assert r.score == neighbours.distances(rows[r.vec_id][None], rows[r.query_id])[0]
    for q, got in asked.items():
        ranked = ids[np.lexsort((ids, neighbours.distances(vectors, rows[q])))]
        hits += len(got & set(ranked[ranked != q][:10].tolist()))
    assert set(asked) == {i for i in rows if i % 100 == 0} and hits >= 0.9 * 10 * len(asked)
