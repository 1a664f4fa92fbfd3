"""Nearest-rank percentiles: goldens, and a sort-based model."""

import random

from callscope.functions.percentile import P50_95_99, nearest_rank
from callscope.operators import metrics


def by_sorting(values, p):
    ordered = sorted(values)
    return ordered[min(int(len(ordered) * p), len(ordered) - 1)]


def test_known_sizes(spark):
    rows = [(n, v) for n in (1, 2, 4, 20, 100, 201) for v in range(1, n + 1)]
    df = spark.createDataFrame(rows, "g int, latency_ms int")
    got = {r.g: (r.call_count, r.p50_latency_ms, r.p95_latency_ms, r.p99_latency_ms)
           for r in nearest_rank(df, ["g"], "latency_ms", P50_95_99).collect()}
    assert got == {
        1: (1, 1, 1, 1), 2: (2, 2, 2, 2), 4: (4, 3, 4, 4), 20: (20, 11, 20, 20),
        100: (100, 51, 96, 100), 201: (201, 101, 191, 199),
    }


def test_random_groups(spark):
    rng = random.Random(7)
    rows = [(rng.choice("abcdef"), rng.choice([None, "x", "y"]), int(rng.expovariate(0.01))) for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, h string, v int")
    got = {(r.g, r.h): r.p95 for r in nearest_rank(df, ["g", "h"], "v", {"p95": 0.95}).collect()}
    groups = {}
    for g, h, v in rows:
        groups.setdefault((g, h), []).append(v)
    assert got == {k: by_sorting(vs, 0.95) for k, vs in groups.items()}


def test_nothing_gives_zeros(spark, sf):
    from callscope.plans import testdata

    empty = testdata.calls(spark, sf).where("id < 0")
    assert list(metrics.overview_of(empty).first().asDict().values()) == [0, 0, 0, 0, 0, 0, 0]
    assert metrics.tool_stats(empty).count() == 0
    assert metrics.cost_totals(empty).first().total_cost_usd == 0


def test_health_borders(make_calls):
    def server(name, errors, total, latency):
        return [(0, "s", name, "t", "error" if i < errors else "success", latency, 1000 + i) for i in range(total)]

    rows = (server("at20", 20, 100, 1) + server("over20", 21, 100, 1) + server("at5", 5, 100, 1)
            + server("over5", 6, 100, 1) + server("slow", 0, 10, 2001) + server("at2000", 0, 10, 2000))
    got = {r.server_name: r.status for r in metrics.server_health_of(make_calls(rows)).collect()}
    assert got == {"at20": "degraded", "over20": "down", "at5": "healthy", "over5": "degraded",
                   "slow": "degraded", "at2000": "healthy"}


def test_ranks_of_a_whole_table(spark):
    """Values within one range of the histogram, over many ranges, and far apart; sums and maxima ride along."""
    from pyspark.sql import functions as F

    rng = random.Random(9)
    for values in ([5], [7] * 300, list(range(1, 5001)), [int(rng.expovariate(1e-5)) for _ in range(900)], [0, 2**40, 3, 4096, 4095]):
        df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i long").repartition(3)
        row = nearest_rank(df, [], "v", P50_95_99, sums={"total": F.col("i")}, latest={"last": "i"}).first()
        want = [by_sorting(values, p) for p in P50_95_99.values()]
        assert [row[name] for name in P50_95_99] == want and row.call_count == len(values)
        assert (row.total, row["last"]) == (sum(range(len(values))), len(values) - 1)
    empty = nearest_rank(df.where("v < 0"), [], "v", P50_95_99, sums={"total": F.col("i")}).first()
    assert list(empty) == [0, None, None, None, None]
