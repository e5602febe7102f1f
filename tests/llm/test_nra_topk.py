import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm.common import ship
from tidewater.llm.nra_topk import block_top, search


def brute(rows, k):
    """(query_id, rank, vec_id, score) of every row that is a query, against every other row."""
    ints = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    out = []
    for q, (i, v) in enumerate(ints):
        if i % 20 == 0:
            scored = sorted((-min(max(sum(a * b for a, b in zip(v, w, strict=True)), -(1 << 63)), (1 << 63) - 1), j) for c, (j, w) in enumerate(ints) if c != q and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def results(table, **options):
    return sorted(tuple(r)[:4] for r in search(table, F.col("vec_id") % 20 == 0, **options).collect())


@pytest.mark.parametrize("spread", [8, 2.0**20, 2.0**40])
def test_bounds_never_lose_one_of_the_best(spread):
    rng = np.random.default_rng(9)
    for n, d in ((600, 16), (300, 64), (500, 4), (90, 8), (15, 3), (1, 2)):
        vectors = np.floor(rng.normal(0, spread, (n, d)))
        vectors[n // 3 : n // 2] = vectors[0]
        own = np.array([-1, 0, n - 1, -1])
        queries = np.stack((vectors[n // 2], vectors[0], vectors[n - 1], np.zeros(d)))
        got = {}
        for at, found, score, read in block_top(vectors, queries, own, 20):
            assert 0 < read <= 1
            for q, v, s in zip(at, found, score, strict=True):
                got.setdefault(int(q), {})[int(v)] = int(s)
        for q in range(4):
            truth = {v: sum(int(a) * int(b) for a, b in zip(vectors[v], queries[q], strict=True)) for v in range(n) if v != own[q]}
            able = got.get(q, {})
            assert all(truth[v] == s for v, s in able.items())
            edge = sorted(truth.values(), reverse=True)[:20]
            assert {v for v, s in truth.items() if s >= edge[-1]} <= set(able) if edge else not able


def test_bounds_stop_before_the_lists_end():
    rng = np.random.default_rng(3)
    vectors = np.floor(rng.normal(0, 8, (4000, 3)))
    reads = [read for at, _, _, read in block_top(vectors, vectors[:50], np.arange(50), 5) if len(at)]
    assert reads and min(reads) < 1


@pytest.mark.parametrize("sizes", [{}, {"block": 100, "queries": 7}, {"block": 60, "queries": 5, "round_bytes": 1000}])
def test_as_brute_force(spark, sizes):
    ship(spark)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 0.3, 12))]) for i in range(400)]
    rows[50:120] = [(i, rows[40][1]) for i in range(50, 120)]
    rows += [(20, rows[3][1]), (20, rows[20][1]), (7, [1.0] * 12), (500, [0.5, -0.25]), (501, [1.0, 1.0])]
    odd = [(None, [0.1] * 12), (400, None), (420, [math.nan] + [0.1] * 11), (440, [math.inf] * 12), (460, [None] + [0.1] * 11)]
    table = spark.createDataFrame([(i, v, "x", "y", 1) for i, v in rows + odd], "vec_id long, embedding array<float>, score string, row string, dims int")
    assert results(table, k=20, **sizes) == brute(rows, 20)


def test_large_components(spark):
    ship(spark)
    rows = [(0, [1.0, 1.0]), (1, [1e8, -3.0]), (2, [1e300, 1e300]), (3, [-1e300, 2.0]), (20, [1e8, 1e9]), (4, [0.5, 0.25]), (5, [123456789.125, -1.0]), (6, [2.0**55, 1.0])]
    assert results(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3) == brute(rows, 3)


def test_few_and_none(spark):
    table = spark.createDataFrame([(0, [0.5]), (1, [0.25]), (20, [1.0, 2.0]), (40, []), (41, [])], "vec_id long, embedding array<float>")
    assert results(table) == [(0, 1, 1, 512), (40, 1, 41, 0)]
    repeated = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0, 1.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert results(repeated) == [(0, 1, 1, 64 * 64 * 7), (0, 2, 1, 64 * 64 * 2)]
    assert search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_lists_that_are_held_answer_as_new_ones():
    rng = np.random.default_rng(12)
    vectors, held = rng.integers(-40, 40, (150, 6)).astype(float), {}
    for _ in range(3):
        queries = rng.integers(-40, 40, (9, 6)).astype(float)
        own = np.full(9, -1)
        once, again = ([tuple(map(np.ndarray.tolist, x[:3])) for x in block_top(vectors, queries, own, 5, h)] for h in (None, held))
        assert once == again
    assert len(held) == 1
