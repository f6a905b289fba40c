import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.llm import exact_search as es


def brute(rows, k, every):
    ok = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, u) in enumerate(ok):
        if q is None or q % every:
            continue
        limited = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        scores = sorted((-limited(sum(x * y for x, y in zip(u, v, strict=False))), i is None, i or 0) for b, (i, v) in enumerate(ok) if a != b)
        out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(scores[:k], 1)]
    return sorted(map(str, out))


def found(spark, rows, k=20, every=20, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"rank": F.lit("x"), "v": F.lit(1), "copies": F.lit(2)})
    return sorted(str(tuple(r)) for r in es.exact_search(df, k, every, **more).collect())


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("LEAST_BLOCK", 8), ("PIVOTS", 5), ("SAMPLE", 50), ("MAX_QUERIES", 7)):
        monkeypatch.setattr(es, name, value)


def test_clusters_with_ties_and_copies(spark, small_blocks):
    rnd = random.Random(1)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(6)]
    rows = [(i, [round(x + rnd.gauss(0, 0.1), 2) for x in centres[i % 6]]) for i in range(300)]
    rows += [(1000 + i, list(rows[40][1])) for i in range(60)]
    assert found(spark, rows, k=5) == brute(rows, 5, 20)


def test_edges(spark, small_blocks):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (20, None), (40, [nan, 1.0]), (60, [1.0, inf]), (80, [None, 1.0]), (100, []), (120, [1.0]), (None, [2.0, 2.0]), (None, [2.0, 2.0]), (7, [0.3, -0.2, 5.0])]
    rows += [(140, [0.5, 0.5])] * 3 + [(140, [-0.5, 0.5]), (-20, [1.0, 1.0])]
    assert found(spark, rows, k=4) == brute(rows, 4, 20)
    assert found(spark, rows, k=50) == brute(rows, 50, 20)
    assert found(spark, rows[:1]) == []
    assert es.exact_search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert found(spark, [(1, [1.0]), (2, [2.0])]) == []


def test_equal_vectors(spark, small_blocks):
    rows = [(i, [1.0, 2.0]) for i in range(90)]
    assert found(spark, rows, k=3) == brute(rows, 3, 20)


@pytest.mark.parametrize("size", [1.0, 4e4, 1e7, 1e16])
def test_sizes_of_components(spark, small_blocks, size):
    rnd = random.Random(2)
    rows = [(i, [rnd.uniform(-size, size) for _ in range(4)]) for i in range(120)]
    assert found(spark, rows, k=6) == brute(rows, 6, 20)


def test_bounds_leave_most_rows_of_other_clusters_out():
    rnd = np.random.default_rng(3)
    rows = np.vstack([rnd.normal(c, 1, (500, 8)) for c in (-200, 0, 200)]).astype(np.int64)
    greatest = float(np.sqrt((rows * rows).sum(1).max()))
    lifted = es._lift(rows, greatest)
    pivots = es.far_apart(lifted[::10], 8)
    far = np.ascontiguousarray(es._distances(lifted, pivots).astype(np.float32).T)
    own = np.arange(len(rows) - 5, len(rows))
    for j, (at, scores, evaluated) in enumerate(es.best_of(rows[own], np.full(5, -np.inf), own, rows, far, pivots, greatest, 3)):
        s = rows @ rows[own[j]]
        s[own[j]] = np.iinfo(np.int64).min
        assert scores == sorted(s, reverse=True)[:3] and list(s[at]) == scores
        assert evaluated < len(rows) / 2
