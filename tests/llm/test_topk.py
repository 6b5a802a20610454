import math

import numpy as np
from pyspark.sql import functions as F

from ticksmith.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score long"


def brute(data, k):
    rows = [(n, i, [math.floor(64 * float(np.float32(x))) for x in v]) for n, (i, v) in enumerate(data)
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in rows:
        if i % 20 == 0:
            best = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(q, c)))), j) for m, j, c in rows if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def run(spark, data, k=20, **kw):
    df = spark.createDataFrame([(i, v, 1) for i, v in data], SCHEMA)
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k, **kw).select("query_id", "rank", "vec_id", "score").collect())


def test_random_vectors_with_ties_and_copies(spark):
    rng = np.random.default_rng(1)
    data = [(i, np.round(rng.normal(0, 0.3, 12), 1).astype(np.float32).tolist()) for i in range(400)]
    data += [(1000 + i, data[7][1]) for i in range(60)] + [data[20], data[20]]
    want = brute(data, 20)
    assert run(spark, data) == want
    assert run(spark, data, candidate_rows=64, query_rows=8) == want


def test_edges(spark):
    data = [(0, None), (20, []), (40, [1.0, float("nan")]), (60, [float("inf"), 0.0]), (80, [1.0, None]), (100, [0.5, 0.25]),
            (101, [0.5]), (102, [-1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (103, [0.0, 0.0])]
    assert run(spark, data) == brute(data, 20)
    assert run(spark, []) == []


def test_huge_components(spark):
    data = [(20, [3e38, 1.0]), (21, [3e38, 1.0]), (22, [-3e38, 5.0]), (23, [1e9, 1e9]), (24, [1.0, 2.0])]
    assert run(spark, data) == brute(data, 20)


def test_bounds_hold():
    rng = np.random.default_rng(5)
    a, b = rng.integers(-60, 60, (50, 64)).astype(float), rng.integers(-60, 60, (70, 64)).astype(float)
    exact = a @ b.T
    last = None
    for s in topk.LEVELS:
        bound = topk.features(a, s) @ topk.features(b, s).T
        assert (bound >= exact - 1e-6).all()
        assert last is None or (bound <= last + 1e-6).all()  # finer is tighter
        last = bound
