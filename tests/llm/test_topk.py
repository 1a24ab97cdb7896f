"""MaxScore against all inner products."""

import numpy as np
from pyspark.sql import functions as F

from affinity.llm import topk


def brute(rows, k):
    ok = []
    for i, v, in rows:
        if i is None or v is None or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            continue
        ints = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        ok.append((i, ints))
    out = []
    for q in {i for i, _ in ok if i % 5 == 0}:
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for p, a in ok if p == q for i, b in ok if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def check(make, rows, k=5, **more):
    df = make(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") % 5 == 0, k, **more)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, k)


def test_random_vectors_over_shards(make):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=12).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]  # ties
    check(make, rows, shard_rows=50, query_rows=16)


def test_sparse_vectors_prune(make):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.random(30) * (rng.random(30) < .1)).tolist()) for i in range(200)]
    check(make, rows, shard_rows=64)


def test_odd_rows(make):
    v = [1.0, -2.0, .5]
    rows = [(0, v), (0, v), (1, v), (2, None), (3, [1.0, None, 1.0]), (4, [float("nan")] * 3), (5, [float("inf"), 0.0, 0.0]), (None, v),
            (10, [0.0, 0.0, 0.0]), (11, [1.0]), (12, []), (7, [.001, -.001, 0.0]), (15, [1.0, 2.0, 3.0, 4.0])]
    check(make, rows)
    check(make, [(50, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [.5, 0.0]), (50, [2.0, 0.0]), (1, [1.0, 0.0])] * 3, shard_rows=2, query_rows=2)
    check(make, [(0, v)])
    check(make, [])


def test_copies_of_queries_are_not_built_in_the_driver(make):
    """The planner's estimate misses that a query travels once a shard."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * 300).tolist()) for i in range(200)]  # beyond 16 bits
    found = topk.top_k(make(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 5 == 0, shard_rows=10, query_rows=8)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    check(make, rows, shard_rows=10, query_rows=8, most_rows=3)
