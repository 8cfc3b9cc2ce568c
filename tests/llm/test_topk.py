import math

import numpy as np

from stowage.llm import topk


def brute(rows, every, k):
    ok = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in ok if j != i)[:k]
            out[i] = [(j, -s) for s, j in best]
    return out


def test_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 16)]) for i in range(600)]
    rows += [(700 + i, rows[3][1]) for i in range(60)] + [(800, None), (820, [float("nan")] * 16), (840, [None] * 16), (860, [float("inf")] + [0.0] * 15), (None, rows[0][1]), (880, [0.5] * 4), (900, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, SCORE int")
    out: dict = {}
    for r in topk.top_k(df, pivots=8, rings=4, sample=128, unit=50, query_block=10).collect():
        out.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = brute(rows, 20, 20)
    assert {q: [v[i] for i in sorted(v)] for q, v in out.items()} == want and all(sorted(v) == list(range(1, len(v) + 1)) for v in out.values())


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(df).count() == 4
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(spark.createDataFrame([(7, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_integers_beyond_floats():
    big = np.array([[2**40 + 1, 3]], dtype=np.int64)
    assert topk.inner_products(big, np.array([[2**20, 1]], dtype=np.int64))[0, 0] == (2**40 + 1) * 2**20 + 3


def test_bounds_hold_and_prune_where_vectors_cluster():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 40, (16, 32))
    x = centres[rng.integers(0, 16, 4000)] + rng.normal(0, 2, (4000, 32))
    d = topk.distances(x, centres)
    cell, far = d.argmin(1), d.min(1)
    low, high, norm = (np.array([f(v[cell == c]) for c in range(16)]) for f, v in ((np.min, far), (np.max, far), (np.max, (x * x).sum(1))))
    q = x[:50]
    bound, scores = topk.score_bounds(q, centres, low, high, norm), q @ x.T
    assert all((bound[:, c] >= scores[:, cell == c].max(1)).all() for c in range(16))
    floor = np.sort(scores, axis=1)[:, -21]
    assert (bound >= floor[:, None]).mean() < 0.2


def test_rows_that_repeat_an_id(spark):
    """Both rows are candidates, both ask, and their candidates are pooled."""
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (3, [1.0, 0.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<float>")
    out = [(r["query_id"], r["vec_id"], r["score"]) for r in topk.top_k(df).orderBy("rank").collect()]
    assert out == [(0, 3, 8192), (0, 3, 4096), (0, 3, 0), (0, 3, 0)]
