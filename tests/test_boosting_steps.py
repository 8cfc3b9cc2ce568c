import numpy as np
from pyspark.sql import functions as F

from stowage.operators import boosting


def test_a_move_asks_each_split_once_and_counts_match_plain_loops(spark):
    tree = boosting.Tree({0: (0, 1), 1: (1, 2), 2: (0, 3)}, {3: 1.5, 4: -2.0, 5: 0.25})
    rng = np.random.default_rng(0)
    bins, y, p = rng.integers(0, 5, (200, 2)), rng.normal(size=200), rng.normal(size=200)
    rows = spark.createDataFrame([(float(a), int(b), int(c), float(d)) for a, (b, c), d in zip(y, bins, p)], "y double, b0 int, b1 int, p0 double")
    move = tree.value([F.col("b0"), F.col("b1")])
    assert str(move).count("CASE WHEN") <= 3
    assert [r["v"] for r in rows.select(move.alias("v")).collect()] == tree.apply(bins).tolist()
    want: dict = {}
    for b, low in zip(bins.tolist(), y < p):
        node = 2 if b[0] > 1 else 1
        for f in (0, 1):
            n, below = want.get((0, node, f, b[f]), (0, 0))
            want[0, node, f, b[f]] = (n + 1, below + int(low))
    got = boosting.counts(rows, [boosting.Tree({0: (0, 1)})], 1, 2, 5).collect()
    assert {tuple(r)[:4]: tuple(r)[4:] for r in got} == want
