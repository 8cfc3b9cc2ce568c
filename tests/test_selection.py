"""Exact order statistics and neighbours against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.plans import catalog, service_queries  # noqa: F401  (catalog registers)
from stowage.operators import coldstart, neighbours, selection, uncertainty


def test_values_at_every_rank_of_hard_keys(spark):
    rng = random.Random(1)
    keys = {
        "ties": [1.0] * 50 + [2.0] * 30 + [3.0], "one": [7.0], "wide": [10.0**rng.randrange(-300, 300) for _ in range(80)], "close": [1.0 + k * 2**-52 for k in range(60)], "ends": [-math.inf] * 3 + [math.inf] * 4 + [1.0, 2.0, 5.0],
        "signs": [-0.0, 0.0, -5.5, 5.5] * 10, "huge": [-1.7e308, 1.7e308, 0.0, 1.0] * 8, None: [rng.gauss(0, 1) for _ in range(90)],
    }
    rows = [(k, v) for k, vs in keys.items() for v in vs] + [("ties", None), ("none", None), ("nan", math.nan), ("ties", math.nan)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, s double").cache()
    for part in (0.37, 1.0):
        got = {r["k"]: r for r in selection.values_at(df, ["k"], F.col("s"), lambda n: (n - 1) * part, bins=4, few=3).collect()}
        assert set(got) == set(keys)
        for k, vs in keys.items():
            at, s = math.floor((len(vs) - 1) * part), sorted(vs)
            assert (got[k]["n"], got[k]["a"], got[k]["b"]) == (len(vs), s[at], s[at + 1] if at + 1 < len(s) else None), (k, part)
    assert selection.values_at(df.limit(0), ["k"], F.col("s"), lambda n: n - 1).count() == 0


def test_quantiles_are_the_linear_ones(spark):
    values = np.random.default_rng(2).lognormal(size=5000)
    df = spark.createDataFrame([(float(v),) for v in values], "s double")
    got = selection.quantiles(df, [], F.col("s"), 0.83, bins=16, few=10).first()["q"]
    assert got == pytest.approx(np.quantile(values, 0.83))


def test_no_window_over_a_whole_key(spark, monkeypatch):
    """Rounds leave at most `few` values of a hot key to sort."""
    seen = []
    cut = selection.cut
    monkeypatch.setattr(selection, "cut", lambda df: seen.append(out := cut(df)) or out)
    df = spark.range(30_000).select((F.col("id") % 2 * 0).alias("k"), F.col("id").cast("double").alias("s"))
    assert selection.quantiles(df, ["k"], F.col("s"), 0.5, bins=64, few=100).first()["q"] == 14_999.5
    last = seen[-1].collect()
    assert max(r["m"] for r in last) <= 500 and len(seen) <= 5


def clustered(rng, n, groups=12, dims=6):
    centres = rng.normal(scale=20, size=(groups, dims))
    return centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dims))


@pytest.mark.parametrize("options", [{"pivots": 5, "rings": 3, "share": 20, "sample": 50}])
def test_neighbours_against_all_pairs(spark, options):
    rng = np.random.default_rng(3)
    x = np.round(clustered(rng, 400), 1)
    x[100:140] = x[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0])], "id long, x array<double>")
    asked = df.filter("id % 9 = 0")
    got = {}
    for r in neighbours.k_nearest(df, asked, 7, others=True, **options).collect():
        got.setdefault(r["asked_id"], []).append((r["d"], r["id"]))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(0, 400, 9):
        want = sorted((d[i, j], j) for j in range(400) if j != i)[:7]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want] or np.allclose([a for a, _ in sorted(got[i])], [a for a, _ in want], atol=1e-12)
    assert neighbours.k_nearest(df, asked, 1000, **options).groupBy("asked_id").count().filter("count <> 400").isEmpty()
    assert neighbours.k_nearest(df.limit(0), asked, 3, **options).count() == 0 and neighbours.k_nearest(df, asked.limit(0), 3, **options).count() == 0


@pytest.mark.parametrize("unit, held, asked_rows", [(50, 300, 10), (10_000, 10**6, 10**6)])
def test_units_of_any_size_keep_ties_and_copies(spark, monkeypatch, unit, held, asked_rows):
    """Copies of each row, in several units and blocks: equal distances go to the least id, and pairs never reach a join."""
    monkeypatch.setattr(neighbours, "UNIT", unit)
    monkeypatch.setattr(neighbours, "HELD", held)
    monkeypatch.setattr(neighbours, "ASKED", asked_rows)
    x = np.tile(np.random.default_rng(6).normal(size=(40, 5)) * 1e3, (6, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    out = neighbours.k_nearest(df, df.filter("id % 10 = 0"), 8, others=True, pivots=4, rings=3, share=20)
    assert "SortMergeJoin" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "CoGroup" in plan
    got = {}
    for r in out.collect():
        got.setdefault(r["asked_id"], []).append((r["d"], r["id"]))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(0, 240, 10):
        assert [j for _, j in sorted(got[i])] == [j for _, j in sorted((d[i, j], j) for j in range(240) if j != i)[:8]]


def test_clustered_rows_are_mostly_left_out(spark):
    x = clustered(np.random.default_rng(4), 6000, 30)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    asked = df.filter("id % 50 = 0")
    index = neighbours.build(df, "id", "x")
    found = neighbours.k_nearest(df, asked, 10, index=index)
    assert neighbours.visited_share(index, asked, 10, found) < 0.15


def test_similar_by_cosine(spark):
    x = np.random.default_rng(5).normal(size=(120, 4))
    x[7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = coldstart.similar(df.filter("id % 10 = 0"), df, k=3, kernel="cosine", pivots=4, rings=4).collect()
    u = x / np.maximum(1e-12, np.linalg.norm(x, axis=1))[:, None]
    for i in range(0, 120, 10):
        want = set(np.argsort(-(u @ u[i]) + (np.arange(120) == i) * 9)[:3].tolist())
        assert {r["other"] for r in got if r["id"] == i} == want


def test_a_query_is_no_neighbour_of_its_own(spark):
    cal = spark.createDataFrame([(i, [float(i)], float(i * i)) for i in range(10)], "cal_id long, x array<double>, score double")
    out = {r["query_id"]: r["q"] for r in uncertainty.local_conformal(cal, cal.select(F.col("cal_id").alias("query_id"), "x"), k=1).collect()}
    assert out[0] == 1.0 and out[9] == 64.0 and all(q != i * i for i, q in out.items())


def test_flown_routes_are_summed_once(spark, sf_dir):
    """What follows reads the table of routes, not flights."""
    plan = service_queries.similar_flown_routes(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "l_suppkey" not in plan
