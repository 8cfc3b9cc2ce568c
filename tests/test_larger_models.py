"""Temporal and sparse reconciliation, smoothing, boosting, decomposition, lag selection and delta tables against plain computations."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.operators import boosting, decompose, hierarchy, lag_selection, models, reconcile, smoothing, temporal
from stowage.sources.deltas import DeltaTable


# ---- temporal ----
@pytest.mark.parametrize("method", ["ols", "structural"])
def test_temporal_against_the_dense_projection(spark, method):
    rng = np.random.default_rng(1)
    y = {k: (rng.normal(10, 3, 24), rng.normal(30, 5, 8), rng.normal(120, 9, 2)) for k in "ab"}
    days = [(k, t, float(v)) for k in y for t, v in enumerate(y[k][0])]
    threes = [(k, b, float(v)) for k in y for b, v in enumerate(y[k][1])]
    twelves = [(k, b, float(v)) for k in y for b, v in enumerate(y[k][2])]
    frame = lambda rows, c: spark.createDataFrame(rows, f"k string, {c} long, yhat double")
    out = temporal.reconcile_temporal(frame(days, "step"), [(3, frame(threes, "block")), (12, frame(twelves, "block"))], method=method)
    got = {(r["k"], r["size"], r["block"]): r["yhat"] for r in out.collect()}
    s = np.vstack([np.kron(np.eye(2), np.ones((1, 12))), np.kron(np.eye(8), np.ones((1, 3))), np.eye(24)])
    w = np.diag(1 / s.sum(1)) if method == "structural" else np.eye(len(s))
    for k, (d, t, m) in y.items():
        want = s @ np.linalg.solve(s.T @ w @ s, s.T @ w @ np.concatenate([m, t, d]))
        own = [got[k, 12, b] for b in range(2)] + [got[k, 3, b] for b in range(8)] + [got[k, 1, b] for b in range(24)]
        assert np.allclose(own, want)


def test_temporal_with_gaps(spark):
    days = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("a", 5, 4.0), ("a", 6, None)], "k string, step long, yhat double")
    own = spark.createDataFrame([("a", 0, 9.0), ("a", 1, None), ("b", 0, 1.0)], "k string, block long, yhat double")
    got = {(r["size"], r["block"]): r["yhat"] for r in temporal.reconcile_temporal(days, [(3, own)]).collect()}
    assert got[3, 1] == 4.0 == got[1, 5] and got[1, 0] + got[1, 1] == pytest.approx(got[3, 0]) and got[3, 0] == pytest.approx((3 / 2 + 9) / (1 / 2 + 1)) and len(got) == 5
    with pytest.raises(ValueError):
        temporal.reconcile_temporal(days, [(3, own), (7, own)])


# ---- smoothing ----
def by_loop(t, y, period, parameters):
    alpha, beta, gamma = parameters
    level, trend, season, sse = y[0], 0.0, [0.0] * period, 0.0
    for when, v in zip(t, y, strict=True):
        e = v - (level + trend + season[when % period])
        level, trend, sse = level + trend + alpha * e, trend + beta * e, sse + e * e
        season[when % period] += gamma * e
    return sse, level, trend, season


@pytest.mark.parametrize("block", [5, 64, 10_000])
def test_smoothing_against_a_loop(spark, block):
    rng = np.random.default_rng(2)
    series = {}
    for k in range(5):
        t = np.sort(rng.choice(400, 150 if k else 1, replace=False)) - 50
        series[k] = (t, 50 + 0.1 * k * t + 5 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 2, len(t)))
    rows = [(k, int(a), float(b)) for k, (t, y) in series.items() for a, b in zip(t, y, strict=True)] + [(0, None, 1.0), (1, 9999, None), (None, 1, 1.0)]
    got = {r["k"]: r for r in smoothing.fit(spark.createDataFrame(rows, "k int, t long, y double"), "k", "t", "y", block=block).collect()}
    assert set(got) == set(series)
    for k, (t, y) in series.items():
        every = [by_loop(t, y, 7, g) for g in smoothing.GRID]
        best = min(range(len(every)), key=lambda i: (round(every[i][0], 6), i))
        sse, level, trend, season = every[best]
        r = got[k]
        assert (r["alpha"], r["beta"], r["gamma"]) == smoothing.GRID[best] and r["n"] == len(t) and r["last_time"] == t[-1]
        assert np.allclose([r["sse"], r["level"], r["trend"], *r["season"]], [sse, level, trend, *season])


def test_smoothing_forecast(spark):
    m = spark.createDataFrame([("a", 10, 5.0, 0.5, [0.0, 1.0, 2.0])], "k string, last_time long, level double, trend double, season array<double>")
    assert [r["yhat"] for r in smoothing.forecast(m, "k", 3, period=3).orderBy("step").collect()] == [7.5, 6.0, 7.5]


# ---- sparse reconciliation ----
@pytest.fixture(scope="module")
def tree(spark):
    rng = np.random.default_rng(3)
    pairs = [("a", "all"), ("b", "all"), ("c", "all")] + [(f"{p}{i}", p) for p, n in (("a", 2), ("b", 3), ("c", 1)) for i in range(n)]
    edges = spark.createDataFrame(pairs, "child string, parent string")
    closure = [(r["node"], r["leaf"]) for r in hierarchy.closure(edges).collect()]
    nodes, leaves, s = hierarchy.summing_matrix(closure)
    e = rng.normal(size=(12, len(leaves))) @ rng.normal(size=(len(leaves), len(leaves)))
    e = e @ s.T + rng.normal(size=(12, len(nodes)))
    y = rng.normal(20, 5, len(nodes))
    return edges, nodes, s, e, y


@pytest.mark.parametrize("method", ["ols", "wls_variance", "mint"])
def test_conjugate_gradients_give_the_projection(spark, tree, method):
    edges, nodes, s, e, y = tree
    res = spark.createDataFrame([(n, t, float(e[t, i])) for i, n in enumerate(nodes) for t in range(len(e))], "node string, obs int, e double")
    base = spark.createDataFrame([(n, k, float(y[i] * k)) for i, n in enumerate(nodes) for k in (1, 3)], "node string, draw int, yhat double")
    got = {(r["node"], r["draw"]): r["yhat"] for r in reconcile.reconcile_sparse(base, edges, method=method, residuals=res, key="draw").collect()}
    want = hierarchy.projection(s, method, e) @ y
    assert all(np.allclose([got[n, k] for n in nodes], want * k, atol=1e-6) for k in (1, 3))
    if method == "wls_variance":
        out = hierarchy.reconcile_tree(base.filter("draw = 1"), edges, method=method, variances=reconcile.variances(res))
        assert np.allclose([{r["node"]: r["yhat"] for r in out.collect()}[n] for n in nodes], want)
    if method == "mint":
        p, w = hierarchy.projection(s, method, e), hierarchy.shrunk_covariance(e)
        rows = reconcile.covariance_of(spark.createDataFrame([("b",), ("a1",)], "node string"), edges, res).collect()
        want = hierarchy.reconciled_covariance(s, p, w)
        assert all(r["covariance"] == pytest.approx(want[nodes.index(r["node"]), nodes.index(r["other"])], abs=1e-5) for r in rows) and len(rows) == 2 * len(nodes)


def test_reconciliation_says_what_it_needs(spark, tree):
    edges = tree[0]
    base = spark.createDataFrame([("all", 1.0)], "node string, yhat double")
    with pytest.raises(ValueError, match="needs residuals"):
        reconcile.reconcile_sparse(base, edges, method="mint")
    with pytest.raises(ValueError, match="unknown method"):
        reconcile.reconcile_sparse(base, edges, method="best")


# ---- boosting ----
def test_boosting_beats_the_forest_on_held_out_rows(spark):
    rng = np.random.default_rng(4)
    n = 3000
    a, b = rng.uniform(0, 1, n), rng.uniform(0, 1, n)
    y = 10 * np.sin(6 * a) + 4 * b + rng.normal(0, 0.5 + 3 * b, n)
    df = spark.createDataFrame([(i, float(a[i]), float(b[i]), float(y[i])) for i in range(n)], "id long, a double, b double, y double").repartition(4).cache()
    train, valid, test = df.filter("id % 3 = 0"), df.filter("id % 3 = 1"), df.filter("id % 3 = 2").cache()
    levels = [0.1, 0.5, 0.9]
    model = boosting.fit_quantiles(train, ["a", "b"], "y", levels, rounds=10, depth=3, rate=0.5, valid=valid, patience=3)
    out = model.predict(test).cache()
    loss = lambda rows: rows.agg(F.avg(boosting.pinball(F.col("y"), F.array(*[F.col(f"`q_{q}`") for q in levels]), levels))).first()[0]
    forest = models.quantile_forest(train, test, ["a", "b"], "y", levels, trees=10, depth=5)
    assert loss(out) < loss(forest) and out.filter("`q_0.1` > `q_0.5` OR `q_0.5` > `q_0.9`").isEmpty()
    assert 0.7 < out.filter("y BETWEEN `q_0.1` AND `q_0.9`").count() / out.count() < 0.9
    # what a batch of columns says, trees say row by row
    some = np.array([[0.3, 0.9], [np.nan, 0.1]])
    got = model.predict(spark.createDataFrame([(0.3, 0.9), (None, 0.1)], "a double, b double")).collect()
    assert np.allclose([[r[f"q_{q}"] for q in levels] for r in got], model.raw(some))
    nothing = boosting.fit_quantiles(train.limit(0), ["a", "b"], "y", levels)
    assert nothing.predict(test.limit(2)).filter("`q_0.5` IS NOT NULL").isEmpty()


# ---- decomposition ----
def test_decomposition_is_the_ridge_solution_and_finds_the_break(spark):
    rng = np.random.default_rng(5)
    day = np.arange(900)
    trend = 100 + 0.05 * day + np.where(day > 415, 0.4 * (day - 415), 0)
    y = trend + 8 * np.sin(2 * np.pi * day / 7) + rng.normal(0, 3, 900)
    start = dt.date(2020, 1, 1)
    rows = [("a", start + dt.timedelta(days=int(d)), float(v)) for d, v in zip(day, y, strict=True)] + [("one", start, 7.0), ("a", None, 1.0), (None, start, 1.0)]
    df = spark.createDataFrame(rows, "k string, d date, y double").repartition(3)
    fitted = decompose.fit(df, "k", "d", "y")
    model = {r["k"]: r for r in fitted.collect()}
    number = (start - dt.date(1970, 1, 1)).days
    x = decompose.design(day / 899, day + float(number), decompose.break_places(12), decompose.SEASONS)
    ridge = np.diag([1e-6] * 2 + [0.5] * 12 + [1e-6] * (x.shape[1] - 14))
    assert np.allclose(model["a"]["weights"], np.linalg.solve(x.T @ x + ridge, x.T @ y), atol=1e-6) and model["one"]["n"] == 1
    changes = {r["day"]: r["change"] for r in decompose.slope_changes(fitted.filter("k = 'a'"), "k").collect()}
    where = max(changes, key=lambda d: abs(changes[d]))
    assert abs((where - start).days - 415) < 70 and sum(changes.values()) == pytest.approx(0.4, abs=0.1)
    own = decompose.components(df.filter("k = 'a' AND d IS NOT NULL"), fitted, "k", "d")
    band = own.join(decompose.residual_band(own, "k", "y"), "k").filter("y BETWEEN yhat + low AND yhat + high").count() / 900
    assert 0.75 <= band <= 0.85


# ---- lags ----
def test_planted_lags_are_found(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k, lags in (("x", (3, 14)), ("y", (7,))):
        v = list(rng.normal(size=30))
        for _ in range(1500):
            v.append(sum(0.65 * v[-n] for n in lags) / len(lags) ** 0.5 + rng.normal() * 0.5)
        rows += [(k, t, float(a)) for t, a in enumerate(v)]
    out = lag_selection.select_lags(spark.createDataFrame(rows + [("few", 1, 1.0), (None, 1, 1.0)], "k string, t int, y double"), "k", "t", "y", (1, 2, 3, 7, 14), choose=2)
    got = {(r["k"], r["step"]): r["lag"] for r in out.collect()}
    assert {got["x", 1], got["x", 2]} == {3, 14} and got["y", 1] == 7 and not any(k == "few" for k, _ in got)


# ---- delta tables ----
def test_delta_table(spark, tmp_path):
    schema = "id long, state string, at long"
    t = DeltaTable(spark, str(tmp_path / "t"), schema, "id", "at", buckets=4)
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    now = lambda df=None: sorted((r["id"], r["state"], r["at"]) for r in (t.read() if df is None else df).collect())
    assert now() == []
    t.change(spark.range(1000).select("id", F.lit("new").alias("state"), F.lit(1).cast("long").alias("at")), 0)
    t.upsert(rows((5, "late", 0), (6, "moved", 3), (6, "less", 2), (None, "x", 9)), 1)
    assert [r for r in now() if r[0] in (5, 6)] == [(5, "new", 1), (6, "moved", 3)]
    size = sum(f.stat().st_size for f in (tmp_path / "t" / "delta=1").rglob("*.parquet"))
    assert size < 0.6 * sum(f.stat().st_size for f in (tmp_path / "t" / "delta=0").rglob("*.parquet")) and spark.read.parquet(str(tmp_path / "t" / "delta=1")).count() == 2
    before = now()
    t.upsert(rows((5, "late", 0), (6, "moved", 3), (6, "less", 2), (None, "x", 9)), 1)  # the same batch again
    assert now() == before
    t.update_where(F.col("id") < 3, 2, state=F.lit("done"))
    t.delete_where(F.col("id") >= 10, 3)
    want = [(i, "done" if i < 3 else "moved" if i == 6 else "new", 3 if i == 6 else 1) for i in range(10)]
    assert now() == want and now(t.read(upto=1)) == before and now(t.lookup(6)) == [(6, "moved", 3)] and now(t.lookup(10)) == []
    t.compact()
    t.vacuum()
    assert now() == want and t.parts() == ["base=3"] and t.folders("delta") == []
    t.change(rows((10, "back", 5)), 4)
    assert now()[-1] == (10, "back", 5) and t.parts() == ["base=3", "delta=4"]
