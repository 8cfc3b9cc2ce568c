"""Hand values and properties of the operators."""

import math
from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stowage.functions import exprs as X
from stowage.operators import anomaly, coldstart, evaluate, features, flights, forecast, hierarchy, models, recommend, tracking, uncertainty
from stowage.plans import dims


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_norm_cdf_matches_erfc(spark):
    z = np.linspace(-9, 9, 181)
    got = [r["p"] for r in spark.createDataFrame([(float(v),) for v in z], "z double").select(X.norm_cdf(F.col("z")).alias("p")).collect()]
    assert np.allclose(got, [0.5 * math.erfc(-v / math.sqrt(2)) for v in z], atol=1e-15)


def test_registered_functions(spark):
    X.register(spark)
    r = spark.sql("SELECT norm_cdf(0D) a, norm_cdf(1.96D) b, pinball(1D, 3D, 0.9D) c, haversine_km(0D, 0D, 0D, 1D) d").first()
    assert r["a"] == pytest.approx(0.5) and r["b"] == pytest.approx(0.9750021, abs=1e-6) and r["c"] == pytest.approx(0.2) and r["d"] == pytest.approx(111.195, abs=1e-2)


def test_bands(spark):
    b = one(spark, X.band(F.lit(1.0), F.lit(2.0)))
    assert (b["q05"], b["q50"]) == (0.0, 1.0) and b["q95"] == pytest.approx(4.29)
    assert one(spark, X.band(F.lit(10.7), F.lit(2.0), whole=True))["q50"] == 10.0


def test_federal_holidays_match_pandas():
    from pandas.tseries.holiday import USFederalHolidayCalendar

    want = [d.date() for d in USFederalHolidayCalendar().holidays("1990-01-01", "2030-12-31")]
    assert dims.federal_holidays(date(1990, 1, 1), date(2030, 12, 31)) == want


def test_inventory_ratio(spark):
    rows = [("A", t, s) for t, n, a in (("AKE", 50, 30), ("AKH", 15, 10), ("PMC", 20, 15)) for s in ["serviceable"] * a + ["damaged"] * (n - a)]
    out = tracking.inventory_maps(tracking.inventory(spark.createDataFrame(rows, "station string, uld_type string, status string"))).first()
    assert (out["total_count"], out["total_available"]) == (85, 55) and out["availability_ratio"] == pytest.approx(55 / 85)


def test_latest_position_ignores_arrival_order(spark):
    rows = [("u", "JFK", datetime(2024, 1, 1, 12), 3), ("u", "ATL", datetime(2024, 1, 1, 10), 9), ("u", "DTW", datetime(2024, 1, 1, 11), 5)]
    assert tracking.latest_position(spark.createDataFrame(rows, "uld_id string, station string, ts timestamp_ntz, id long")).first()["station"] == "JFK"


def test_cost_benefit_hand_values(spark):
    c = recommend.cost_benefit(F.lit(2), F.lit(0.5), F.lit("ground"))
    assert one(spark, c["total_cost"]) == 400 and one(spark, c["total_benefit"]) == 750 + 1500


def test_load_plan_skips_and_goes_on(spark):
    rows = [("f", 1, "a", 50.0), ("f", 2, "b", 60.0), ("f", 3, "c", 40.0)]
    p = flights.load_plan(spark.createDataFrame(rows, "flight string, seq int, uld_id string, kg double"), 3, 100.0).first()
    assert (p["used"], p["kg"], p["refused"]) == (2, 90.0, 1)


def test_running_stock_equals_fold(spark):
    rng = np.random.default_rng(1)
    d = rng.normal(0, 10, 200)
    rows = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(d)], "k string, i int, d double")
    got = [r["stock"] for r in forecast.running_stock(rows, ["k"], ["i"], F.col("d"), 20.0).orderBy("i").collect()]
    want, s = [], 20.0
    for v in d:
        s = max(0.0, s + v)
        want.append(s)
    assert np.allclose(got, want)


def test_horizon_checks_arguments(spark):
    keys = spark.createDataFrame([("ATL",)], "station string")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    assert forecast.horizon(keys, at, 30, "daily").count() == 2
    with pytest.raises(ValueError):
        forecast.horizon(keys, at, 169)


def test_greedy_uses_nearest_and_caps(spark):
    rows = [("n", "ATL", -30.0), ("n", "DTW", 25.0), ("n", "SLC", 50.0)]
    moves = recommend.greedy_moves(spark.createDataFrame(rows, "network string, station string, q50 double"), dims.distances(spark)).orderBy("step").collect()
    assert [(m["origin"], m["quantity"]) for m in moves] == [("DTW", 20), ("DTW", 5), ("SLC", 5)]


def test_ewma_matches_pandas(spark):
    v = np.random.default_rng(0).uniform(0, 100, 300)
    rows = spark.createDataFrame([("k", i, float(x)) for i, x in enumerate(v)], "k string, d int, y double")
    got = [r["ewm_7"] for r in features.ewma(rows, "k", "d", "y", (7,)).orderBy("d").collect()]
    assert np.allclose(got, pd.Series(v).ewm(span=7).mean(), rtol=1e-8)


def test_travel_period_crosses_the_year(spark):
    days = spark.createDataFrame([(date(2024, 12, 31),), (date(2024, 1, 3),), (date(2024, 2, 1),)], "d date")
    assert [r["t"] for r in days.select(features.is_travel_period(F.col("d")).alias("t")).collect()] == [True, True, False]


def test_conformal_quantile_matches_numpy(spark):
    s = np.random.default_rng(3).exponential(size=57)
    rows = spark.createDataFrame([("k", float(v)) for v in s], "k string, s double")
    q = uncertainty.score_quantile(rows, ["k"], F.col("s")).first()["q"]
    assert q == pytest.approx(np.quantile(s, min(math.ceil(58 * 0.9) / 57, 1)))


def test_crps_equals_pairs(spark):
    x, y = [3.0, 1.0, 7.0, 4.0], 2.0
    pairs = sum(abs(a - b) for a in x for b in x) / (4 * 3)
    want = np.mean(np.abs(np.array(x) - y)) - pairs / 2
    assert one(spark, X.crps_samples(F.lit(y), F.array(*map(F.lit, x)))) == pytest.approx(want)


@pytest.mark.parametrize("method", ["ols", "wls_structural", "wls_variance", "mint"])
def test_projection_is_coherent(method):
    _, _, s = hierarchy.summing_matrix([("all", "a"), ("all", "b"), ("all", "c"), ("x", "a"), ("x", "b"), ("a", "a"), ("b", "b"), ("c", "c")])
    p = hierarchy.projection(s, method, np.random.default_rng(0).normal(size=(50, len(s))))
    assert np.allclose(p @ s, s)


def test_temporal_matrix():
    s = hierarchy.temporal_matrix()
    assert s.shape == (1 + 4 + 28, 28) and (s.sum(1)[:5] == [28, 7, 7, 7, 7]).all()


def test_change_point_is_found(spark):
    x = np.r_[np.zeros(40), np.full(40, 8.0)] + np.random.default_rng(0).normal(0, 1, 80)
    rows = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)], "k string, t int, x double")
    out = anomaly.change_points(rows, "k", ["t"], "x", hazard=0.02, prior_var=100.0, var=1.0).toPandas().sort_values("position")
    assert out["run_length"].iloc[39] > 20 and out["run_length"].iloc[45] < 10


def test_isolation_forest_finds_the_far_point(spark):
    x = np.r_[np.random.default_rng(0).normal(0, 1, (300, 2)), [[9.0, 9.0]]]
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, a double, b double")
    assert anomaly.isolation_scores(rows, ["a", "b"], trees=50).orderBy(F.desc("score")).first()["id"] == 300


def test_cusum_of_exactly_the_limit_is_no_alarm(spark):
    rows = [("a", i, 0.1) for i in range(10)] + [("b", 0, 0.1), ("b", 1, 0.2)] + [("c", 0, 0.1), ("c", 1, 0.2001)]
    out = anomaly.cusum(spark.createDataFrame(rows, "k string, t int, x double"), "k", ["t"], "x", 0.0, 0.0, 0.3).collect()
    alarms = {(r["k"], r["t"]): r["alarm"] for r in out}
    assert 0.1 + 0.2 > 0.3 and not alarms["b", 1] and not alarms["a", 2] and alarms["a", 3] and alarms["c", 1]


def test_cusum_reset_of_exactly_the_limit():
    s = anomaly.CusumState(50.0, 5.0, 60.0)
    assert [s.update(v)[2] for v in (17.55, 43.58, 13.87, 44.9)] == [None, None, None, "down"]


def test_cusum_reset_state():
    s = anomaly.CusumState(0.0, 0.0, 5.0)
    assert [s.update(v)[2] for v in (3.0, 3.0, 3.0)] == [None, "up", None]


def test_series_are_stepped_by_batch(spark):
    """Many short series, one longer than a batch, a series without a key, values that are null and orders that are null: no group of Python each."""
    rng = np.random.default_rng(3)
    rows = [(f"s{k}", t, float(v)) for k in range(40) for t, v in enumerate(rng.exponential(50, 1 + k % 4).round(2))]
    rows += [("long", t, float(v)) for t, v in enumerate(rng.exponential(50, 30).round(2))] + [(None, 1, 170.0), (None, 0, None), (None, None, 20.0)]
    t = spark.createDataFrame(rows, "k string, t int, x double").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        cusum, changes = anomaly.cusum_with_reset(t, "k", ["t"], "x", 50.0, 5.0, 60.0), anomaly.change_points(t, "k", ["t"], "x", mean=50.0, prior_var=400.0, var=900.0)
        for out, begin in ((cusum, lambda: anomaly.CusumState(50.0, 5.0, 60.0)), (changes, lambda: anomaly.RunLengths(0.01, 50.0, 400.0, 900.0))):
            want = []
            for k in {r[0] for r in rows}:
                own = begin()
                values = [r[2] for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is None, r[1]))]
                want += [(k, i, *own.update(float("nan") if v is None else v)) for i, v in enumerate(values, 1)]
            by = lambda r: (r[0] is None, r[0] or "", r[1])
            assert sorted(map(tuple, out.collect()), key=by) == sorted(want, key=by)
            assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_posterior_without_data_is_the_prior(spark):
    m, v = coldstart.posterior(F.lit(7.0), F.lit(3.0), F.lit(0), F.lit(None).cast("double"), F.lit(None).cast("double"))
    assert (one(spark, m), one(spark, v)) == (7.0, 3.0)


def test_folds():
    f = evaluate.folds(400)
    assert f[0] == {"fold": 0, "train_start": 0, "train_end": 365, "test_start": 366, "test_end": 373} and len(f) == 5 and evaluate.folds(100) == []


def test_models_fit(spark):
    rows = spark.createDataFrame([(i, float(i % 10), float(3 * (i % 10) + i % 2)) for i in range(200)], "id int, x double, y double")
    assert models.importance(models.gradient_boosting(rows, ["x"], "y", rounds=5))[0][0] == "x"
    q = models.quantile_forest(rows, rows.limit(5), ["x"], "y", [0.1, 0.9], trees=3).first()
    assert q["q_0.1"] <= q["q_0.9"]
    assert "prediction" in models.seasonal_regression(rows, ["x"], "y").transform(rows).columns


def test_ewma_reads_the_whole_past(spark):
    """Series of 1,000 rows with nulls, over several blocks, against pandas."""
    rng = np.random.default_rng(5)
    x = rng.normal(50, 20, 1000)
    values = [None if i % 97 == 5 else float(v) for i, v in enumerate(x)]
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, d int, y double")
    spans = (1, 2, 3, 7, 28, 2000)
    got = features.ewma(rows, "k", "d", "y", spans).orderBy("d").toPandas()
    for span in spans[1:]:
        want = pd.Series([np.nan if v is None else v for v in values]).ewm(span=span, adjust=True).mean()
        assert np.allclose(got[f"ewm_{span}"], want, rtol=1e-9)


def test_tree_reconciles_as_the_matrix_does(spark):
    """An uneven tree against the projection by dense matrices."""
    pairs = [("r", "a"), ("r", "b"), ("r", "x"), ("a", "a1"), ("a", "a2"), ("b", "b1"), ("b1", "b11"), ("b1", "b12"), ("b1", "b13")]
    edges = spark.createDataFrame([(c, p) for p, c in pairs], "child string, parent string")
    nodes, _, s = hierarchy.summing_matrix([(x["node"], x["leaf"]) for x in hierarchy.closure(edges).collect()])
    rng = np.random.default_rng(3)
    y = {n: float(v) for n, v in zip(nodes, rng.normal(10, 3, len(nodes)))}
    base = spark.createDataFrame(list(y.items()), "node string, yhat double")
    for method in ("ols", "wls_structural"):
        want = dict(zip(nodes, hierarchy.projection(s, method) @ np.array([y[n] for n in nodes])))
        got = {x["node"]: x["yhat"] for x in hierarchy.reconcile_tree(base, edges, method=method).collect()}
        assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-9 for n in want)


def test_closure_beyond_a_million_rows(spark):
    leaf = F.col("id").cast("string")
    edges = spark.range(400_000).select(leaf.alias("child"), F.concat(F.lit("g"), (F.col("id") % 100).cast("string")).alias("parent"))
    edges = edges.unionByName(spark.range(100).select(F.concat(F.lit("g"), leaf).alias("child"), F.lit("all").alias("parent")))
    assert hierarchy.closure(edges).count() == 1_200_000
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "child string, parent string")
    with pytest.raises(ValueError, match="cycle"):
        hierarchy.closure(loop, most_levels=5)


def test_point_and_band(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(x), float(10 * x + rng.normal())) for i, x in enumerate(rng.uniform(0, 1, 400))]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = models.point_and_band(df, df.drop("y"), ["x"], "y", [0.1, 0.5, 0.9], rounds=10, trees=5, depth=3)
    assert got.count() == 400 and got.filter("lower > upper OR point IS NULL").isEmpty()
    assert got.join(df.select("id", "y"), "id").agg(F.avg(F.abs(F.col("point") - F.col("y")))).first()[0] < 2


def test_action_plan_without_moves(spark):
    stocks = spark.createDataFrame([("ATL", "AKE", 5.9, 3.2), ("ATL", "PMC", 1.0, 4.0)], "station string, uld_type string, demand double, supply double")
    none = spark.createDataFrame([], "origin string, destination string, quantity int, cost double, benefit double, priority string")
    x = recommend.action_plan(stocks, none, F.lit("2024-01-01").cast("timestamp_ntz")).first()
    assert [t["end_inventory"] for t in x["types"]] == [0, 3] and x["action_count"] == 0 and x["has_critical"] is False


def test_optimizer_totals_of_nothing(spark):
    first = spark.createDataFrame([], "imbalance_q05 double, shortage_probability double")
    x = recommend.optimizer_totals(first, spark.createDataFrame([], "quantity int, method string"), "optimal").first()
    assert (x["total_system_cost"], x["units_moved"], x["is_optimal"]) == (0.0, 0, True)


def test_display(spark):
    at = F.lit("2024-01-05 14:30:00").cast("timestamp_ntz")
    x = spark.range(1).select(X.number_text(F.lit(1234.5678)), X.percent_text(F.lit(0.123)), X.date_text(at), X.urgency_hours(at, at - F.expr("INTERVAL 90 MINUTE"))).first()
    assert tuple(x) == ("1,234.568", "12.3%", "Jan 5, 02:30 PM", 1.5)
