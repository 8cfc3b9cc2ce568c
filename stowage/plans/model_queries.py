"""Queries over the larger models: whole tables as series, hierarchies, schedules and changing tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions import exprs as X
from stowage.functions.bounds import small
from stowage.functions.shared import cut, new_folder
from stowage.operators import anomaly, boosting, decompose, features, forecast, hierarchy, lag_selection, reconcile, smoothing, temporal
from stowage.plans import bindings as B
from stowage.plans import dims
from stowage.plans.registry import query, rounded
from stowage.sources.deltas import DeltaTable
from stowage.streaming import ordered

DEMAND = "(SELECT l_returnflag AS k, l_shipdate::DATE AS d, sum(l_quantity) AS y FROM lineitem GROUP BY ALL)"


# ---- temporal hierarchies ----
def temporal_parts(spark, sf_dir) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """Day forecasts (a week before), and those of weeks and four weeks (two and four weeks before), from the 29th row of each series on."""
    w = Window.partitionBy("k").orderBy("d")
    rows = B.demand(spark, sf_dir).select("k", (F.row_number().over(w) - 29).alias("step"), *[F.lag("y", n).over(w).alias(f"y{n}") for n in (7, 14, 28)]).filter("step >= 0")
    block = lambda size, y, scale: (size, rows.groupBy("k", F.floor(F.col("step") / size).alias("block")).agg((scale * F.sum(y)).alias("yhat")))
    return rows.select("k", "step", F.col("y7").alias("yhat")), [block(7, "y14", 1.0), block(28, "y28", 1.02)]


@query(f"""WITH b AS (SELECT k, row_number() OVER w - 29 AS step, lag(y, 7) OVER w AS m0, lag(y, 14) OVER w AS y14, lag(y, 28) OVER w AS y28 FROM {DEMAND} WINDOW w AS (PARTITION BY k ORDER BY d)),
d AS (SELECT *, step // 7 AS w, step // 28 AS m FROM b WHERE step >= 0),
w0 AS (SELECT k, w, any_value(m) AS m, count(*) AS n, sum(m0) AS s, sum(y14) AS own, sum(y28) AS y28 FROM d GROUP BY k, w),
w AS (SELECT *, (s / n + own) / (1.0::DOUBLE / n + 1) AS m1, 1 / (1.0::DOUBLE / n + 1) AS v1 FROM w0),
m0 AS (SELECT k, m, sum(m1) AS s, sum(v1) AS spread, 1.02::DOUBLE * sum(y28) AS own FROM w GROUP BY k, m),
m AS (SELECT *, (s / spread + own) / (1 / spread + 1) AS f FROM m0),
wf AS (SELECT w.k, w.w, w.n, w.s, m1 + v1 * (m.f - m.s) / m.spread AS f FROM w JOIN m ON m.k = w.k AND m.m = w.m),
df AS (SELECT d.k, d.step, m0 + (wf.f - wf.s) / wf.n AS f FROM d JOIN wf ON wf.k = d.k AND wf.w = d.w)
SELECT k, 28 AS size, m AS block, round(f, 6) AS yhat FROM m UNION ALL SELECT k, 7, w, round(f, 6) FROM wf UNION ALL SELECT k, 1, step, round(f, 6) FROM df""")
def temporal_hierarchy(spark, sf_dir):
    days, blocks = temporal_parts(spark, sf_dir)
    return rounded(temporal.reconcile_temporal(days, blocks))


# ---- exponential smoothing ----
GRID = ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {g}::DOUBLE)" for i, (a, b, g) in enumerate(smoothing.GRID))


@query(f"""WITH RECURSIVE s AS (SELECT k, date_diff('day', DATE '1970-01-01', d) AS t, y, row_number() OVER (PARTITION BY k ORDER BY d) AS i FROM {DEMAND}),
g AS (SELECT * FROM (VALUES {GRID}) g(id, alpha, beta, gamma)),
r AS (SELECT k, 0::BIGINT AS i, 0::BIGINT AS t, id, alpha, beta, gamma, y AS level, 0.0::DOUBLE AS trend, [0.0, 0, 0, 0, 0, 0, 0]::DOUBLE[] AS season, 0.0::DOUBLE AS sse FROM s, g WHERE i = 1
  UNION ALL SELECT k, ni, nt, id, alpha, beta, gamma, level + trend + alpha * e, trend + beta * e, list_transform(range(0, 7), lambda j: season[j + 1] + CASE WHEN j = nt % 7 THEN gamma * e ELSE 0 END), sse + e * e
  FROM (SELECT r.*, s.i AS ni, s.t AS nt, s.y - (r.level + r.trend + r.season[s.t % 7 + 1]) AS e FROM r JOIN s ON s.k = r.k AND s.i = r.i + 1)),
b AS (SELECT r.* FROM r JOIN (SELECT k, max(i) AS n FROM s GROUP BY k) x ON x.k = r.k AND x.n = r.i QUALIFY row_number() OVER (PARTITION BY r.k ORDER BY sse, id) = 1)
SELECT k, alpha, beta, gamma, step, round(level + step * trend + season[(t + step) % 7 + 1], 3) AS yhat, round(sqrt(sse / i), 3) AS rmse FROM (SELECT *, unnest(range(1, 15)) AS step FROM b)""")
def ets_baseline(spark, sf_dir):
    """The best of a grid of parameters for each series, and its forecast of two weeks."""
    series = B.demand(spark, sf_dir).withColumn("t", F.unix_date("d"))
    models = smoothing.fit(series, "k", "t", "y")
    out = smoothing.forecast(models, "k", 14).join(models.select("k", "alpha", "beta", "gamma", F.sqrt(F.col("sse") / F.col("n")).alias("rmse")), "k")
    return out.select("k", "alpha", "beta", "gamma", F.col("step").cast("long").alias("step"), F.round("yhat", 3).alias("yhat"), F.round("rmse", 3).alias("rmse"))


# ---- reconciliation with measured variances ----
def hierarchy_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges supplier, nation, region, all; base forecasts of every node (regions a tenth too high); yearly sums as residuals (node, obs, e)."""
    s, n, li = (B.table(spark, sf_dir, t) for t in ("supplier", "nation", "lineitem"))
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    path = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.array(tag("s", "s_suppkey"), tag("n", "n_nationkey"), tag("r", "n_regionkey"), F.lit("all")).alias("nodes"))
    edges = path.select(F.explode(F.array(*[F.struct(F.get("nodes", k).alias("child"), F.get("nodes", k + 1).alias("parent")) for k in range(3)])).alias("e")).select("e.*").distinct()
    sold = li.groupBy("l_suppkey", F.year("l_shipdate").alias("obs")).agg(F.sum("l_quantity").alias("q")).join(path.hint("merge"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.explode("nodes").alias("node"), "obs", "q")
    sums = cut(sold.groupBy("node", "obs").agg(F.sum("q").alias("e")))
    every = path.select(F.explode("nodes").alias("node")).distinct()
    base = every.join(sums.groupBy("node").agg(F.sum("e").alias("y")).hint("merge"), "node", "left").select("node", (F.coalesce("y", F.lit(0.0)) * F.when(F.col("node").startswith("r"), 1.1).otherwise(1.0) / 7.0).alias("yhat"))
    first, last = sums.agg(F.min("obs"), F.max("obs")).first()
    residuals = every.withColumn("obs", F.explode(F.sequence(F.lit(first), F.lit(last)))).join(sums.hint("merge"), ["node", "obs"], "left").na.fill(0.0, ["e"])
    return cut(edges), cut(base), cut(residuals)


@query("""WITH tree AS (SELECT 's' || s_suppkey AS s, 'n' || s_nationkey AS n, 'r' || n_regionkey AS r, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
x AS (SELECT unnest([s, n, r, 'all']) AS node, year(l_shipdate) AS obs, l_quantity AS q FROM lineitem JOIN tree ON l_suppkey = s_suppkey),
z AS (SELECT DISTINCT unnest([s, n, r, 'all']) AS node FROM tree),
o AS (SELECT z.node, obs, coalesce(e, 0) AS e FROM (SELECT node, unnest(range((SELECT min(obs) FROM x), (SELECT max(obs) + 1 FROM x))) AS obs FROM z) z LEFT JOIN (SELECT node, obs, sum(q) AS e FROM x GROUP BY ALL) USING (node, obs)),
base AS (SELECT node, sum(e) * CASE WHEN node LIKE 'r%' THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END / 7 AS y, greatest(var_pop(e), 1e-6) AS d FROM o GROUP BY node),
s AS (SELECT DISTINCT t.s, t.n, y AS mean, d AS var FROM tree t JOIN base ON node = t.s),
n0 AS (SELECT s.n, any_value(t.r) AS r, sum(mean) AS total, sum(var) AS spread FROM s JOIN (SELECT DISTINCT n, r FROM tree) t ON t.n = s.n GROUP BY 1),
n AS (SELECT *, 1 / (1 / spread + 1 / d) AS var, (total / spread + y / d) / (1 / spread + 1 / d) AS mean FROM n0 JOIN base ON node = n),
r0 AS (SELECT r, sum(mean) AS total, sum(var) AS spread FROM n GROUP BY 1),
r AS (SELECT *, 1 / (1 / spread + 1 / d) AS var, (total / spread + y / d) / (1 / spread + 1 / d) AS mean FROM r0 JOIN base ON node = r),
a0 AS (SELECT sum(mean) AS total, sum(var) AS spread FROM r),
a AS (SELECT total, spread, (total / spread + y / d) / (1 / spread + 1 / d) AS v FROM a0 JOIN base ON node = 'all'),
rv AS (SELECT r, r.total, r.spread, mean + var * (a.v - a.total) / a.spread AS v FROM r, a),
nv AS (SELECT n, n.total, n.spread, mean + var * (rv.v - rv.total) / rv.spread AS v FROM n JOIN rv ON rv.r = n.r)
SELECT node, round(v, 3) AS yhat FROM (SELECT 'all' AS node, v FROM a UNION ALL SELECT r, v FROM rv UNION ALL SELECT n, v FROM nv UNION ALL SELECT s, mean + var * (nv.v - nv.total) / nv.spread FROM s JOIN nv ON nv.n = s.n)""")
def reconcile_variance(spark, sf_dir):
    edges, base, residuals = hierarchy_tables(spark, sf_dir)
    return rounded(hierarchy.reconcile_tree(base, edges, method="wls_variance", variances=reconcile.variances(residuals)), 3)


@query()
def reconcile_mint(spark, sf_dir):
    """With the shrunk covariance of the residuals; nodes by nodes are nowhere."""
    edges, base, residuals = hierarchy_tables(spark, sf_dir)
    return rounded(reconcile.reconcile_sparse(base, edges, method="mint", residuals=residuals, tolerance=1e-9), 3)


@query()
def reconciled_spread(spark, sf_dir):
    """Deviations and correlations of the reconciled regions: their rows of the covariance, asked for one by one."""
    edges, _, residuals = hierarchy_tables(spark, sf_dir)
    asked = edges.filter("parent = 'all'").select(F.col("child").alias("node"))
    rows = cut(reconcile.covariance_of(asked, edges, residuals, tolerance=1e-9))
    own = small(rows.filter("node = other").select(F.col("node").alias("o"), F.sqrt("covariance").alias("sd")))
    both = rows.join(own.withColumnsRenamed({"o": "o1", "sd": "sd1"}), F.col("node") == F.col("o1")).join(own, F.col("other") == F.col("o"))
    return both.select("node", "other", F.round("sd1", 3).alias("deviation"), F.round(F.col("covariance") / (F.col("sd1") * F.col("sd")), 6).alias("correlation"))


# ---- models ----
def sales_features(spark, sf_dir) -> DataFrame:
    li = B.table(spark, sf_dir, "lineitem")
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_quantity", "l_discount", "l_tax", F.month("l_shipdate").cast("double").alias("month"), (F.col("l_partkey") % 200).cast("double").alias("part"), F.col("l_extendedprice").alias("y"), (F.crc32(F.col("l_orderkey").cast("string").cast("binary")) % 5).alias("fold"))


FEATURES = ["l_quantity", "l_discount", "l_tax", "month", "part"]


@query()
def quantile_boosting(spark, sf_dir):
    """Quantiles of prices by boosting; fold 0 is held out, fold 1 stops the rounds."""
    rows = sales_features(spark, sf_dir)
    levels = [0.1, 0.5, 0.9]
    model = boosting.fit_quantiles(rows.filter("fold > 1"), FEATURES, "y", levels, rounds=8, rate=0.5, valid=rows.filter("fold = 1"), patience=3)
    return rounded(model.predict(rows.filter("fold = 0")).select("id", "y", *[F.col(f"`q_{q}`").alias(f"q{round(100 * q)}") for q in levels]), 4)


@query()
def trend_decomposition(spark, sf_dir):
    """Trend, season and an 80 % interval of each day of each series."""
    series = B.demand(spark, sf_dir)
    fitted = decompose.components(series, decompose.fit(series, "k", "d", "y"), "k", "d")
    band = decompose.residual_band(fitted, "k", "y")
    return rounded(fitted.join(band, "k").select("k", "d", "trend", "season", "yhat", (F.col("yhat") + F.col("low")).alias("lower"), (F.col("yhat") + F.col("high")).alias("upper")), 4)


LAGS, BINS = (1, 2, 3, 7, 14, 21, 28), 4


def sql_gain(step: int) -> str:
    """CTEs of one greedy step: z (rows with the code of the chosen lags), c (counts), g (gains), t (the lag chosen)."""
    z = "SELECT *, 0 AS z FROM x" if step == 1 else f"SELECT z{step - 1}.* EXCLUDE (z), z * {BINS} + lagged[list_position({list(LAGS)}, lag)] AS z FROM z{step - 1} JOIN t{step - 1} ON t{step - 1}.k = z{step - 1}.k"
    before = " ".join(f"AND NOT EXISTS (SELECT 1 FROM t{s} WHERE t{s}.k = g.k AND t{s}.lag = g.lag)" for s in range(1, step))
    return f"""z{step} AS (SELECT k, b, lagged, z FROM ({z})),
c{step} AS (SELECT k, b, z, lag, x, count(*)::DOUBLE AS n FROM (SELECT k, b, z, unnest({list(LAGS)}) AS lag, unnest(lagged) AS x FROM z{step}) GROUP BY ALL),
g{step} AS (SELECT k, lag, greatest(0, sum(term)) AS gain FROM (SELECT k, lag, n / sum(n) OVER (PARTITION BY k, lag) * ln(n * sum(n) OVER (PARTITION BY k, lag, z) / (sum(n) OVER (PARTITION BY k, lag, z, x) * sum(n) OVER (PARTITION BY k, lag, z, b))) AS term FROM c{step}) GROUP BY ALL),
t{step} AS (SELECT k, {step} AS step, lag, gain FROM g{step} g WHERE true {before} QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(gain, 12) DESC, lag) = 1)"""


@query(f"""WITH o AS (SELECT k, d, y, row_number() OVER (PARTITION BY k ORDER BY y) - 1 AS r, count(*) OVER (PARTITION BY k) AS n FROM {DEMAND}),
e AS (SELECT k, {', '.join(f'max(y) FILTER (r = floor((n - 1) * {j} / {BINS}))  AS e{j}' for j in range(1, BINS))} FROM o GROUP BY k),
b AS (SELECT o.k, d, {' + '.join(f'(y > e{j})::INT' for j in range(1, BINS))} AS b FROM o JOIN e ON e.k = o.k),
l AS (SELECT k, b, [{', '.join(f'lag(b, {n}) OVER (PARTITION BY k ORDER BY d)' for n in LAGS)}] AS lagged FROM b),
x AS (SELECT * FROM l WHERE len(list_filter(lagged, lambda v: v IS NULL)) = 0),
{', '.join(sql_gain(s) for s in (1, 2, 3))}
SELECT k, step, lag, round(gain, 6) AS gain FROM t1 UNION ALL SELECT k, step, lag, round(gain, 6) FROM t2 UNION ALL SELECT k, step, lag, round(gain, 6) FROM t3""")
def informative_lags(spark, sf_dir):
    return rounded(lag_selection.select_lags(B.demand(spark, sf_dir), "k", "d", "y", LAGS, choose=3, bins=BINS))


@query(f"""WITH w AS (SELECT k, d, y, lag(y, 7) OVER (PARTITION BY k ORDER BY d) AS lag_7, avg(y) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS mean_7 FROM {DEMAND})
SELECT k, d, isodow(d) - 1 AS day_of_week, month(d) AS month, lag_7 FROM w""")
def feature_pipeline(spark, sf_dir):
    """The whole pipeline's columns over the daily series; those that plain SQL has are compared."""
    holidays = dims.federal_holidays(date(1991, 12, 1), date(1999, 12, 31))
    rows = features.pipeline(B.demand(spark, sf_dir), "k", "d", "y", holidays)
    return rows.select("k", "d", F.col("day_of_week").cast("long").alias("day_of_week"), F.col("month").cast("long").alias("month"), "lag_7")


# ---- schedules ----
SCHEDULE = f"""(WITH h AS (SELECT station, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour FROM (SELECT DISTINCT user_id % 8 AS station FROM events), (SELECT date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi FROM events)),
n AS (SELECT h.station, hour, count(ts) FILTER (event_type IN ('view', 'purchase')) AS f_out, count(ts) FILTER (event_type IN ('click', 'signup')) AS f_in
  FROM h LEFT JOIN events ON user_id % 8 = h.station AND abs(epoch_us(ts) // 1000000 - epoch_us(hour) // 1000000) < 3600 GROUP BY ALL),
d AS (SELECT station, hour, 8 * f_out AS departures, 8 * f_in AS arrivals, greatest(1, trunc(greatest(CASE WHEN station < 2 THEN 100.0::DOUBLE ELSE 40.0::DOUBLE END * (CASE WHEN hour(hour) BETWEEN 6 AND 10 THEN 1.3::DOUBLE WHEN hour(hour) BETWEEN 11 AND 14 THEN 1.0::DOUBLE WHEN hour(hour) BETWEEN 15 AND 20 THEN 1.2::DOUBLE ELSE 0.5::DOUBLE END) * (CASE WHEN isodow(hour) >= 6 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END), 8.0::DOUBLE * f_out)))::DOUBLE AS demand FROM n),
r AS (SELECT *, trunc(2 * CASE WHEN station < 2 THEN 100 ELSE 40 END)::DOUBLE + sum(arrivals - departures) OVER w AS s FROM d WINDOW w AS (PARTITION BY station ORDER BY hour))
SELECT station, hour, demand, departures, arrivals, s - least(0, min(s) OVER (PARTITION BY station ORDER BY hour)) AS stock FROM r)"""


def scheduled(spark, sf_dir) -> DataFrame:
    e = B.table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("station"), "event_type", "ts", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h"))
    span = e.agg(F.min("h").alias("lo"), F.max("h").alias("hi")).select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    hours = span.withColumn("station", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")))).join(e.select("station").distinct(), "station")
    of = lambda *kinds: e.filter(F.col("event_type").isin(*kinds)).select("station", "ts")
    base = dims.lookup(dims.BASE_DEMAND, F.when(F.col("station") < 2, "hub").otherwise("focus_city"), 10.0)
    return forecast.from_schedule(hours, of("view", "purchase"), of("click", "signup"), base, F.floor(2 * base).cast("double"))


@query(f"SELECT station, hour, demand, departures, arrivals, stock, round(greatest(0, stock - 1.645::DOUBLE * greatest(1, 0.1::DOUBLE * stock)), 4) AS supply_q05, round(demand + 1.645::DOUBLE * greatest(1, 0.15::DOUBLE * demand), 4) AS demand_q95 FROM {SCHEDULE}")
def scheduled_supply(spark, sf_dir):
    """Demand and stock by the schedule's movements, from the default inventory of each tier."""
    rows = scheduled(spark, sf_dir)
    out = rows.withColumns({"supply_q05": forecast.supply_band(F.col("stock"))["q05"], "demand_q95": forecast.demand_band(F.col("demand"))["q95"]})
    return rounded(out.select("station", "hour", "demand", F.col("departures").cast("long").alias("departures"), F.col("arrivals").cast("long").alias("arrivals"), "stock", "supply_q05", "demand_q95"), 4)


@query(f"SELECT station, hour, uld_type, round(stock * share, 4) AS supply, round(greatest(0, stock * share - 1.645::DOUBLE * greatest(1, 0.15::DOUBLE * stock * share)), 4) AS supply_q05 FROM {SCHEDULE}, (VALUES ('AKE', 0.50::DOUBLE), ('AKH', 0.15::DOUBLE), ('PMC', 0.20::DOUBLE), ('AKN', 0.10::DOUBLE), ('AAP', 0.05::DOUBLE)) m(uld_type, share)")
def scheduled_supply_by_type(spark, sf_dir):
    kinds = F.explode(F.array(*[F.struct(F.lit(t).alias("uld_type"), F.lit(s).alias("share")) for t, s in dims.TYPE_MIX]))
    rows = scheduled(spark, sf_dir).withColumn("m", kinds).select("station", "hour", "m.uld_type", (F.col("stock") * F.col("m.share")).alias("supply"))
    return rounded(rows.withColumn("supply_q05", X.band(F.col("supply"), F.greatest(F.lit(1.0), 0.15 * F.col("supply")))["q05"]), 4)


@query("""SELECT l_returnflag AS station, l_shipdate::DATE AS generated_at, l_orderkey, l_linenumber, l_quantity AS q50, step FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS step
FROM (SELECT * FROM lineitem QUALIFY rank() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate DESC) = 1)) WHERE step <= 24""")
def latest_forecast_hours(spark, sf_dir):
    """The first 24 rows of each station's last generation."""
    li = B.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("station"), F.to_date("l_shipdate").alias("generated_at"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("q50"))
    return forecast.first_rows(li, ["station"], ["l_orderkey", "l_linenumber", "l_partkey", "q50"], 24).drop("l_partkey").withColumn("step", F.col("step").cast("long"))


# ---- state in event order, in batch ----
@query("""WITH RECURSIVE b AS (SELECT user_id, event_id, ts, value, CASE WHEN ts - lag(ts) OVER w > INTERVAL 24 HOUR OR lag(ts) OVER w IS NULL THEN epoch_us(ts) END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, last_value(begins IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM b), o AS (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS i FROM s),
f AS (SELECT user_id, session, i, greatest(0, value - 55) AS up, greatest(0, 45 - value) AS down FROM o WHERE i = 1
  UNION ALL SELECT f.user_id, f.session, o.i, greatest(0, CASE WHEN f.up > 60 THEN 0 ELSE f.up END + o.value - 50 - 5), greatest(0, CASE WHEN f.down > 60 THEN 0 ELSE f.down END - (o.value - 50 + 5)) FROM f JOIN o ON o.user_id = f.user_id AND o.session = f.session AND o.i = f.i + 1)
SELECT user_id || ':' || session AS series, i AS position, round(up, 4) AS up, round(down, 4) AS down, CASE WHEN up > 60 THEN 'up' WHEN down > 60 THEN 'down' END AS side FROM f""")
def session_cusum(spark, sf_dir):
    """What the stream operator gives: CUSUM with resets, anew after each silence of a day."""
    e = B.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    rows = ordered.sessions_of(e, idle=24 * ordered.HOUR_MS).withColumn("series", F.concat_ws(":", "user_id", "session"))
    return rounded(anomaly.cusum_with_reset(rows, "series", ["ts", "event_id"], "value", 50.0, 5.0, 60.0), 4)


@query("""WITH p AS (SELECT user_id, ts, event_type AS station FROM events WHERE event_type <> 'purchase'), f AS (SELECT user_id, ts, event_type AS station FROM events WHERE event_type = 'purchase'),
g AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS until FROM p)
SELECT user_id, ts, station, false AS inferred FROM p UNION ALL SELECT g.user_id, f.ts, f.station, true FROM g JOIN f ON f.user_id = g.user_id AND f.ts > g.ts AND (g.until IS NULL OR f.ts < g.until) WHERE g.until IS NULL OR g.until > g.ts + INTERVAL 24 HOUR""")
def supplemented_positions(spark, sf_dir):
    """Pings, and where they fall silent for a day, what flights tell."""
    e = B.table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    return ordered.supplemented(e.filter("event_type <> 'purchase'"), e.filter("event_type = 'purchase'"))


# ---- tables that change ----
@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 30 = 0 THEN 'U' WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 30 = 0 THEN round(2 * o_totalprice, 2) ELSE round(o_totalprice, 2) END AS price FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 30 = 0""")
def delta_changes(spark, sf_dir):
    """Inserts, conditional updates, deletes, a compaction and upserts, as deltas of what changes."""
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.lit(0).cast("long").alias("version"))
    t = DeltaTable(spark, new_folder(spark, "deltas"), "o_orderkey long, status string, price double, version long", "o_orderkey", "version", buckets=8)
    t.change(o, 0)
    t.update_where(F.col("o_orderkey") % 10 == 0, 1, status=F.lit("X"), version=F.lit(1).cast("long"))
    t.delete_where(F.col("o_orderkey") % 7 == 0, 2)
    t.compact()
    t.upsert(o.filter("o_orderkey % 30 = 0").withColumns({"status": F.lit("U"), "price": 2 * F.col("price"), "version": F.lit(2).cast("long")}), 3)
    return t.read().select("o_orderkey", "status", F.round("price", 2).alias("price"))
