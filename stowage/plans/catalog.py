"""Every registered query with its DuckDB SQL. A query binds one operator to the test tables and names its columns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions import exprs as X
from stowage.operators import anomaly, coldstart, evaluate, features, flights, forecast, hierarchy, models, recommend, tracking, uncertainty
from stowage.plans import bindings as B
from stowage.plans import dims
from stowage.plans.registry import ORACLES, QUERIES, query, r, rounded  # noqa: F401

# ---- SQL parts ----
def sql_cdf(z: str) -> str:
    def horner(cs, a):
        out = f"{cs[0]!r}::DOUBLE"
        for c in cs[1:]:
            out = f"({out} * {a} + {c!r}::DOUBLE)"
        return out

    a = f"abs({z})"
    b = f"({a} + 0.65::DOUBLE)"
    for k in (4, 3, 2, 1):
        b = f"({a} + {k}.0::DOUBLE / {b})"
    e = f"exp(-{a} * {a} / 2)"
    tail = f"(CASE WHEN {a} < 7.07106781186547::DOUBLE THEN {e} * {horner(X.CDF_NUM, a)} / {horner(X.CDF_DEN, a)} WHEN {a} <= 37 THEN {e} / {b} / 2.506628274631::DOUBLE ELSE 0.0::DOUBLE END)"
    return f"(CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END)"


def sql_values(rows) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)

    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


AS_OF = f"TIMESTAMP '{B.AS_OF}'"
POSITIONS = "(SELECT user_id AS uld_id, event_type AS station, ts, event_id AS id, value FROM events)"
DEMAND = "(SELECT l_returnflag AS k, l_shipdate::DATE AS d, sum(l_quantity) AS y FROM lineitem GROUP BY ALL)"
PREDICTIONS = f"(SELECT *, yhat * 0.5::DOUBLE AS lower, yhat * 1.5::DOUBLE AS upper FROM (SELECT *, lag(y, 7) OVER (PARTITION BY k ORDER BY d) AS yhat FROM {DEMAND}) WHERE yhat IS NOT NULL)"
TYPES = "(['AKE', 'AKH', 'PMC', 'AKN', 'AAP'])[(o_custkey % 5 + 1)::INT]"
ASSETS = f"(SELECT o_orderkey AS uld_id, o_orderpriority AS station, {TYPES} AS uld_type, CASE o_orderstatus WHEN 'F' THEN 'serviceable' WHEN 'O' THEN 'in_use' ELSE 'damaged' END AS status FROM orders)"
FLIGHTS = """(SELECT l_orderkey AS flight_number, l_linenumber, l_suppkey, c_nationkey AS origin, s_nationkey AS destination, o_orderdate AS departure, l_shipdate AS arrival, l_quantity AS units, l_extendedprice AS freight, o_orderstatus
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
FLOWS = """(SELECT g.station_id, g.forecast_time, coalesce(a, 0) / 100.0::DOUBLE AS arrivals, coalesce(dd, 0) / 100.0::DOUBLE AS departures, coalesce(q, 0) / 100.0::DOUBLE AS demand
FROM (SELECT unnest(generate_series(0, 7)) AS station_id, forecast_time FROM (SELECT unnest(generate_series((SELECT min(date_trunc('hour', ts)) FROM events), (SELECT max(date_trunc('hour', ts)) FROM events), INTERVAL 1 HOUR)) AS forecast_time)) g
LEFT JOIN (SELECT user_id % 8 AS station_id, date_trunc('hour', ts) AS forecast_time,
  sum(CASE WHEN event_type IN ('click', 'signup') THEN round(value * 100)::BIGINT ELSE 0 END)::BIGINT AS a, sum(CASE WHEN event_type IN ('view', 'purchase') THEN round(value * 100)::BIGINT ELSE 0 END)::BIGINT AS dd,
  sum(CASE WHEN event_type = 'purchase' THEN round(value * 100)::BIGINT ELSE 0 END)::BIGINT AS q FROM events GROUP BY ALL) s ON s.station_id = g.station_id AND s.forecast_time = g.forecast_time)"""
STOCK = f"""(SELECT *, t - least(0, min(t) OVER w) AS stock FROM (SELECT *, 200.0::DOUBLE + sum(arrivals - departures) OVER w AS t FROM {FLOWS} f WINDOW w AS (PARTITION BY station_id ORDER BY forecast_time ROWS UNBOUNDED PRECEDING)) s
WINDOW w AS (PARTITION BY station_id ORDER BY forecast_time ROWS UNBOUNDED PRECEDING))"""
BANDS = f"""(SELECT *, supply - demand AS mid, sqrt(power((supply + 0.675 * ss - greatest(0, supply - 0.675::DOUBLE * ss)) / 1.35::DOUBLE, 2) + power((demand + 0.675::DOUBLE * sd - greatest(0, demand - 0.675::DOUBLE * sd)) / 1.35::DOUBLE, 2)) AS sigma
FROM (SELECT station_id, forecast_time, demand, stock AS supply, greatest(1.0::DOUBLE, 0.15::DOUBLE * demand) AS sd, greatest(1.0::DOUBLE, 0.1::DOUBLE * stock) AS ss FROM {STOCK}))"""
PROBS = f"(SELECT *, {sql_cdf('z')} AS p FROM (SELECT *, -mid / sigma AS z FROM {BANDS}))"
IMBALANCE = f"SELECT station_id, forecast_time, round(demand, 4) AS demand_q50, round(supply, 4) AS supply_q50, round(mid, 4) AS imbalance_q50, round(mid - 1.645::DOUBLE * sigma, 4) AS imbalance_q05, round(p, 6) AS shortage_probability, CASE WHEN p > 0.8 THEN 'critical' WHEN p > 0.5 THEN 'warning' ELSE 'normal' END AS severity FROM {PROBS}"
FIRST = f"(SELECT * FROM ({IMBALANCE}) QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY forecast_time) = 1)"
STATION_IMB = """(SELECT station, q50, CASE WHEN q50 < -20 THEN 0.9::DOUBLE WHEN q50 < -10 THEN 0.7::DOUBLE WHEN q50 < 0 THEN 0.55::DOUBLE ELSE 0.1::DOUBLE END AS p FROM (
SELECT coalesce(c.n, s.n)::VARCHAR AS station, (coalesce(s, 0) - coalesce(c, 0))::DOUBLE AS q50 FROM (SELECT c_nationkey AS n, count(*) AS c FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS n, count(*) * 15 AS s FROM supplier GROUP BY 1) s ON c.n = s.n))"""
RECS = """(SELECT o_orderkey AS rec_id, (o_custkey % 10)::VARCHAR AS origin, (o_custkey % 7)::VARCHAR AS destination, (o_orderkey % 12 + 1)::INT AS quantity, (o_custkey % 101) / 100.0::DOUBLE AS p, CASE WHEN o_orderkey % 2 = 0 THEN 'ground' ELSE 'flight' END AS method, o_orderdate FROM orders)"""
COSTS = f"""(SELECT *, total_benefit - total_cost AS net_benefit, (total_benefit - total_cost) / nullif(total_cost, 0) AS roi, CASE WHEN p >= 0.8 THEN 'critical' WHEN p >= 0.5 THEN 'high' WHEN p >= 0.3 THEN 'medium' ELSE 'low' END AS priority
FROM (SELECT *, (CASE WHEN method = 'ground' THEN 150.0::DOUBLE ELSE 50.0::DOUBLE END) * quantity + 50.0::DOUBLE * quantity AS total_cost, quantity * p * 500.0::DOUBLE * 1.5::DOUBLE + p * 3000.0::DOUBLE AS total_benefit FROM {RECS}))"""
STATIONS = sql_values([(s[0], s[4], s[5], s[6]) for s in dims.STATIONS])


# ---- forecasts ----
@query(IMBALANCE)
def network_imbalance(spark, sf_dir):
    out = forecast.network_imbalance(B.hourly_flows(spark, sf_dir))
    four = ["demand_q50", "supply_q50", "imbalance_q50", "imbalance_q05"]
    return out.withColumns({c: F.round(c, 4) for c in four}).withColumn("shortage_probability", F.round("shortage_probability", 6))


@query(f"SELECT station_id, forecast_time, round(stock, 4) AS stock FROM {STOCK}")
def supply_clamped(spark, sf_dir):
    rows = forecast.running_stock(B.hourly_flows(spark, sf_dir), ["station_id"], ["forecast_time"], F.col("arrivals") - F.col("departures"), 200.0)
    return rows.select("station_id", "forecast_time", r("stock", 4).alias("stock"))


def first_imbalance(spark, sf_dir):
    return forecast.first_period(network_imbalance(spark, sf_dir), "station_id", "forecast_time")


@query(f"""SELECT count(*) AS stations, round(sum(demand_q50), 4) AS demand, round(sum(supply_q50), 4) AS supply, round(greatest(0, sum(demand_q50) - 1.645::DOUBLE * 5 * sqrt(count(*))), 4) AS demand_q05,
round(sum(supply_q50) + 1.645::DOUBLE * 5 * sqrt(count(*)), 4) AS supply_q95, count(*) FILTER (shortage_probability > 0.5) AS shortage_stations, count(*) FILTER (NOT shortage_probability > 0.5 AND imbalance_q50 > 10) AS surplus_stations,
abs(sum(supply_q50) - sum(demand_q50)) < 0.1::DOUBLE * sum(demand_q50) AS balanced FROM {FIRST}""")
def network_totals(spark, sf_dir):
    return rounded(forecast.network_totals(first_imbalance(spark, sf_dir)), 4)


@query(f"SELECT station_id, shortage_probability, severity, CASE WHEN imbalance_q50 < 0 THEN abs(imbalance_q50) ELSE 0 END AS estimated_shortage FROM {FIRST} ORDER BY shortage_probability DESC, station_id LIMIT 5")
def priority_stations(spark, sf_dir):
    return forecast.priority_stations(first_imbalance(spark, sf_dir)).select("station_id", "shortage_probability", "severity", "estimated_shortage")


@query(f"""WITH s AS (SELECT * FROM (VALUES {STATIONS}) t(station, tier, lat, lon)), m AS (SELECT * FROM (VALUES {sql_values(dims.TYPE_MIX)}) t(uld_type, share)),
h AS (SELECT station, tier, unnest(generate_series(0, 23)) AS step FROM s), f AS (SELECT *, {AS_OF} + INTERVAL 1 HOUR * step AS t FROM h),
p AS (SELECT station, t AS forecast_time, greatest(1, trunc((CASE tier WHEN 'hub' THEN 100.0::DOUBLE ELSE 40.0::DOUBLE END) * (CASE WHEN hour(t) BETWEEN 6 AND 10 THEN 1.3::DOUBLE WHEN hour(t) BETWEEN 11 AND 14 THEN 1.0::DOUBLE WHEN hour(t) BETWEEN 15 AND 20 THEN 1.2::DOUBLE ELSE 0.5::DOUBLE END) * (CASE WHEN isodow(t) >= 6 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END)))::DOUBLE AS demand FROM f),
x AS (SELECT *, trunc(demand * share)::DOUBLE AS q FROM p, m)
SELECT station, forecast_time, uld_type, demand, q AS type_q50, round(greatest(0, q - 1.645::DOUBLE * greatest(1.0, 0.2::DOUBLE * q)), 6) AS type_q05, round(q + 1.645::DOUBLE * greatest(1.0, 0.2::DOUBLE * q), 6) AS type_q95 FROM x""")
def demand_horizon(spark, sf_dir):
    keys = dims.stations(spark).select(F.col("code").alias("station"), "tier")
    rows = forecast.horizon(keys, B.as_of(), 24)
    rows = rows.withColumn("demand", forecast.demand_point(dims.lookup(dims.BASE_DEMAND, F.col("tier"), 10.0), F.col("forecast_time")))
    out = forecast.demand_by_type(rows, dims.TYPE_MIX)
    return out.select("station", "forecast_time", "uld_type", "demand", F.col("type_point").alias("type_q50"), r("type_band.q05").alias("type_q05"), r("type_band.q95").alias("type_q95"))


BY_TYPE = f"""(SELECT station_id, forecast_time, uld_type, trunc(demand * share)::DOUBLE AS d, stock * share AS s FROM {STOCK}, (VALUES {sql_values(dims.TYPE_MIX)}) m(uld_type, share))"""
SPREAD = "sqrt(power((s + 0.675::DOUBLE * ss - greatest(0, s - 0.675::DOUBLE * ss)) / 1.35::DOUBLE, 2) + power((d + 0.675::DOUBLE * sd - greatest(0, d - 0.675::DOUBLE * sd)) / 1.35::DOUBLE, 2))"


@query(f"""SELECT station_id, forecast_time, uld_type, d AS demand_q50, round(s, 4) AS supply_q50, round(s - d, 4) AS imbalance_q50, round(s - d - 1.645::DOUBLE * {SPREAD}, 4) AS imbalance_q05, round(s - d + 1.645::DOUBLE * {SPREAD}, 4) AS imbalance_q95
FROM (SELECT *, greatest(1.0::DOUBLE, 0.2::DOUBLE * d) AS sd, greatest(1.0::DOUBLE, 0.15::DOUBLE * s) AS ss FROM {BY_TYPE})""")
def imbalance_by_type(spark, sf_dir):
    rows = forecast.running_stock(B.hourly_flows(spark, sf_dir), ["station_id"], ["forecast_time"], F.col("arrivals") - F.col("departures"), 200.0)
    out = forecast.imbalance_by_type(rows, dims.TYPE_MIX, dims.TYPE_MIX)
    four = [r(f"{a}_band.{q}", 4).alias(f"{a}_{q}") for a, q in (("supply", "q50"), ("imbalance", "q50"), ("imbalance", "q05"), ("imbalance", "q95"))]
    return out.select("station_id", "forecast_time", "uld_type", F.col("demand_band.q50").alias("demand_q50"), *four)


@query(f"SELECT station_id, CASE WHEN shortage_probability > 0.5 THEN 'shortage' WHEN imbalance_q50 > 10 THEN 'surplus' ELSE 'balanced' END AS state, imbalance_q50 FROM {FIRST}")
def station_states(spark, sf_dir):
    return forecast.station_states(first_imbalance(spark, sf_dir)).select("station_id", "state", "imbalance_q50")


@query(f"""WITH d AS (SELECT station_id AS station, forecast_time, demand, row_number() OVER (PARTITION BY station_id ORDER BY forecast_time) AS i FROM {FLOWS}),
s AS (SELECT station_id AS station, arrivals, departures, row_number() OVER (PARTITION BY station_id ORDER BY forecast_time) AS i FROM {FLOWS} WHERE forecast_time < TIMESTAMP '2024-01-20')
SELECT d.station, forecast_time, demand, coalesce(arrivals, 0) AS arrivals, coalesce(departures, 0) AS departures FROM d LEFT JOIN s ON s.station = d.station AND s.i = d.i""")
def chart_merge(spark, sf_dir):
    rows = B.hourly_flows(spark, sf_dir).withColumnRenamed("station_id", "station")
    supply = rows.filter(F.col("forecast_time") < F.lit("2024-01-20").cast("timestamp_ntz")).select("station", "forecast_time", "arrivals", "departures")
    return forecast.chart(rows.select("station", "forecast_time", "demand"), supply)


# ---- tracking ----
@query(f"SELECT uld_id, station, ts, id, value FROM {POSITIONS} QUALIFY row_number() OVER (PARTITION BY uld_id ORDER BY ts DESC, id DESC) = 1")
def latest_position(spark, sf_dir):
    return tracking.latest_position(B.positions(spark, sf_dir)).select("uld_id", "station", "ts", "id", "value")


@query(f"SELECT uld_id, ts FROM (SELECT * FROM {POSITIONS} WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' QUALIFY row_number() OVER (PARTITION BY uld_id ORDER BY ts DESC, id DESC) = 1) WHERE station = 'click'")
def station_units_asof(spark, sf_dir):
    return tracking.at_station(B.positions(spark, sf_dir), "click", F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).select("uld_id", "ts")


@query(f"SELECT id, station, ts FROM {POSITIONS} WHERE uld_id = 7 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def position_history(spark, sf_dir):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return tracking.history(B.positions(spark, sf_dir), 7, at("2024-01-05 00:00:00"), at("2024-01-20 00:00:00")).select("id", "station", "ts")


DWELL = f"""(WITH c AS (SELECT *, CASE WHEN station IS NOT DISTINCT FROM lag(station) OVER (PARTITION BY uld_id ORDER BY ts, id) THEN 0 ELSE 1 END AS moved FROM {POSITIONS} WHERE ts >= {AS_OF} - INTERVAL 30 DAY AND ts <= {AS_OF}),
i AS (SELECT *, sum(moved) OVER (PARTITION BY uld_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS island FROM c), g AS (SELECT uld_id, island, max(station) AS station, min(ts) AS since FROM i GROUP BY ALL)
SELECT uld_id, station, since, round((epoch_us({AS_OF}) - epoch_us(since)) / 3.6e9, 6) AS dwell_hours FROM g QUALIFY row_number() OVER (PARTITION BY uld_id ORDER BY island DESC) = 1)"""


@query(f"SELECT * FROM {DWELL}")
def dwell_islands(spark, sf_dir):
    return rounded(tracking.dwell(B.positions(spark, sf_dir), B.as_of()))


@query(f"SELECT * FROM {DWELL} WHERE dwell_hours > 24")
def stuck_units(spark, sf_dir):
    return rounded(tracking.stuck(B.positions(spark, sf_dir), B.as_of(), 24.0))


INVENTORY = f"(SELECT station, uld_type, count(*) AS total, count(*) FILTER (status IN ('serviceable', 'empty')) AS available, count(*) FILTER (status = 'in_use') AS in_use, count(*) FILTER (status = 'damaged') AS damaged FROM {ASSETS} GROUP BY ALL)"


@query(f"SELECT * FROM {INVENTORY}")
def inventory_pivot(spark, sf_dir):
    return tracking.inventory(B.assets(spark, sf_dir))


@query(f"SELECT station, sum(total)::BIGINT AS total_count, sum(available)::BIGINT AS total_available, round(sum(available) / sum(total), 6) AS availability_ratio, coalesce(max(total) FILTER (uld_type = 'AKE'), 0) AS ake FROM {INVENTORY} GROUP BY station")
def inventory_maps(spark, sf_dir):
    out = tracking.inventory_maps(tracking.inventory(B.assets(spark, sf_dir)))
    return out.select("station", "total_count", "total_available", r("availability_ratio").alias("availability_ratio"), F.coalesce(F.try_element_at("total", F.lit("AKE")), F.lit(0)).alias("ake"))


@query(f"SELECT n_name AS station, coalesce(total, 0)::BIGINT AS total, coalesce(available, 0)::BIGINT AS available, round(CASE WHEN total > 0 THEN available / total ELSE 0 END, 6) AS ratio FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*) AS total, count(*) FILTER (c_acctbal > 5000) AS available FROM customer GROUP BY 1) ON k = n_nationkey")
def network_summary(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer").join(B.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = c.groupBy(F.col("n_name").alias("station")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("c_acctbal") > 5000).alias("available"))
    return rounded(tracking.network_summary(counts, B.table(spark, sf_dir, "nation").select(F.col("n_name").alias("station"))))


@query("SELECT l_returnflag AS station, l_linestatus AS kind, l_shipdate AS generated_at, l_orderkey, l_quantity FROM lineitem QUALIFY rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_shipdate DESC) = 1")
def latest_generation(spark, sf_dir):
    rows = B.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("station"), F.col("l_linestatus").alias("kind"), F.col("l_shipdate").alias("generated_at"), "l_orderkey", "l_quantity")
    return tracking.latest_generation(rows, ["station", "kind"])


@query(f"""SELECT uld_id, round(max(greatest(0, CASE station WHEN 'view' THEN 100 - 4 * h WHEN 'click' THEN 95 - 8 * h WHEN 'purchase' THEN 100 - 10 * h ELSE 0 END)), 6) AS confidence
FROM (SELECT uld_id, station, (epoch_us({AS_OF}) - epoch_us(max(ts))) / 3.6e9 AS h FROM {POSITIONS} GROUP BY ALL) GROUP BY uld_id""")
def confidence_decay(spark, sf_dir):
    hours = (F.unix_micros(B.as_of().cast("timestamp")) - F.unix_micros(F.max("ts").cast("timestamp"))) / 3.6e9
    last = B.positions(spark, sf_dir).groupBy("uld_id", "station").agg(hours.alias("h"))
    source = F.when(F.col("station") == "view", "geolocation").when(F.col("station") == "click", "flight_event").when(F.col("station") == "purchase", "scan")
    return last.groupBy("uld_id").agg(F.round(F.max(tracking.decayed_confidence(source, F.col("h"))), 6).alias("confidence"))


@query(f"SELECT flight_number, l_linenumber, l_suppkey, units, CASE WHEN l_linenumber % 2 = 1 THEN origin ELSE destination END AS station, CASE WHEN l_linenumber % 2 = 1 THEN departure ELSE arrival END AS at FROM {FLIGHTS}")
def flight_event_positions(spark, sf_dir):
    station, at = tracking.event_position(F.col("l_linenumber") % 2 == 1, F.col("origin"), F.col("destination"), F.col("departure"), F.col("arrival"))
    return B.flights(spark, sf_dir).select("flight_number", "l_linenumber", "l_suppkey", "units", station.alias("station"), at.alias("at"))


@query("SELECT o_orderkey AS flight_number, l_partkey AS uld_id, o_custkey % 25 AS station, o_orderdate AS ts, 0.85::DOUBLE AS confidence FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def inferred_positions(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("flight_number"), (F.col("o_custkey") % 25).alias("destination"), F.col("o_orderdate").alias("scheduled_arrival"), F.lit(None).cast("timestamp_ntz").alias("actual_arrival"), F.when(F.col("o_orderstatus") == "F", "landed").otherwise("scheduled").alias("status"))
    units = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("flight_number")).agg(F.collect_list("l_partkey").alias("uld_ids"))
    return tracking.inferred_positions(o, units)


# ---- flights ----
AIRCRAFT = sql_values([(a[0], a[3]) for a in dims.AIRCRAFT])


@query(f"""WITH a AS (SELECT * FROM (VALUES {AIRCRAFT}) t(icao, wide)), f AS (SELECT *, (['B738', 'A321', 'B763', 'A333', 'A359', 'B77W', 'XXXX'])[(l_suppkey % 7 + 1)::INT] AS icao, (epoch_us(arrival) - epoch_us(departure)) / 3.6e9 / 24 AS hours, units::INT * 8 AS pax FROM {FLIGHTS}),
w AS (SELECT f.*, coalesce(a.wide, hours > 3.0) AS widebody FROM f LEFT JOIN a ON a.icao = f.icao)
SELECT icao, widebody, count(*) AS flights, sum(CASE WHEN NOT widebody THEN 0 WHEN pax > 0 THEN greatest(1, pax // 40) ELSE 2 END)::BIGINT AS demand FROM w GROUP BY ALL""")
def widebody_demand(spark, sf_dir):
    icao = F.element_at(F.array(*[F.lit(a[0]) for a in dims.AIRCRAFT], F.lit("XXXX")), (F.col("l_suppkey") % 7 + 1).cast("int"))
    hours = flights.duration_hours(F.col("departure"), F.col("arrival")) / 24
    rows = B.flights(spark, sf_dir).select(icao.alias("icao"), hours.alias("hours"), (F.col("units").cast("int") * 8).alias("pax"))
    rows = rows.join(F.broadcast(dims.aircraft(spark).select("icao", "is_widebody")), "icao", "left").withColumn("widebody", flights.is_widebody(F.col("is_widebody"), F.col("hours")))
    return rows.groupBy("icao", "widebody").agg(F.count(F.lit(1)).alias("flights"), F.sum(flights.unit_demand(F.col("widebody"), F.col("pax"))).alias("demand"))


@query(f"SELECT origin::VARCHAR || '-' || destination::VARCHAR AS route_key, count(*) AS flights, round(sum(units), 4) AS demand, min(departure) AS first_departure, max(departure) AS last_departure FROM {FLIGHTS} GROUP BY 1")
def route_groups(spark, sf_dir):
    return rounded(flights.by_route(B.flights(spark, sf_dir).withColumn("demand", F.col("units"))), 4)


@query("""WITH h AS (SELECT DISTINCT event_type AS station, date_trunc('hour', ts) AS hour FROM events)
SELECT h.station, h.hour, count(e.ts) FILTER (abs(epoch(e.ts)::BIGINT - epoch(h.hour)::BIGINT) < 3600) AS flights FROM h LEFT JOIN (SELECT event_type AS station, date_trunc('second', ts) AS ts FROM events) e ON e.station = h.station AND e.ts > h.hour - INTERVAL 2 HOUR AND e.ts < h.hour + INTERVAL 2 HOUR GROUP BY ALL""")
def range_join_hourly(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").select(F.col("event_type").alias("station"), "ts")
    hours = e.select("station", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).distinct()
    return flights.movements_near(hours, e, "ts")


@query(f"""SELECT airport, sum(o)::BIGINT AS flights_out, round(sum(CASE WHEN o = 1 THEN units ELSE 0 END), 2) AS units_out, round(sum(CASE WHEN o = 1 THEN freight ELSE 0 END), 2) AS freight_out, sum(1 - o)::BIGINT AS flights_in, round(sum(CASE WHEN o = 0 THEN units ELSE 0 END), 2) AS units_in,
round(sum(CASE WHEN o = 0 THEN freight ELSE 0 END), 2) AS freight_in FROM (SELECT origin AS airport, 1 AS o, units, freight FROM {FLIGHTS} UNION ALL SELECT destination, 0, units, freight FROM {FLIGHTS}) GROUP BY airport""")
def airport_traffic(spark, sf_dir):
    return rounded(flights.airport_traffic(B.flights(spark, sf_dir), ["units", "freight"]), 2)


@query(f"WITH s AS (SELECT * FROM (VALUES {STATIONS}) t(code, tier, lat, lon)) SELECT a.code, b.code AS other FROM s a JOIN s b ON a.code <> b.code AND (a.tier = 'hub' OR b.tier = 'hub')")
def connections(spark, sf_dir):
    return flights.connections(dims.stations(spark))


@query(f"SELECT flight_number, departure, destination, units FROM {FLIGHTS} QUALIFY row_number() OVER (PARTITION BY flight_number, departure::DATE ORDER BY l_linenumber, l_suppkey, units, destination) = 1")
def dedupe_first(spark, sf_dir):
    rows = flights.first_of(B.flights(spark, sf_dir), ["flight_number", F.to_date("departure")], ["l_linenumber", "l_suppkey", "units", "destination"])
    return rows.select("flight_number", "departure", "destination", "units")


@query(f"""SELECT flight_number, direction, departure FROM (SELECT *, 'departure' AS direction FROM {FLIGHTS} WHERE origin = 3 UNION ALL SELECT *, 'arrival' FROM {FLIGHTS} WHERE destination = 3)
QUALIFY row_number() OVER (PARTITION BY flight_number, departure::DATE ORDER BY departure, direction DESC, destination) = 1""")
def union_departures_arrivals(spark, sf_dir):
    return flights.at_airport(B.flights(spark, sf_dir), 3).select("flight_number", "direction", "departure")


@query("""WITH RECURSIVE u AS (SELECT l_orderkey AS flight, l_quantity AS kg, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS seq FROM lineitem),
f AS (SELECT flight, seq, CASE WHEN kg <= 90 THEN 1 ELSE 0 END AS used, CASE WHEN kg <= 90 THEN kg ELSE 0 END AS kg, CASE WHEN kg <= 90 THEN 0 ELSE 1 END AS refused FROM u WHERE seq = 1
  UNION ALL SELECT f.flight, u.seq, f.used + CASE WHEN f.used < 3 AND f.kg + u.kg <= 90 THEN 1 ELSE 0 END, f.kg + CASE WHEN f.used < 3 AND f.kg + u.kg <= 90 THEN u.kg ELSE 0 END, f.refused + CASE WHEN f.used < 3 AND f.kg + u.kg <= 90 THEN 0 ELSE 1 END FROM f JOIN u ON u.flight = f.flight AND u.seq = f.seq + 1)
SELECT flight, used, kg, refused, round(used / 3, 6) AS utilization, round(kg / 90, 6) AS weight_utilization FROM f QUALIFY row_number() OVER (PARTITION BY flight ORDER BY seq DESC) = 1""")
def load_plan_fold(spark, sf_dir):
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity"))
    units = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("flight"), seq.alias("seq"), F.col("l_partkey").alias("uld_id"), F.col("l_quantity").alias("kg"))
    return rounded(flights.load_plan(units, 3, 90.0))


# ---- recommendations ----
def recs(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders")
    rows = o.select(
        F.col("o_orderkey").alias("rec_id"), (F.col("o_custkey") % 10).cast("string").alias("origin"), (F.col("o_custkey") % 7).cast("string").alias("destination"), (F.col("o_orderkey") % 12 + 1).cast("int").alias("quantity"),
        ((F.col("o_custkey") % 101) / 100.0).alias("shortage_probability"), F.when(F.col("o_orderkey") % 2 == 0, "ground").otherwise("flight").alias("method"), "o_orderdate",
    )
    rows = rows.withColumns(recommend.cost_benefit(F.col("quantity"), F.col("shortage_probability"), F.col("method")))
    return rows.withColumn("priority", X.priority(F.col("shortage_probability")))


@query(f"SELECT rec_id, priority, round(total_cost, 4) AS total_cost, round(total_benefit, 4) AS total_benefit, round(net_benefit, 4) AS net_benefit, round(roi, 6) AS roi FROM {COSTS}")
def cost_benefit(spark, sf_dir):
    return recs(spark, sf_dir).select("rec_id", "priority", *[r(c, 4).alias(c) for c in ("total_cost", "total_benefit", "net_benefit")], r("roi").alias("roi"))


@query(f"SELECT rec_id, priority, quantity FROM {COSTS} WHERE roi IS NULL OR roi >= 0.5 ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, p DESC, net_benefit DESC, rec_id LIMIT 25")
def prioritise_topk(spark, sf_dir):
    return recommend.prioritize(recs(spark, sf_dir), 25, 0.5).select("rec_id", "priority", "quantity")


@query(f"""WITH b AS (SELECT station AS origin, q50 AS surplus FROM {STATION_IMB} WHERE p <= 0.5 AND q50 > 10 ORDER BY surplus DESC, origin LIMIT 1)
SELECT origin, station AS destination, least(abs(trunc(q50)), trunc(surplus))::INT AS quantity, p AS shortage_probability, CASE WHEN p >= 0.8 THEN 'critical' WHEN p >= 0.5 THEN 'high' WHEN p >= 0.3 THEN 'medium' ELSE 'low' END AS priority
FROM {STATION_IMB} s JOIN b ON b.origin <> s.station WHERE p > 0.5 AND least(abs(trunc(q50)), trunc(surplus)) > 0""")
def repositioning_recs(spark, sf_dir):
    return recommend.repositioning(B.station_imbalances(spark, sf_dir))


@query("SELECT o_orderkey AS flight, (8 - o_orderkey % 11)::BIGINT AS quantity, CASE WHEN 8 - o_orderkey % 11 > 4 THEN 'high' ELSE 'medium' END AS priority FROM orders WHERE o_orderkey % 11 < 8")
def allocation_recs(spark, sf_dir):
    rows = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("flight"), (F.col("o_orderkey") % 11).alias("allocated"))
    return recommend.allocation(rows).select("flight", "quantity", "priority")


@query(f"""SELECT coalesce(a.s, b.s) AS station, coalesce(units_out, 0)::BIGINT AS units_out, round(coalesce(cost_out, 0), 4) AS cost_out, coalesce(moves_out, 0) AS moves_out, coalesce(units_in, 0)::BIGINT AS units_in, round(coalesce(benefit_in, 0), 4) AS benefit_in, coalesce(moves_in, 0) AS moves_in
FROM (SELECT origin AS s, sum(quantity) AS units_out, sum(total_cost) AS cost_out, count(*) AS moves_out FROM {COSTS} GROUP BY 1) a FULL JOIN (SELECT destination AS s, sum(quantity) AS units_in, sum(total_benefit) AS benefit_in, count(*) AS moves_in FROM {COSTS} GROUP BY 1) b ON a.s = b.s""")
def station_plan(spark, sf_dir):
    return rounded(recommend.station_plan(recs(spark, sf_dir).withColumnsRenamed({"total_cost": "cost", "total_benefit": "benefit"})), 4)


@query(f"SELECT count(*) AS recommendations, count(*) FILTER (priority = 'critical') AS critical, count(*) FILTER (priority = 'high') AS high, count(*) FILTER (priority = 'medium') AS medium, count(*) FILTER (priority = 'low') AS low, sum(quantity)::BIGINT AS quantity, round(sum(total_cost), 2) AS cost, round(sum(total_benefit), 2) AS benefit, round(sum(net_benefit), 2) AS net FROM {COSTS}")
def rec_summary(spark, sf_dir):
    return rounded(recommend.summary(recs(spark, sf_dir)), 2)


@query(f"SELECT rec_id, origin, destination, uld_type FROM (SELECT *, {TYPES.replace('o_custkey', 'rec_id')} AS uld_type FROM {RECS}) QUALIFY row_number() OVER (PARTITION BY origin, destination, uld_type ORDER BY rec_id) = 1")
def dedupe_recs(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(t) for t, _ in dims.TYPE_MIX]), (F.col("rec_id") % 5 + 1).cast("int"))
    return recommend.deduplicate(recs(spark, sf_dir).withColumn("uld_type", kind)).select("rec_id", "origin", "destination", "uld_type")


@query(f"""WITH c AS (SELECT DISTINCT origin, destination, 8 AS capacity FROM {RECS} WHERE origin < destination)
SELECT rec_id, CASE WHEN quantity < 2 THEN 'below minimum' WHEN quantity > 10 THEN 'above maximum' WHEN quantity > capacity THEN 'route capacity' END AS reason, NOT coalesce(quantity < 2 OR quantity > 10 OR quantity > capacity, false) AS ok FROM {RECS} r LEFT JOIN c ON c.origin = r.origin AND c.destination = r.destination""")
def validate_moves(spark, sf_dir):
    rows = recs(spark, sf_dir)
    capacity = rows.filter("origin < destination").select("origin", "destination").distinct().withColumn("capacity", F.lit(8))
    return recommend.validate_moves(rows, capacity, 2, 10).select("rec_id", "reason", "ok")


@query(f"""WITH d AS (SELECT a.n_nationkey::VARCHAR AS origin, b.n_nationkey::VARCHAR AS destination, 100.0::DOUBLE * abs(a.n_nationkey - b.n_nationkey) AS km FROM nation a, nation b WHERE (a.n_nationkey + b.n_nationkey) % 3 <> 0)
SELECT s.station AS destination, abs(trunc(s.q50))::INT AS shortage, o.station AS origin, trunc(o.q50)::INT AS surplus, coalesce(km, 1500.0::DOUBLE) AS km FROM {STATION_IMB} s JOIN {STATION_IMB} o ON s.q50 < 0 AND o.q50 > 5 AND s.station <> o.station LEFT JOIN d ON d.origin = o.station AND d.destination = s.station
QUALIFY row_number() OVER (PARTITION BY s.station ORDER BY coalesce(km, 1500), o.station) = 1""")
def nearest_surplus(spark, sf_dir):
    return recommend.nearest_surplus(B.station_imbalances(spark, sf_dir), nation_distances(spark, sf_dir)).select("destination", "shortage", "origin", "surplus", "km")


def nation_distances(spark, sf_dir):
    n = B.table(spark, sf_dir, "nation").select("n_nationkey")
    a, b = n.withColumnRenamed("n_nationkey", "a"), n.withColumnRenamed("n_nationkey", "b")
    pairs = a.join(F.broadcast(b), (F.col("a") + F.col("b")) % 3 != 0)  # 25 nations
    return pairs.select(F.col("a").cast("string").alias("origin"), F.col("b").cast("string").alias("destination"), (100.0 * F.abs(F.col("a") - F.col("b"))).alias("km"))


@query(f"""WITH RECURSIVE d AS (SELECT a.n_nationkey::VARCHAR AS origin, b.n_nationkey::VARCHAR AS destination, 100.0::DOUBLE * abs(a.n_nationkey - b.n_nationkey) AS km FROM nation a, nation b WHERE (a.n_nationkey + b.n_nationkey) % 3 <> 0),
k AS (SELECT map_from_entries(list(({{'k': origin || '>' || destination, 'v': km}}))) AS km FROM d),
i AS (SELECT s.station, s.q50, s.p, n_regionkey::VARCHAR AS network FROM {STATION_IMB} s JOIN nation ON n_nationkey::VARCHAR = s.station),
t AS (SELECT network, list({{'s': station, 'short': (CASE WHEN q50 < 0 THEN abs(trunc(q50)) ELSE 0 END)::INT, 'extra': (CASE WHEN q50 > 5 THEN trunc(q50) ELSE 0 END)::INT}}) AS st, 3 * count(*) FILTER (q50 < 0) AS most FROM i GROUP BY network),
r AS (SELECT network, 0 AS step, st, most, NULL::VARCHAR AS origin, NULL::VARCHAR AS destination, 0 AS quantity, 0.0::DOUBLE AS km FROM t
  UNION ALL SELECT network, step + 1, list_transform(st, lambda x: {{'s': x.s, 'short': x.short - CASE WHEN x.s = dst THEN n ELSE 0 END, 'extra': x.extra - CASE WHEN x.s = near.s THEN n ELSE 0 END}}), most, near.s, dst, n, near.d
  FROM (SELECT *, least(list_filter(st, lambda x: x.s = dst)[1].short, list_filter(st, lambda x: x.s = near.s)[1].extra, 20)::INT AS n
    FROM (SELECT q.*, list_min(list_transform(list_filter(st, lambda x: x.extra > 0 AND x.s <> dst), lambda x: {{'d': coalesce(k.km[x.s || '>' || dst], 1500.0::DOUBLE), 's': x.s}})) AS near
      FROM (SELECT network, step, st, most, list_min(list_transform(list_filter(st, lambda x: x.short > 0), lambda x: {{'n': -x.short, 's': x.s}})).s AS dst FROM r WHERE step < most AND step < 100) q, k WHERE dst IS NOT NULL) WHERE near IS NOT NULL))
SELECT r.network, step, origin, destination, quantity, r.km, round(0.05::DOUBLE * quantity * r.km, 4) AS transport, CASE WHEN p > 0.8 THEN 'critical' WHEN p > 0.5 THEN 'high' ELSE 'medium' END AS priority FROM r JOIN i ON i.network = r.network AND i.station = r.destination WHERE step > 0""")
def greedy_flow(spark, sf_dir):
    """The nations of each region as a network of its own."""
    regions = B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("station"), F.col("n_regionkey").cast("string").alias("network"))
    networks = B.station_imbalances(spark, sf_dir).join(regions, "station")
    moves = recommend.greedy_moves(networks.select("network", "station", "q50"), nation_distances(spark, sf_dir))
    return recommend.move_economics(moves, networks).select("network", "step", "origin", "destination", "quantity", "km", r("transport", 4).alias("transport"), "priority")


@query(f"""WITH c AS (SELECT coalesce(sum(CASE WHEN shortage_probability > 0.3 THEN abs(imbalance_q05) * 500 * shortage_probability ELSE 0 END), 0) AS shortage FROM {FIRST}),
m AS (SELECT sum(CASE WHEN method = 'ground' THEN 150 ELSE 50 END * quantity)::DOUBLE AS transport, sum(50.0::DOUBLE * quantity) AS handling, sum(quantity)::BIGINT AS units FROM {RECS})
SELECT round(shortage, 2) AS shortage_cost, transport AS transport_cost, handling AS handling_cost, units AS units_moved, round(shortage + transport + handling, 2) AS total_system_cost, 'feasible' AS solver_status, false AS is_optimal FROM c, m""")
def optimizer_totals(spark, sf_dir):
    return rounded(recommend.optimizer_totals(first_imbalance(spark, sf_dir), recs(spark, sf_dir)), 2)


@query(f"""WITH t AS (SELECT (o_custkey % 10)::VARCHAR AS station, {TYPES} AS uld_type, count(*)::INT AS supply, (sum(o_orderkey % 4) // 2)::INT AS demand FROM orders GROUP BY ALL),
p AS (SELECT station, count(*) AS action_count, coalesce(bool_or(critical), false) AS has_critical FROM (SELECT origin AS station, priority = 'critical' AS critical FROM {COSTS} UNION ALL SELECT destination, priority = 'critical' FROM {COSTS}
UNION ALL SELECT (o_custkey % 10)::VARCHAR, false FROM orders WHERE o_orderkey % 11 < 8) GROUP BY station),
o AS (SELECT origin AS station, sum(quantity)::BIGINT AS units_out FROM {RECS} GROUP BY 1), i AS (SELECT destination AS station, sum(quantity)::BIGINT AS units_in FROM {RECS} GROUP BY 1)
SELECT t.station, uld_type, demand, supply, greatest(0, supply - demand) AS end_inventory, coalesce(units_out, 0) AS units_out, coalesce(units_in, 0) AS units_in, coalesce(action_count, 0) AS action_count, coalesce(has_critical, false) AS has_critical, {AS_OF} + INTERVAL 4 HOUR AS valid_until
FROM t LEFT JOIN p ON p.station = t.station LEFT JOIN o ON o.station = t.station LEFT JOIN i ON i.station = t.station""")
def action_plan(spark, sf_dir):
    station = (F.col("o_custkey") % 10).cast("string").alias("station")
    kind = F.element_at(F.array(*[F.lit(t) for t, _ in dims.TYPE_MIX]), (F.col("o_custkey") % 5 + 1).cast("int")).alias("uld_type")
    orders = B.table(spark, sf_dir, "orders")
    stocks = orders.groupBy(station, kind).agg(F.count(F.lit(1)).alias("supply"), F.floor(F.sum(F.col("o_orderkey") % 4) / 2).alias("demand"))
    moves = recs(spark, sf_dir).withColumnsRenamed({"total_cost": "cost", "total_benefit": "benefit"})
    plan = recommend.action_plan(stocks, moves, B.as_of(), orders.filter(F.col("o_orderkey") % 11 < 8).select(station))
    return plan.withColumn("t", F.explode("types")).select("station", "t.uld_type", "t.demand", "t.supply", "t.end_inventory", "units_out", "units_in", "action_count", "has_critical", "valid_until")


@query(f"SELECT rec_id, round((epoch_us(o_orderdate::TIMESTAMP) - epoch_us({AS_OF})) / 3.6e9, 6) AS urgency_hours FROM {RECS}")
def urgency(spark, sf_dir):
    return recs(spark, sf_dir).select("rec_id", r(X.urgency_hours(F.col("o_orderdate"), B.as_of())).alias("urgency_hours"))


# ---- features ----
@query(f"""SELECT k, d, isodow(d) - 1 AS day_of_week, day(d) AS day_of_month, week(d) AS week_of_year, month(d) AS month, quarter(d) AS quarter, year(d) AS year, (isodow(d) >= 6)::INT AS is_weekend, (day(d) = 1)::INT AS is_month_start, (d = last_day(d))::INT AS is_month_end,
round(sin(2 * pi() * (isodow(d) - 1) / 7), 6) AS dow_sin, round(cos(2 * pi() * month(d) / 12), 6) + 0.0::DOUBLE AS month_cos, round(sin(2 * pi() * dayofyear(d) / 365.25), 6) AS doy_sin FROM {DEMAND}""")
def calendar_features(spark, sf_dir):
    keep = ["k", "d", *X.calendar(F.col("d")), "dow_sin", "month_cos", "doy_sin"]
    return rounded(features.calendar(B.demand(spark, sf_dir), "d").select(*keep))


@query(f"SELECT k, d, round(sin(2 * pi() * 2 * (isodow(d) - 1) / 7), 6) AS weekly_sin_2, round(cos(2 * pi() * (isodow(d) - 1) / 7), 6) AS weekly_cos_1, round(sin(2 * pi() * 3 * dayofyear(d) / 365.25), 6) AS annual_sin_3, round(cos(2 * pi() * 2 * dayofyear(d) / 365.25), 6) AS annual_cos_2 FROM {DEMAND}")
def fourier_features(spark, sf_dir):
    return rounded(features.calendar(B.demand(spark, sf_dir), "d").select("k", "d", "weekly_sin_2", "weekly_cos_1", "annual_sin_3", "annual_cos_2"))


@query("SELECT k, d, " + ", ".join(f"lag(y, {n}) OVER (PARTITION BY k ORDER BY d) AS lag_{n}" for n in features.LAGS) + f" FROM {DEMAND}")
def lag_features(spark, sf_dir):
    return features.lags(B.demand(spark, sf_dir), "k", "d", "y").drop("y")


@query("SELECT k, d, " + ", ".join(
    f"round(avg(y) OVER w{n}, 6) AS mean_{n}, round(stddev_samp(y) OVER w{n}, 6) AS std_{n}, min(y) OVER w{n} AS min_{n}, max(y) OVER w{n} AS max_{n}, round(coalesce(stddev_samp(y) OVER w{n} / nullif(avg(y) OVER w{n}, 0), 0), 6) AS cv_{n}" for n in features.WINDOWS
) + f" FROM {DEMAND} WINDOW " + ", ".join(f"w{n} AS (PARTITION BY k ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in features.WINDOWS))
def rolling_features(spark, sf_dir):
    return rounded(features.rolling(B.demand(spark, sf_dir), "k", "d", "y").drop("y"))


@query(f"""WITH o AS (SELECT k, d, list(y) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a FROM {DEMAND})
SELECT k, d, round(list_sum(list_transform(a, lambda x, i: x * power(0.75::DOUBLE, len(a) - i))) / list_sum(list_transform(a, lambda x, i: power(0.75::DOUBLE, len(a) - i))), 4) AS ewm_7 FROM o""")
def ewma(spark, sf_dir):
    return rounded(features.ewma(B.demand(spark, sf_dir), "k", "d", "y", spans=(7,)).select("k", "d", "ewm_7"), 4)


HOLIDAYS = dims.federal_holidays(date(1994, 12, 1), date(2002, 12, 31))


@query(f"""WITH h AS (SELECT unnest([{', '.join(f"DATE '{h}'" for h in HOLIDAYS)}]) AS h), days AS (SELECT DISTINCT l_shipdate::DATE AS d FROM lineitem)
SELECT d, (count(*) FILTER (h = d) > 0)::INT AS is_holiday, (count(*) FILTER (h = d + 1) > 0)::INT AS is_holiday_eve, coalesce(min(h - d) FILTER (h >= d), 365)::INT AS days_to_holiday, coalesce(min(d - h) FILTER (h <= d), 365)::INT AS days_from_holiday FROM days, h GROUP BY d""")
def holiday_distance(spark, sf_dir):
    days = B.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
    return features.holiday_distance(days, "d", HOLIDAYS)


@query(f"""WITH s AS (SELECT * FROM (VALUES {STATIONS}) t(station, tier, lat, lon)),
e AS (SELECT value * 1000 AS attendance, 30 + user_id % 20 AS e_lat, -(70 + event_id % 50) AS e_lon, CASE event_type WHEN 'click' THEN 1.0::DOUBLE WHEN 'view' THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS w FROM events)
SELECT station, round(ln(1 + sum(attendance * w * exp(-sqrt(power(e_lat - lat, 2) + power(e_lon - lon, 2)) * 111 / 50)) / 1000), 6) AS impact, count(*) AS events FROM e, s GROUP BY station""")
def event_impact(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    category = F.when(F.col("event_type") == "click", "sports").when(F.col("event_type") == "view", "concerts").otherwise("other")
    rows = e.select((F.col("value") * 1000).alias("attendance"), (30 + F.col("user_id") % 20).cast("double").alias("e_lat"), (-(70 + F.col("event_id") % 50)).cast("double").alias("e_lon"), category.alias("category"))
    s = dims.stations(spark).select(F.col("code").alias("station"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return rounded(features.event_impact(rows, s))


@query("""WITH s AS (SELECT n_regionkey AS hub, sum(c_acctbal) AS demand FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
b AS (SELECT n_regionkey AS hub, avg(s_acctbal) AS baseline, stddev_samp(s_acctbal) AS std FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1), e AS (SELECT n_nationkey AS station, r_regionkey AS hub FROM nation, region WHERE n_regionkey <> r_regionkey)
SELECT station, round(avg((demand - baseline) / greatest(std, 1e-6)), 4) AS pressure, count(*) AS hubs FROM e JOIN s ON s.hub = e.hub JOIN b ON b.hub = e.hub GROUP BY station""")
def hub_pressure(spark, sf_dir):
    n, c, s = (B.table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    demand = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("hub")).agg(F.sum("c_acctbal").alias("demand"))
    base = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("hub")).agg(F.avg("s_acctbal").alias("baseline"), F.stddev_samp("s_acctbal").alias("std"))
    edges = n.join(F.broadcast(B.table(spark, sf_dir, "region")), F.col("n_regionkey") != F.col("r_regionkey")).select(F.col("n_nationkey").alias("station"), F.col("r_regionkey").alias("hub"))
    return rounded(features.hub_pressure(edges, demand.join(base, "hub")), 4)


@query(f"SELECT node, sum(i) AS inflow, sum(o) AS outflow, sum(i) - sum(o) AS net FROM (SELECT destination AS node, units AS i, 0 AS o FROM {FLIGHTS} UNION ALL SELECT origin, 0, units FROM {FLIGHTS}) GROUP BY node")
def flow_imbalance(spark, sf_dir):
    return features.flow_imbalance(B.flights(spark, sf_dir).select("origin", "destination", "units"))


@query("SELECT event_id, round(3.0 * (event_type = 'view')::INT + 2.0 * (user_id % 3 = 0)::INT + least(value / 25, 2), 6) AS weather, round(CASE WHEN user_id % 2 = 0 THEN 0.4 + 0.6 * (1 - s) ELSE 1 + 0.5 * s END, 6) AS impact FROM (SELECT *, (event_id % 11) / 10.0::DOUBLE AS s FROM events)")
def severity_scores(spark, sf_dir):
    s = (F.col("event_id") % 11) / 10.0
    base = F.when(F.col("user_id") % 2 == 0, 0.4).otherwise(1.5)
    weather = X.weather_severity(F.col("event_type") == "view", F.col("user_id") % 3 == 0, F.col("value"))
    return B.table(spark, sf_dir, "events").select("event_id", r(weather).alias("weather"), r(X.scenario_impact(base, s)).alias("impact"))


# ---- evaluation ----
@query(f"SELECT k, round(100 * avg(abs(yhat - y) / greatest(abs(y), 1e-8)), 4) AS mape, round(sqrt(avg(power(yhat - y, 2))), 4) AS rmse, round(avg(abs(yhat - y)), 4) AS mae, round(avg(yhat - y), 4) AS bias, round(avg((y BETWEEN lower AND upper)::INT), 6) AS coverage, round(avg(upper - lower), 4) AS width, round(avg(upper - lower + 20 * greatest(lower - y, 0) + 20 * greatest(y - upper, 0)), 4) AS interval_score FROM {PREDICTIONS} GROUP BY k")
def forecast_metrics(spark, sf_dir):
    out = evaluate.evaluate(B.predictions(spark, sf_dir), ["k"])
    return out.select("k", *[r(c, 6 if c == "coverage" else 4).alias(c) for c in ("mape", "rmse", "mae", "bias", "coverage", "width", "interval_score")])


SPLIT = "DATE '2000-01-01'"
TRAIN, TEST = f"(SELECT * FROM {DEMAND} WHERE d < {SPLIT})", f"(SELECT * FROM {PREDICTIONS} WHERE d >= {SPLIT})"


@query(f"""WITH n AS (SELECT k, 7 - row_number() OVER (PARTITION BY k ORDER BY d DESC) AS slot, y AS naive FROM {TRAIN} QUALIFY slot >= 0), t AS (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY d) - 1) % 7 AS slot FROM {TEST}),
a AS (SELECT t.k, avg(abs(y - yhat)) AS mae, avg(abs(y - naive)) AS nm FROM t LEFT JOIN n ON n.k = t.k AND n.slot = t.slot GROUP BY t.k), s AS (SELECT k, avg(abs(e)) AS scale FROM (SELECT k, y - lag(y, 7) OVER (PARTITION BY k ORDER BY d) AS e FROM {TRAIN}) GROUP BY k)
SELECT a.k, round(mae / scale, 6) AS mase, round(1 - mae / nullif(nm, 0), 6) AS skill FROM a LEFT JOIN s ON s.k = a.k""")
def mase_skill(spark, sf_dir):
    at = F.lit("2000-01-01").cast("date")
    return rounded(evaluate.scaled_errors(B.demand(spark, sf_dir).filter(F.col("d") < at), B.predictions(spark, sf_dir).filter(F.col("d") >= at), "k", "d"))


@query(f"SELECT k, round(avg(CASE WHEN y >= lower THEN 0.1 * (y - lower) ELSE -0.9 * (y - lower) END), 4) AS pinball_10, round(avg(CASE WHEN y >= upper THEN 0.9 * (y - upper) ELSE -0.1 * (y - upper) END), 4) AS pinball_90 FROM {PREDICTIONS} GROUP BY k")
def pinball_loss(spark, sf_dir):
    y = F.col("y")
    return B.predictions(spark, sf_dir).groupBy("k").agg(r(F.avg(X.pinball(y, F.col("lower"), 0.1)), 4).alias("pinball_10"), r(F.avg(X.pinball(y, F.col("upper"), 0.9)), 4).alias("pinball_90"))


@query(f"SELECT k, round(avg(s * (z * (2 * {sql_cdf('z')} - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))), 4) AS crps FROM (SELECT *, (y - yhat) / s AS z FROM (SELECT *, greatest(1.0::DOUBLE, 0.2::DOUBLE * yhat) AS s FROM {PREDICTIONS})) GROUP BY k")
def crps_normal(spark, sf_dir):
    rows = B.predictions(spark, sf_dir).withColumn("s", F.greatest(F.lit(1.0), 0.2 * F.col("yhat")))
    return rows.groupBy("k").agg(r(F.avg(X.crps_gaussian(F.col("y"), F.col("yhat"), F.col("s"))), 4).alias("crps"))


@query("""WITH s AS (SELECT user_id, list(value ORDER BY value) AS a, avg(value) AS y FROM events GROUP BY user_id)
SELECT user_id, round(CASE WHEN len(a) > 1 THEN list_sum(list_transform(a, lambda x: abs(x - y))) / len(a) - list_sum(list_transform(a, lambda x, i: (2 * i - len(a) - 1) * x)) / (len(a) * (len(a) - 1)) ELSE 0 END, 6) AS crps FROM s""")
def crps_empirical(spark, sf_dir):
    rows = B.table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("value").alias("a"), F.avg("value").alias("y"))
    return rows.select("user_id", r(X.crps_samples(F.col("y"), F.col("a"))).alias("crps"))


@query(f"""WITH l AS (SELECT k, d, power(y - lag(y, 7) OVER w, 2) - power(y - lag(y, 1) OVER w, 2) AS e FROM {DEMAND} WINDOW w AS (PARTITION BY k ORDER BY d)), m AS (SELECT *, lag(e) OVER (PARTITION BY k ORDER BY d) AS e1 FROM l WHERE e IS NOT NULL),
v AS (SELECT k, avg(e) AS m, var_pop(e) + 2 * 0.5 * covar_samp(e, e1) AS v, count(e) AS n FROM m GROUP BY k), s AS (SELECT k, CASE WHEN v > 0 THEN m / sqrt(v / n) END AS dm FROM v)
SELECT k, round(dm, 6) AS dm, round(2 * (1 - {sql_cdf('abs(dm)')}), 6) AS p FROM s""")
def dm_test(spark, sf_dir):
    w = Window.partitionBy("k").orderBy("d")
    rows = B.demand(spark, sf_dir).withColumns({"f1": F.lag("y", 7).over(w), "f2": F.lag("y", 1).over(w)}).filter("f1 IS NOT NULL")
    return rounded(evaluate.diebold_mariano(rows, "k", "d", 2))


@query("SELECT b::INT AS bin, round(count(event_id) / (SELECT count(*) FROM events), 6) AS share FROM (SELECT unnest(generate_series(0, 9)) AS b) LEFT JOIN (SELECT event_id, least(floor(value / 100 * 10), 9) AS f FROM events WHERE value BETWEEN 0 AND 100) ON f = b GROUP BY b")
def pit_histogram(spark, sf_dir):
    return rounded(evaluate.pit_histogram(B.table(spark, sf_dir, "events").withColumn("u", F.col("value") / 100), "u"))


@query(f"SELECT nominal, round(avg((y <= q)::INT), 6) AS empirical, round(abs(nominal - avg((y <= q)::INT)), 6) AS error FROM (SELECT 0.1::DOUBLE AS nominal, y, lower AS q FROM {PREDICTIONS} UNION ALL SELECT 0.5::DOUBLE, y, yhat FROM {PREDICTIONS} UNION ALL SELECT 0.9::DOUBLE, y, upper FROM {PREDICTIONS}) GROUP BY nominal")
def reliability(spark, sf_dir):
    return rounded(evaluate.reliability(B.predictions(spark, sf_dir), "y", {0.1: "lower", 0.5: "yhat", 0.9: "upper"}))


@query(f"""WITH n AS (SELECT k, d, row_number() OVER (PARTITION BY k ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM {DEMAND}), f AS (SELECT *, unnest(range(5)) AS fold FROM n WHERE n >= 373),
e AS (SELECT *, 373 + fold * ((n - 373) // 4) AS stop FROM f), p AS (SELECT k, fold::INT AS fold, CASE WHEN i < stop - 8 THEN 'train' WHEN i >= stop - 7 AND i < stop THEN 'test' END AS part, d FROM e WHERE stop <= n)
SELECT k, fold, part, count(*) AS n, min(d) AS lo, max(d) AS hi FROM p WHERE part IS NOT NULL GROUP BY ALL""")
def cv_folds(spark, sf_dir):
    rows = evaluate.fold_rows(B.demand(spark, sf_dir), "k", "d")
    return rows.groupBy("k", "fold", "part").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))


@query(f"""WITH n AS (SELECT k, d, y, row_number() OVER (PARTITION BY k ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM {DEMAND}), f AS (SELECT *, unnest(range(5)) AS fold FROM n WHERE n >= 373),
e AS (SELECT *, 373 + fold * ((n - 373) // 4) AS stop FROM f), p AS (SELECT *, avg(y) FILTER (i >= stop - 15 AND i < stop - 8) OVER (PARTITION BY k, fold) - y AS e FROM e WHERE stop <= n)
SELECT k, fold::INT AS fold, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias FROM p WHERE i >= stop - 7 AND i < stop GROUP BY k, fold""")
def cross_validation(spark, sf_dir):
    def mean_of_last_week(train, test):
        return test["y"] * 0 + train["y"].iloc[-7:].mean()

    return rounded(evaluate.cross_validate(evaluate.fold_rows(B.demand(spark, sf_dir), "k", "d"), "k", mean_of_last_week))


@query(f"""SELECT k, d, lag(y, 7) OVER w AS seasonal_naive, round(avg(y) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), 6) AS moving_average,
round(lag(y) OVER w + (lag(y) OVER w - first(y) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / nullif(row_number() OVER w - 2, 0), 6) AS drift FROM {DEMAND} WINDOW w AS (PARTITION BY k ORDER BY d)""")
def naive_baselines(spark, sf_dir):
    return rounded(evaluate.baselines(B.demand(spark, sf_dir), "k", "d", "y").drop("y"))


@query(f"""SELECT *, CASE WHEN coverage BETWEEN 0.75 AND 0.85 THEN 'green' WHEN coverage BETWEEN 0.70 AND 0.90 THEN 'amber' ELSE 'red' END AS light FROM (SELECT k, round(avg((y BETWEEN lower AND upper)::INT), 6) AS coverage, round(avg(upper - lower), 4) AS sharpness, round(avg(yhat - y), 4) AS bias FROM {PREDICTIONS} GROUP BY k)""")
def monitoring(spark, sf_dir):
    out = evaluate.monitor(B.predictions(spark, sf_dir), ["k"])
    return out.select("k", r("coverage").alias("coverage"), r("sharpness", 4).alias("sharpness"), r("bias", 4).alias("bias"), "light")


# ---- intervals and hierarchies ----
def sql_rank_quantile(score: str, source: str, key: str = "k") -> str:
    return f"""(SELECT {key}, a + t * (coalesce(b, a) - a) AS q FROM (SELECT {key}, max(s) FILTER (i = floor(p)) AS a, max(s) FILTER (i = floor(p) + 1) AS b, max(p - floor(p)) AS t FROM (
SELECT *, (n - 1) * least(ceil((n + 1) * (1 - 0.1::DOUBLE)) / n, 1) AS p FROM (SELECT {key}, {score} AS s, row_number() OVER (PARTITION BY {key} ORDER BY {score}) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS n FROM {source})) GROUP BY {key}))"""


@query(f"SELECT k, round(q, 6) AS q, round(2 * q, 6) AS width FROM {sql_rank_quantile('abs(y - yhat)', PREDICTIONS)}")
def split_conformal(spark, sf_dir):
    return rounded(uncertainty.split_conformal(B.predictions(spark, sf_dir), ["k"]))


CAL, NEW = f"(SELECT * FROM {PREDICTIONS} WHERE d < {SPLIT})", TEST


@query(f"SELECT p.k, d, round(lower - q, 4) AS lower, round(upper + q, 4) AS upper, round((lower + upper) / 2, 4) AS point FROM {NEW} p JOIN {sql_rank_quantile('greatest(lower - y, y - upper)', CAL)} c ON c.k = p.k")
def conformalized_quantiles(spark, sf_dir):
    at = F.lit("2000-01-01").cast("date")
    p = B.predictions(spark, sf_dir)
    return rounded(uncertainty.conformalized_quantiles(p.filter(F.col("d") < at), p.filter(F.col("d") >= at).drop("y", "yhat"), ["k"]).select("k", "d", "lower", "upper", "point"), 4)


@query(f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), c AS (SELECT vec_id, x, (label % 7)::DOUBLE AS score FROM e JOIN embeddings USING (vec_id)), q AS (SELECT * FROM e WHERE vec_id % 50 = 0),
n AS (SELECT q.vec_id AS query_id, c.score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.x, c.x), c.vec_id) AS r FROM q JOIN c ON c.vec_id <> q.vec_id QUALIFY r <= 100)
SELECT query_id, round(q, 6) AS q FROM {sql_rank_quantile('score', 'n', 'query_id')}""")
def local_conformal(spark, sf_dir):
    e = B.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") % 7).cast("double").alias("score"))
    cal = e.select(F.col("vec_id").alias("cal_id"), "x", "score")
    return rounded(uncertainty.local_conformal(cal, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "x")))


EDGES = "(SELECT 's' || s_suppkey AS child, 'n' || s_nationkey AS parent FROM supplier UNION ALL SELECT DISTINCT 'n' || n_nationkey, 'r' || n_regionkey FROM nation JOIN supplier ON s_nationkey = n_nationkey UNION ALL SELECT DISTINCT 'r' || n_regionkey, 'all' FROM nation JOIN supplier ON s_nationkey = n_nationkey)"


def edges(spark, sf_dir):
    s, n = B.table(spark, sf_dir, "supplier"), B.table(spark, sf_dir, "nation")
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    used = n.join(s.select("s_nationkey").distinct(), F.col("n_nationkey") == F.col("s_nationkey"))
    out = s.select(tag("s", "s_suppkey").alias("child"), tag("n", "s_nationkey").alias("parent"))
    out = out.unionByName(used.select(tag("n", "n_nationkey").alias("child"), tag("r", "n_regionkey").alias("parent")))
    return out.unionByName(used.select(tag("r", "n_regionkey").alias("child"), F.lit("all").alias("parent")).distinct())


LEAVES = "(SELECT 's' || l_suppkey AS node, sum(l_quantity) AS yhat FROM lineitem GROUP BY 1)"


def leaf_forecasts(spark, sf_dir):
    return B.table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("node")).agg(F.sum("l_quantity").alias("yhat"))


@query(f"""WITH RECURSIVE e AS {EDGES}, c AS (SELECT child AS node, child AS leaf FROM e WHERE child NOT IN (SELECT parent FROM e) UNION SELECT e.parent, c.leaf FROM c JOIN e ON e.child = c.node)
SELECT c.node, sum(yhat) AS yhat FROM c JOIN {LEAVES} l ON l.node = c.leaf GROUP BY c.node""")
def bottom_up(spark, sf_dir):
    return hierarchy.bottom_up(leaf_forecasts(spark, sf_dir), edges(spark, sf_dir))


@query(f"SELECT k, node AS leaf, round(t * yhat / sum(yhat) OVER (PARTITION BY k), 6) AS yhat FROM (SELECT l_returnflag AS k, sum(l_quantity) AS t FROM lineitem GROUP BY 1), {LEAVES}")
def top_down(spark, sf_dir):
    total = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.sum("l_quantity").alias("yhat"))
    past = leaf_forecasts(spark, sf_dir).select(F.col("node").alias("leaf"), F.col("yhat").alias("amount"))
    return rounded(hierarchy.top_down(total, past, keys=("k",)))


WLS = """(WITH li AS (SELECT 's' || s_suppkey AS s, 'n' || s_nationkey AS n, 'r' || n_regionkey AS r, l_quantity AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
tree AS (SELECT 's' || s_suppkey AS s, 'n' || s_nationkey AS n, 'r' || n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey),
y AS (SELECT s AS node, sum(q) / 7.0::DOUBLE AS y FROM li GROUP BY 1 UNION ALL SELECT n, sum(q) / 7.0::DOUBLE FROM li GROUP BY 1 UNION ALL SELECT r, 1.1::DOUBLE * sum(q) / 7.0::DOUBLE FROM li GROUP BY 1 UNION ALL SELECT 'all', sum(q) / 7.0::DOUBLE FROM li),
base AS (SELECT node, coalesce(y, 0) AS y FROM (SELECT DISTINCT unnest([s, n, r, 'all']) AS node FROM tree) LEFT JOIN y USING (node)),
s AS (SELECT DISTINCT t.s, t.n, y AS mean, 1.0::DOUBLE AS var, 1 AS leaves FROM tree t JOIN base ON node = t.s),
n0 AS (SELECT s.n, any_value(t.r) AS r, sum(mean) AS total, sum(var) AS spread, sum(leaves) AS leaves FROM s JOIN (SELECT DISTINCT n, r FROM tree) t ON t.n = s.n GROUP BY 1),
n AS (SELECT *, 1 / (1 / spread + 1 / leaves) AS var, (total / spread + y / leaves) / (1 / spread + 1 / leaves) AS mean FROM n0 JOIN base ON node = n),
r0 AS (SELECT r, sum(mean) AS total, sum(var) AS spread, sum(leaves) AS leaves FROM n GROUP BY 1),
r AS (SELECT *, 1 / (1 / spread + 1 / leaves) AS var, (total / spread + y / leaves) / (1 / spread + 1 / leaves) AS mean FROM r0 JOIN base ON node = r),
a0 AS (SELECT sum(mean) AS total, sum(var) AS spread, sum(leaves) AS leaves FROM r),
a AS (SELECT total, spread, (total / spread + y / leaves) / (1 / spread + 1 / leaves) AS v FROM a0 JOIN base ON node = 'all'),
rv AS (SELECT r, r.total, r.spread, mean + var * (a.v - a.total) / a.spread AS v FROM r, a),
nv AS (SELECT n, n.total, n.spread, mean + var * (rv.v - rv.total) / rv.spread AS v FROM n JOIN rv ON rv.r = n.r)
SELECT 'all' AS node, v FROM a UNION ALL SELECT r, v FROM rv UNION ALL SELECT n, v FROM nv UNION ALL SELECT s, mean + var * (nv.v - nv.total) / nv.spread FROM s JOIN nv ON nv.n = s.n)"""


@query(f"SELECT node, round(v, 6) AS yhat FROM {WLS}")
def reconcile_wls(spark, sf_dir):
    tree = edges(spark, sf_dir)
    s, n = B.table(spark, sf_dir, "supplier"), B.table(spark, sf_dir, "nation")
    li = B.table(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    levels = F.explode(F.array(tag("s", "s_suppkey"), tag("n", "n_nationkey"), tag("r", "n_regionkey"), F.lit("all")))
    base = li.select(levels.alias("node"), "l_quantity").groupBy("node").agg((F.sum("l_quantity") * F.when(F.col("node").startswith("r"), 1.1).otherwise(1.0) / 7.0).alias("yhat"))
    nodes = tree.select(F.col("child").alias("node")).unionByName(tree.select(F.col("parent").alias("node"))).distinct()
    base = nodes.join(base, "node", "left").na.fill(0.0, ["yhat"])
    return rounded(hierarchy.reconcile_tree(base, tree))


# ---- anomalies ----
CUSUM = "(SELECT *, u - least(0, min(u) OVER w) AS up, dn - least(0, min(dn) OVER w) AS down FROM (SELECT user_id, event_id, ts, sum(value - 50 - 5) OVER w AS u, sum(50 - 5 - value) OVER w AS dn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"


@query(f"SELECT user_id, event_id, round(up, 4) AS up, round(down, 4) AS down FROM {CUSUM}")
def cusum_noreset(spark, sf_dir):
    rows = anomaly.cusum(B.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 50.0, 5.0, 100.0)
    return rows.select("user_id", "event_id", r("up", 4).alias("up"), r("down", 4).alias("down"))


@query("""WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, i, greatest(0, value - 55) AS up, greatest(0, 45 - value) AS down FROM o WHERE i = 1
  UNION ALL SELECT f.user_id, o.i, greatest(0, CASE WHEN f.up > 100 THEN 0 ELSE f.up END + o.value - 50 - 5), greatest(0, CASE WHEN f.down > 100 THEN 0 ELSE f.down END - (o.value - 50 + 5)) FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT user_id, i AS position, round(up, 4) AS up, round(down, 4) AS down, CASE WHEN up > 100 THEN 'up' WHEN down > 100 THEN 'down' END AS side FROM f""")
def cusum_reset(spark, sf_dir):
    return rounded(anomaly.cusum_with_reset(B.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 50.0, 5.0, 100.0), 4)


@query("SELECT event_id, round(abs(value - avg(value) OVER w) / greatest(stddev_pop(value) OVER w, 1e-6), 6) AS z, abs(value - avg(value) OVER w) / greatest(stddev_pop(value) OVER w, 1e-6) > 2 AS outlier FROM events WINDOW w AS (PARTITION BY user_id)")
def zscore_outliers(spark, sf_dir):
    return anomaly.zscore(B.table(spark, sf_dir, "events"), "user_id", "value", 2.0).select("event_id", r("z").alias("z"), "outlier")


@query("""WITH RECURSIVE o AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, [{'p': 1.0::DOUBLE, 'n': 0.0::DOUBLE, 's': 0.0::DOUBLE, 'r': 0.0::DOUBLE}] AS runs FROM events
  UNION ALL SELECT user_id, i, list_transform(kept, lambda e: {'p': e.p / total, 'n': e.n, 's': e.s, 'r': e.r})
  FROM (SELECT user_id, i, kept, list_sum(list_transform(kept, lambda e: e.p)) AS total
    FROM (SELECT user_id, i, list_prepend({'p': CASE WHEN g > 0 THEN 0.01::DOUBLE * g / g ELSE 1.0::DOUBLE END, 'n': 1.0::DOUBLE, 's': x, 'r': 0.0::DOUBLE}, list_filter(list_transform(grown, lambda e: {'p': CASE WHEN g > 0 THEN 0.99::DOUBLE * e.p / g ELSE 0.0::DOUBLE END, 'n': e.n + 1, 's': e.s + x, 'r': e.r + 1}), lambda e: e.p > 1e-6)) AS kept
      FROM (SELECT *, list_sum(list_transform(grown, lambda e: e.p)) AS g
        FROM (SELECT f.user_id, o.i, o.x, list_transform(f.runs, lambda e: {'p': e.p * exp(-0.5::DOUBLE * power((o.x - (50.0::DOUBLE + e.s) / (1 + e.n)) / CASE WHEN e.n = 0 THEN 20.0::DOUBLE ELSE 30.0::DOUBLE END, 2)) / (CASE WHEN e.n = 0 THEN 20.0::DOUBLE ELSE 30.0::DOUBLE END * sqrt(2 * pi())), 'n': e.n, 's': e.s, 'r': e.r}) AS grown
          FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)))))
SELECT user_id, i AS position, round(runs[1].p, 6) AS p_change, round(list_sum(list_transform(runs, lambda e: e.p * e.r)), 6) AS run_length FROM f WHERE i > 0""")
def change_points(spark, sf_dir):
    return rounded(anomaly.change_points(B.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", mean=50.0, prior_var=400.0, var=900.0))


@query()
def isolation_forest(spark, sf_dir):
    rows = B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    return rounded(anomaly.isolation_scores(rows, ["l_quantity", "l_extendedprice", "l_discount"], keys=("l_orderkey", "l_linenumber"), trees=50))


# ---- cold start and models ----
COLD = "(SELECT n_regionkey AS tier, n_name AS station, s_acctbal AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
PRIORS = f"(SELECT CASE WHEN grouping(tier) = 1 AND grouping(station) = 1 THEN 'global' WHEN grouping(station) = 1 THEN 'tier' ELSE 'station' END AS level, tier, station, avg(v) AS mean, var_samp(v) AS var, count(v) AS n FROM {COLD} GROUP BY GROUPING SETS ((), (tier), (station)))"


def cold_rows(spark, sf_dir):
    s, n = B.table(spark, sf_dir, "supplier"), B.table(spark, sf_dir, "nation")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("tier"), F.col("n_name").alias("station"), F.col("s_acctbal").alias("v"))


@query(f"SELECT level, tier, station, round(mean, 4) AS mean, round(var, 4) AS var, n FROM {PRIORS}")
def hierarchical_prior(spark, sf_dir):
    return rounded(coldstart.priors(cold_rows(spark, sf_dir), "v").select("level", "tier", "station", "mean", "var", "n"), 4)


@query(f"""WITH p AS {PRIORS}, k AS (SELECT n_name AS station, n_regionkey AS tier FROM nation), g AS (SELECT k.station, k.tier, CASE WHEN s.station IS NOT NULL THEN s.mean WHEN t.tier IS NOT NULL THEN t.mean ELSE g.mean END AS pm, CASE WHEN s.station IS NOT NULL THEN s.var WHEN t.tier IS NOT NULL THEN t.var ELSE g.var END AS pv
FROM k LEFT JOIN p s ON s.level = 'station' AND s.station = k.station LEFT JOIN p t ON t.level = 'tier' AND t.tier = k.tier JOIN p g ON g.level = 'global'),
d AS (SELECT n_name AS station, count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
j AS (SELECT g.station, pm, pv, coalesce(n, 0) AS n, m, greatest(coalesce(pv, 1e-6), 1e-6) AS fp, CASE WHEN n > 1 THEN greatest(v, 1e-6) ELSE greatest(coalesce(pv, 1e-6), 1e-6) END AS dv FROM g LEFT JOIN d ON d.station = g.station)
SELECT station, round(CASE WHEN n > 0 THEN (pm / fp + n * m / dv) / (1 / fp + n / dv) ELSE pm END, 4) AS mean, round(CASE WHEN n > 0 THEN 1 / (1 / fp + n / dv) ELSE pv END, 4) AS var FROM j""")
def posterior(spark, sf_dir):
    n, c = B.table(spark, sf_dir, "nation"), B.table(spark, sf_dir, "customer")
    prior = coldstart.prior_of(n.select(F.col("n_name").alias("station"), F.col("n_regionkey").alias("tier")), coldstart.priors(cold_rows(spark, sf_dir), "v"))
    data = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("station")).agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("m"), F.var_pop("c_acctbal").alias("v"))
    rows = prior.join(data, "station", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    mean, var = coldstart.posterior(F.col("prior_mean"), F.col("prior_var"), F.col("n"), F.col("m"), F.col("v"))
    return rows.select("station", r(mean, 4).alias("mean"), r(var, 4).alias("var"))


def vectors(spark, sf_dir) -> DataFrame:
    return B.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


def asked(spark, sf_dir) -> DataFrame:
    """The query set of searches: every row whose id is divisible by 50, against all rows."""
    return vectors(spark, sf_dir).filter("id % 50 = 0")


VEC = "(SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings)"
SIMILAR = f"(SELECT id, other, CASE WHEN sum(s) OVER (PARTITION BY id) > 0 THEN s / sum(s) OVER (PARTITION BY id) ELSE s END AS weight FROM (SELECT a.id, b.id AS other, exp(-power(list_distance(a.x, b.x), 2) / 2) AS s FROM {VEC} a JOIN {VEC} b ON a.id % 50 = 0 AND a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY s DESC, b.id) <= 5))"


@query(f"SELECT id, other, round(weight, 6) AS weight FROM {SIMILAR}")
def similar_routes(spark, sf_dir):
    return rounded(coldstart.similar(asked(spark, sf_dir), vectors(spark, sf_dir)))


@query(f"SELECT id, step, round(1.5 * sum(weight * yhat), 4) AS yhat FROM {SIMILAR} w JOIN (SELECT vec_id AS other, unnest(range(3))::INT AS step, (label + 1) * 10.0 + step AS yhat FROM embeddings) f ON f.other = w.other GROUP BY ALL")
def transfer_forecast(spark, sf_dir):
    w = coldstart.similar(asked(spark, sf_dir), vectors(spark, sf_dir))
    f = B.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("other"), "label", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("step"))
    return rounded(coldstart.transfer(w, f.select("other", "step", ((F.col("label") + 1) * 10.0 + F.col("step")).alias("yhat")), 1.5), 4)


@query(f"SELECT a.id AS a, b.id AS b, round(coalesce(list_cosine_similarity(a.x, b.x), 0), 5) AS similarity FROM {VEC} a JOIN {VEC} b ON a.id % 50 = 0 AND a.id <> b.id")
def similarity_matrix(spark, sf_dir):
    return coldstart.similarity_matrix(asked(spark, sf_dir), vectors(spark, sf_dir), "cosine", digits=5)


@query("""WITH d AS (SELECT user_id, count(*) AS n, avg(value) AS own FROM events GROUP BY 1), w AS (SELECT *, least(1.0, n / 100.0::DOUBLE) AS w FROM d)
SELECT user_id, round(w, 6) AS weight, round(w * own + (1 - w) * 50, 6) AS yhat, round(w * own + (1 - w) * 50 - 1.96 * sqrt(400 * (1 - w) * (1 - w)), 6) AS lower, round(w * own + (1 - w) * 50 + 1.96 * sqrt(400 * (1 - w) * (1 - w)), 6) AS upper FROM w""")
def adaptive_blend(spark, sf_dir):
    d = B.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("own"))
    out = coldstart.blend(F.col("n"), F.col("own"), F.lit(50.0), F.lit(400.0), 100)
    return d.select("user_id", *[r(c).alias(n) for n, c in out.items()])


@query(f"SELECT k, round(n * cxy / (n * vx + 1), 6) AS weight, round(my - n * cxy / (n * vx + 1) * mx, 4) AS intercept FROM (SELECT k, count(*) AS n, covar_pop(y, yhat) AS cxy, var_pop(yhat) AS vx, avg(y) AS my, avg(yhat) AS mx FROM {PREDICTIONS} GROUP BY k)")
def ridge_stack(spark, sf_dir):
    out = models.ridge_one(B.predictions(spark, sf_dir), ["k"], "yhat", "y")
    return out.select("k", r("weight").alias("weight"), r("intercept", 4).alias("intercept"))


# ---- scalar functions ----
@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_props(spark, sf_dir):
    return B.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k INT")["k"].alias("k"))


@query(f"SELECT event_id, round({sql_cdf('z')}, 9) AS cdf FROM (SELECT event_id, (value - 50) / 10 AS z FROM events)")
def norm_cdf_table(spark, sf_dir):
    return B.table(spark, sf_dir, "events").select("event_id", ((F.col("value") - 50) / 10).alias("z")).select("event_id", r(X.norm_cdf(F.col("z")), 9).alias("cdf"))


@query(f"WITH s AS (SELECT * FROM (VALUES {STATIONS}) t(code, tier, lat, lon)) SELECT a.code AS a, b.code AS b, round(2 * 6371 * asin(sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2))), 4) AS km FROM s a JOIN s b ON a.code < b.code")
def haversine_pairs(spark, sf_dir):
    s = dims.stations(spark)
    a, b = s.select(F.col("code").alias("a"), F.col("latitude").alias("la"), F.col("longitude").alias("lo")), s.select(F.col("code").alias("b"), F.col("latitude").alias("lb"), F.col("longitude").alias("ob"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", r(X.haversine_km(F.col("la"), F.col("lo"), F.col("lb"), F.col("ob")), 4).alias("km"))


@query("SELECT c_custkey, upper(c_name) AS code, length(c_name) >= 8 AND c_acctbal BETWEEN 0 AND 9000 AND regexp_matches(c_mktsegment, '^[A-Z]+$') AS valid FROM customer")
def validation_split(spark, sf_dir):
    from stowage.sources.store import valid_rows

    rules = {"name": F.length("c_name") >= 8, "balance": F.col("c_acctbal").between(0, 9000), "segment": F.col("c_mktsegment").rlike("^[A-Z]+$")}
    return valid_rows(B.table(spark, sf_dir, "customer"), rules).select("c_custkey", F.upper("c_name").alias("code"), "valid")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    out = B.table(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", r("total", 4).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def sessions(spark, sf_dir):
    w = F.session_window(F.col("ts").cast("timestamp"), "6 hours")
    return B.table(spark, sf_dir, "events").groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


# ---- tables, reports and small derivations ----
@query(f"SELECT rec_id, strftime(o_orderdate, '%Y%m%d') AS day, 'REC-' || strftime(o_orderdate, '%Y%m%d') || '-' || lpad((row_number() OVER (PARTITION BY o_orderdate ORDER BY rec_id))::VARCHAR, 5, '0') AS label FROM {RECS}")
def surrogate_ids(spark, sf_dir):
    rows = recs(spark, sf_dir).withColumnRenamed("rec_id", "n")
    return recommend.ids(rows, "REC", "o_orderdate", ["n"]).select(F.col("n").alias("rec_id"), F.date_format("o_orderdate", "yyyyMMdd").alias("day"), F.col("rec_id").alias("label"))


@query(f"SELECT rec_id, priority, quantity FROM {COSTS} WHERE origin = '3' OR destination = '3' ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, o_orderdate, rec_id")
def pending_recs(spark, sf_dir):
    from stowage.sources import store

    rows = recs(spark, sf_dir).select(F.col("rec_id").alias("recommendation_id"), "priority", "quantity", F.col("origin").alias("origin_station"), F.col("destination").alias("destination_station"), F.col("o_orderdate").alias("required_by"), F.lit("pending").alias("status"))
    return store.pending(rows, "3").select(F.col("recommendation_id").alias("rec_id"), "priority", "quantity")


@query("SELECT o_orderkey, CASE WHEN o_orderkey = 7 THEN 'executed' ELSE o_orderstatus END AS status FROM orders WHERE NOT o_orderkey % 10 = 3 AND o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 90 DAY")
def rewrite_rows(spark, sf_dir):
    """Delete by predicate, retention and a conditional update, as the next version of a table."""
    from stowage.sources import store

    rows = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("recommendation_id"), F.col("o_orderstatus").alias("status"), "o_orderdate")
    kept = store.retained(store.without(rows, F.col("recommendation_id") % 10 == 3), "o_orderdate", F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))
    return store.with_status(kept, 7, "executed").select(F.col("recommendation_id").alias("o_orderkey"), "status")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 50")
def pagination(spark, sf_dir):
    from stowage.sources import store

    return store.page(B.table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 25, 50)


@query("SELECT n_name AS code, CASE WHEN length(n_name) = 3 AND n_name NOT LIKE 'K%' THEN 'international' ELSE 'spoke' END AS tier, CASE WHEN length(n_name) = 3 AND n_name NOT LIKE 'K%' THEN 20 ELSE 10 END AS safety_stock FROM nation")
def safety_stock(spark, sf_dir):
    tier = dims.tier_of(F.col("n_name"))
    return B.table(spark, sf_dir, "nation").select(F.col("n_name").alias("code"), tier.alias("tier"), dims.lookup(dims.SAFETY_STOCK, tier, 10).alias("safety_stock"))


@query(f"SELECT * FROM (VALUES {sql_values([(c[0], c[1] - c[2], round(c[4] * c[5] * c[6] / 1e6, 3)) for c in dims.CONTAINERS])}) t(uld_type, payload_kg, box_m3)")
def container_specs(spark, sf_dir):
    return dims.containers(spark).select("uld_type", "payload_kg", r(F.col("height_cm") * F.col("width_cm") * F.col("length_cm") / 1e6, 3).alias("box_m3"))


@query(f"SELECT d, (month(d) * 100 + day(d) BETWEEN 1120 AND 1130) OR (month(d) * 100 + day(d) >= 1220 OR month(d) * 100 + day(d) <= 105) OR (month(d) * 100 + day(d) BETWEEN 701 AND 707) AS travel FROM (SELECT DISTINCT d FROM {DEMAND})")
def travel_periods(spark, sf_dir):
    return B.demand(spark, sf_dir).select("d").distinct().select("d", features.is_travel_period(F.col("d")).alias("travel"))


@query("SELECT event_id, '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\"}' AS doc FROM events")
def json_encode(spark, sf_dir):
    return B.table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("doc"))


@query(f"SELECT sum(total)::BIGINT AS total, sum(available)::BIGINT AS available, round((sum(total) - sum(available)) / sum(total), 6) AS utilisation, round(avg(available / total), 6) AS mean_ratio FROM (SELECT station, sum(total) AS total, sum(available) AS available FROM {INVENTORY} GROUP BY station)")
def kpi_summary(spark, sf_dir):
    s = tracking.inventory(B.assets(spark, sf_dir)).groupBy("station").agg(F.sum("total").alias("total"), F.sum("available").alias("available"))
    return s.agg(F.sum("total").alias("t"), F.sum("available").alias("a"), F.avg(F.col("available") / F.col("total")).alias("m")).select(F.col("t").alias("total"), F.col("a").alias("available"), r((F.col("t") - F.col("a")) / F.col("t")).alias("utilisation"), r("m").alias("mean_ratio"))


@query(f"SELECT station, uld_type, floor(n * share)::BIGINT AS units FROM (SELECT o_orderpriority AS station, count(*) AS n FROM orders GROUP BY 1), (VALUES {sql_values(dims.TYPE_MIX)}) m(uld_type, share)")
def type_split(spark, sf_dir):
    kinds = F.explode(F.array(*[F.struct(F.lit(t).alias("uld_type"), F.lit(v).alias("share")) for t, v in dims.TYPE_MIX]))
    s = B.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("station")).agg(F.count(F.lit(1)).alias("n"))
    return s.withColumn("k", kinds).select("station", "k.uld_type", F.floor(F.col("n") * F.col("k.share")).alias("units"))


@query(f"""WITH e AS (SELECT origin, destination, sum(quantity)::BIGINT AS units FROM {RECS} WHERE origin <> destination GROUP BY ALL), n AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS i FROM (SELECT origin AS name FROM e UNION SELECT destination FROM e))
SELECT a.i AS source, b.i AS target, units FROM e JOIN n a ON a.name = e.origin JOIN n b ON b.name = e.destination""")
def edge_list(spark, sf_dir):
    """Flows between numbered nodes, as a flow diagram needs them. Nodes are a bounded dimension."""
    e = recs(spark, sf_dir).filter("origin <> destination").groupBy("origin", "destination").agg(F.sum("quantity").alias("units"))
    n = e.select(F.explode(F.array("origin", "destination")).alias("name")).distinct().withColumn("i", (F.row_number().over(Window.orderBy("name")) - 1).cast("long"))
    a, b = n.toDF("origin", "source"), n.toDF("destination", "target")
    return e.join(a, "origin").join(b, "destination").select("source", "target", "units")


@query(f"WITH e AS (SELECT k, d, yhat - y AS e FROM {PREDICTIONS}) SELECT a.k AS a, b.k AS b, round(covar_samp(a.e, b.e), 3) AS cov FROM e a JOIN e b ON a.d = b.d GROUP BY ALL")
def residual_covariance(spark, sf_dir):
    e = B.predictions(spark, sf_dir).select("k", "d", (F.col("yhat") - F.col("y")).alias("e"))
    a, b = e.toDF("a", "d", "ea"), e.toDF("b", "d", "eb")
    return a.join(b, "d").groupBy("a", "b").agg(r(F.covar_samp("ea", "eb"), 3).alias("cov"))


@query(f"""WITH c AS (SELECT user_id, event_id, up > 100 OR down > 100 AS alarm, least(greatest(up, down) / 100, 1) AS cs FROM {CUSUM}),
z AS (SELECT event_id, abs(value - avg(value) OVER w) / greatest(stddev_pop(value) OVER w, 1e-6) AS z FROM events WINDOW w AS (PARTITION BY user_id))
SELECT c.event_id, alarm OR z > 2 AS is_anomaly, round((least(cs, 1) + least(z / 2, 1)) / 2, 6) AS anomaly_score, (CASE WHEN alarm THEN 'cusum' ELSE '' END) || '|' || (CASE WHEN z > 2 THEN 'zscore' ELSE '' END) AS reasons FROM c JOIN z ON z.event_id = c.event_id""")
def anomaly_ensemble(spark, sf_dir):
    rows = anomaly.cusum(B.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 50.0, 5.0, 100.0)
    rows = anomaly.zscore(rows, "user_id", "value", 2.0).withColumns({"c": F.greatest("up", "down") / 100, "s": F.col("z") / 2})
    out = rows.withColumns(anomaly.ensemble({"cusum": ("alarm", "c"), "zscore": ("outlier", "s")}))
    has = lambda n: F.when(F.array_contains("reasons", n), n).otherwise("")
    return out.select("event_id", "is_anomaly", r("anomaly_score").alias("anomaly_score"), F.concat_ws("|", has("cusum"), has("zscore")).alias("reasons"))


@query("SELECT n_regionkey, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance, grouping(n_regionkey)::INT + grouping(n_name)::INT AS level FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)")
def rollup_levels(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer").join(B.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    level = (F.grouping("n_regionkey") + F.grouping("n_name")).cast("int")
    return c.rollup("n_regionkey", "n_name").agg(F.count(F.lit(1)).alias("customers"), r(F.sum("c_acctbal"), 2).alias("balance"), level.alias("level"))


@query("""SELECT o_custkey AS station, 40 + greatest(0, 8 * count(*) FILTER (o_orderstatus = 'F') + o_custkey % 11 - 5) - greatest(0, 8 * count(*) FILTER (o_orderstatus = 'O') + o_custkey % 7 - 3) AS total,
greatest(0, 30 + greatest(0, 8 * count(*) FILTER (o_orderstatus = 'F') + o_custkey % 11 - 5) - greatest(0, 8 * count(*) FILTER (o_orderstatus = 'O') + o_custkey % 7 - 3)) AS serviceable,
greatest(0, 8 * count(*) FILTER (o_orderstatus = 'O') + o_custkey % 7 - 3) AS units_out, greatest(0, 8 * count(*) FILTER (o_orderstatus = 'F') + o_custkey % 11 - 5) AS units_in FROM orders GROUP BY o_custkey""")
def day_movements(spark, sf_dir):
    """Customers as stations: open orders depart, filled ones arrive."""
    flights_of = lambda v: F.count_if(F.col("o_orderstatus") == v)
    rows = B.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("station")).agg(flights_of("O").alias("departure_flights"), flights_of("F").alias("arrival_flights"))
    rows = rows.withColumns({"total": F.lit(40), "serviceable": F.lit(30)})
    return tracking.day_movements(rows, F.col("station") % 7 - 3, F.col("station") % 11 - 5).drop("departure_flights", "arrival_flights")


@query(f"""SELECT icao, round(250 + (lon + 125) / 59 * 920 * (cos(radians(lat)) * 0.85::DOUBLE + 0.15::DOUBLE), 6) AS x, round(100 + (1 - (lat - 24.5::DOUBLE) / 25) * 550, 6) AS y
FROM (VALUES {sql_values([(s[1], s[5], s[6]) for s in dims.STATIONS] + list(dims.AIRPORTS))}) t(icao, lat, lon)""")
def map_points(spark, sf_dir):
    return rounded(dims.airports(spark).withColumn("p", X.map_point(F.col("latitude"), F.col("longitude"))).select("icao", "p.x", "p.y"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, format('{:,}', l_extendedprice::BIGINT) AS price, printf('%.1f%%', l_discount * 100) AS discount, strftime(l_shipdate::TIMESTAMP + INTERVAL 1 HOUR * l_linenumber, '%b %-d, %I:%M %p') AS shipped FROM lineitem")
def display_texts(spark, sf_dir):
    at = F.col("l_shipdate").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("l_linenumber").cast("int"))
    price = X.number_text(F.bround("l_extendedprice", 0))
    return B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", price.alias("price"), X.percent_text(F.col("l_discount")).alias("discount"), X.date_text(at).alias("shipped"))


# ---- generators ----
@query()
def generated_schedule(spark, sf_dir):
    from stowage.sources import synth

    return synth.schedule(dims.stations(spark), date(2024, 1, 1), 3)


@query()
def generated_demand(spark, sf_dir):
    from stowage.sources import synth

    return rounded(synth.demand_series(dims.stations(spark), date(2024, 1, 1), 7), 6)


@query()
def generated_storms(spark, sf_dir):
    from stowage.sources import synth

    return synth.scenario_totals(synth.regional_scenarios(spark, "winter_storm", 20, 2024))


@query("""SELECT substr(o_orderpriority, 1, 1) AS scenario_id, min(o_orderdate) AS "start", max(o_orderdate) AS "end", count(DISTINCT o_custkey) AS stations, sum(o_orderkey % 9)::BIGINT AS flights, sum(o_orderkey % 50)::BIGINT AS units FROM orders GROUP BY 1""")
def scenario_totals(spark, sf_dir):
    from stowage.sources import synth

    rows = B.table(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).alias("scenario_id"), F.col("o_orderdate").alias("start"), F.col("o_orderdate").alias("end"), F.col("o_custkey").alias("station"), (F.col("o_orderkey") % 9).alias("flights"), (F.col("o_orderkey") % 50).alias("units"))
    return synth.scenario_totals(rows)


# The queries of feeds and of the larger models register themselves.
from stowage.plans import feed_queries, model_queries, service_queries  # noqa: E402, F401
