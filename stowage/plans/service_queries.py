"""Queries that the service's and the dashboard's calls come down to, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions import exprs as X
from stowage.functions.shared import cut
from stowage.operators import coldstart, flights, recommend
from stowage.plans import bindings as B
from stowage.plans.registry import query, rounded

FLIGHTS = "(SELECT l_orderkey AS flight_number, l_linenumber, l_suppkey, c_nationkey AS o, s_nationkey AS d, o_orderdate AS dep, l_shipdate AS arr, l_quantity AS units FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)"


# ---- cold start: routes by their features ----
ROUTES = f"""(SELECT o * 25 + d AS id, [ (o % 3)::DOUBLE, (d % 3)::DOUBLE, abs(o - d) * 100.0::DOUBLE / 5000, least(12, avg(epoch(arr) - epoch(dep)) / 864000.0::DOUBLE) / 12, avg((units > 25)::INT), (o // 5 <> d // 5)::INT::DOUBLE, ((o + d) % 3)::DOUBLE, ln(1 + count(*) / 365.0::DOUBLE)] AS x FROM {FLIGHTS} GROUP BY o, d)"""


def routes(spark, sf_dir) -> DataFrame:
    """Every flown route with its features."""
    days = (F.unix_micros(F.col("arrival").cast("timestamp")) - F.unix_micros(F.col("departure").cast("timestamp"))) / 1e6
    rows = B.flights(spark, sf_dir).groupBy(F.col("origin").alias("o"), F.col("destination").alias("d")).agg(
        F.least(F.lit(12.0), F.avg(days) / 864000.0).alias("hours"), F.avg((F.col("units") > 25).cast("int")).alias("widebody"), (F.count(F.lit(1)) / 365.0).alias("flights_per_day"))
    tier = lambda c: F.element_at(F.array(F.lit("hub"), F.lit("focus"), F.lit("spoke")), (F.col(c) % 3 + 1).cast("int"))
    purpose = F.element_at(F.array(F.lit("business"), F.lit("leisure"), F.lit("mixed")), ((F.col("o") + F.col("d")) % 3 + 1).cast("int"))
    region = lambda c: F.floor(F.col(c) / 5)
    return rows.select((F.col("o") * 25 + F.col("d")).alias("id"), tier("o").alias("origin_tier"), tier("d").alias("destination_tier"), (F.abs(F.col("o") - F.col("d")) * 100.0).alias("distance_km"), "hours", "widebody", (region("o") != region("d")).alias("international"), purpose.alias("purpose"), "flights_per_day")


@query(f"SELECT id, {', '.join(f'round(x[{k}], 6) AS f{k}' for k in range(1, 9))} FROM {ROUTES}")
def route_features(spark, sf_dir):
    return rounded(coldstart.register_routes(routes(spark, sf_dir)).select("id", *[F.get("x", k - 1).alias(f"f{k}") for k in range(1, 9)]))


@query(f"""SELECT id, other, round(CASE WHEN sum(s) OVER (PARTITION BY id) > 0 THEN s / sum(s) OVER (PARTITION BY id) ELSE s END, 5) AS weight FROM (SELECT a.id, b.id AS other, exp(-power(list_distance(a.x, b.x), 2) / 2) AS s FROM {ROUTES} a JOIN {ROUTES} b ON a.id <> b.id
QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) <= 5)""")
def similar_flown_routes(spark, sf_dir):
    """The five routes most like each route, by the features of both."""
    known = cut(coldstart.register_routes(routes(spark, sf_dir)))  # else each of the search's passes joins and sums all flights again
    return rounded(coldstart.similar(known, known), 5)


# ---- stations ----
@query(f"""SELECT station, direction, scheduled, flight_number, row_number() OVER (PARTITION BY station, direction ORDER BY scheduled, flight_number, l_linenumber, l_suppkey) AS place FROM (
SELECT o AS station, 'departure' AS direction, dep AS scheduled, flight_number, l_linenumber, l_suppkey FROM {FLIGHTS} UNION ALL SELECT d, 'arrival', arr, flight_number, l_linenumber, l_suppkey FROM {FLIGHTS}) WHERE scheduled BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-03-31'""")
def station_boards(spark, sf_dir):
    """Every station's departures and arrivals of a window, closed at both ends, each by its own scheduled time."""
    window = (F.lit("1996-03-01").cast("timestamp_ntz"), F.lit("1996-03-31").cast("timestamp_ntz"))
    return flights.boards(B.flights(spark, sf_dir), *window).select("station", "direction", F.col("at").alias("scheduled"), "flight_number", F.col("place").cast("long").alias("place"))


# ---- recommendations ----
RECS = """(SELECT o_orderkey AS rec_id, (o_custkey % 10)::VARCHAR AS origin, (o_custkey % 7)::VARCHAR AS destination, (o_orderkey % 12 + 1)::INT AS quantity, (o_custkey % 101) / 100.0::DOUBLE AS p FROM orders)"""
LEVEL = "CASE WHEN p >= 0.8 THEN 'critical' WHEN p >= 0.5 THEN 'high' WHEN p >= 0.3 THEN 'medium' ELSE 'low' END"


def recs(spark, sf_dir) -> DataFrame:
    p = (F.col("o_custkey") % 101) / 100.0
    rows = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rec_id"), (F.col("o_custkey") % 10).cast("string").alias("origin"), (F.col("o_custkey") % 7).cast("string").alias("destination"), (F.col("o_orderkey") % 12 + 1).cast("int").alias("quantity"), p.alias("shortage_probability"), F.lit("ground").alias("method"))
    rows = rows.withColumns(recommend.cost_benefit(F.col("quantity"), F.col("shortage_probability"), F.col("method")))
    return rows.withColumn("priority", X.priority(F.col("shortage_probability")))


@query(f"""SELECT station, count(*) AS actions, sum(quantity)::BIGINT AS units, bool_or(level = 'critical') AS has_critical, count(*) FILTER (side = 'out') AS leaving FROM (
SELECT origin AS station, 'out' AS side, quantity, {LEVEL} AS level FROM {RECS} UNION ALL SELECT destination, 'in', quantity, {LEVEL} FROM {RECS}) GROUP BY station""")
def station_actions(spark, sf_dir):
    """Both sides' recommendations of every station in one list: how many, and whether one is critical."""
    return recommend.station_actions(recs(spark, sf_dir))


@query(f"""SELECT rec_id, level AS priority, quantity, origin AS origin_station, destination AS destination_station, round(150.0::DOUBLE * quantity + 50.0::DOUBLE * quantity, 2) AS total_cost, round(quantity * p * 500, 2) AS avoided, true AS complete
FROM (SELECT *, {LEVEL} AS level FROM {RECS})""")
def recommendation_responses(spark, sf_dir):
    """Responses as the service nests them, parsed back from their JSON."""
    shaped = recommend.responses(recs(spark, sf_dir))
    back = shaped.select(F.from_json("response", recommend.RESPONSE).alias("r"))
    return rounded(back.select(F.col("r.recommendation_id").cast("long").alias("rec_id"), "r.priority", "r.quantity", "r.origin_station", "r.destination_station", "r.cost_benefit.total_cost", F.col("r.cost_benefit.avoided_shortage_cost").alias("avoided"), F.col("r.cost_benefit.net_benefit").isNotNull().alias("complete")), 2)


@query(f"SELECT {LEVEL} AS priority, count(*) AS recommendations, sum(quantity)::BIGINT AS units FROM {RECS} GROUP BY 1")
def units_by_priority(spark, sf_dir):
    return recs(spark, sf_dir).groupBy("priority").agg(F.count(F.lit(1)).alias("recommendations"), F.sum("quantity").cast("long").alias("units"))
