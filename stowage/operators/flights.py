"""Flights: demand, routes, movement counts and traffic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.bounds import small


def duration_hours(departure: Column, arrival: Column) -> Column:
    return (F.unix_micros(arrival.cast("timestamp")) - F.unix_micros(departure.cast("timestamp"))) / 3.6e9


def is_widebody(known: Column, hours: Column) -> Column:
    """The aircraft table's flag; an unknown aircraft counts by its flight time."""
    return F.coalesce(known, hours > 3.0)


def unit_demand(widebody: Column, passengers: Column) -> Column:
    """Containers that a flight needs: none on a narrow body, else one for 40 passengers, 2 if nobody is booked."""
    return F.when(~widebody, 0).when(passengers > 0, F.greatest(F.lit(1), F.floor(passengers / 40).cast("int"))).otherwise(2)


def by_route(flights: DataFrame) -> DataFrame:
    key = F.concat_ws("-", F.col("origin").cast("string"), F.col("destination").cast("string"))
    return flights.groupBy(key.alias("route_key")).agg(F.count(F.lit(1)).alias("flights"), F.sum("demand").alias("demand"), F.min("departure").alias("first_departure"), F.max("departure").alias("last_departure"))


def movements_near(hours: DataFrame, flights: DataFrame, time_col: str, within_s: int = 3600) -> DataFrame:
    """How many flights are less than within_s from each (station, hour), both sides open.

    A band join as an equi-join: each flight goes to the hour buckets that it can reach, so nothing is compared with all.
    """
    t = F.unix_seconds(F.col(time_col).cast("timestamp"))
    buckets = F.explode(F.array(*[F.floor(t / within_s) + k for k in (-1, 0, 1)]))
    f = flights.select("station", t.alias("f_t"), buckets.alias("bucket"))
    h = hours.select("station", "hour").withColumn("h_t", F.unix_seconds(F.col("hour").cast("timestamp"))).withColumn("bucket", F.floor(F.col("h_t") / within_s))
    near = h.join(f, ["station", "bucket"], "left")
    return near.groupBy("station", "hour").agg(F.count_if(F.abs(F.col("f_t") - F.col("h_t")) < within_s).alias("flights"))


def airport_traffic(flights: DataFrame, measures: list[str]) -> DataFrame:
    """Sums as origin and as destination for all airports: one unpivot, one aggregate."""
    ends = F.explode(F.array(F.struct(F.col("origin").alias("airport"), F.lit(True).alias("out")), F.struct(F.col("destination").alias("airport"), F.lit(False).alias("out"))))
    rows = flights.select(ends.alias("end"), *measures)
    aggs = []
    for side, flag in (("out", True), ("in", False)):
        aggs.append(F.count_if(F.col("end.out") == flag).alias(f"flights_{side}"))
        aggs += [F.sum(F.when(F.col("end.out") == flag, F.col(m)).otherwise(0)).alias(f"{m}_{side}") for m in measures]
    return rows.groupBy(F.col("end.airport").alias("airport")).agg(*aggs)


def first_of(rows: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by an explicit order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def at_airport(flights: DataFrame, airport, direction: str = "both") -> DataFrame:
    """Departures, arrivals or both, one row a flight number and departure day. Flights are read once, whatever the direction."""
    if direction not in ("departure", "arrival", "both"):
        raise ValueError(f"unknown direction: {direction}")
    out, into = F.col("origin") == airport, F.col("destination") == airport
    if direction == "both":
        rows = flights.filter(out | into).withColumn("direction", F.explode(F.array(F.lit("departure"), F.lit("arrival")))).filter(F.when(F.col("direction") == "departure", out).otherwise(into))
    else:
        rows = flights.filter(out if direction == "departure" else into).withColumn("direction", F.lit(direction))
    return first_of(rows, ["flight_number", F.to_date("departure")], ["departure", F.desc("direction"), "destination"])


def connections(stations: DataFrame) -> DataFrame:
    """A hub connects with every other station, the others with hubs: (code, other). The table has a few rows."""
    a, b = stations.select("code", (F.col("tier") == "hub").alias("hub")), stations.select(F.col("code").alias("other"), (F.col("tier") == "hub").alias("other_hub"))
    return a.join(small(b), (F.col("code") != F.col("other")) & (F.col("hub") | F.col("other_hub"))).select("code", "other")


def load_plan(units: DataFrame, positions: int, max_kg: float) -> DataFrame:
    """Units in order onto a flight while positions and weight allow; one that doesn't fit doesn't stop later ones.

    units: flight, seq, uld_id, kg. The fold runs over one flight's own units.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "uld_id", F.col("kg").cast("double").alias("kg"))))
    grouped = units.groupBy("flight").agg(ordered.alias("units"))
    start = F.struct(F.lit(0).alias("used"), F.lit(0.0).alias("kg"), F.lit(0).alias("refused"))

    def step(acc: Column, u: Column) -> Column:
        fits = (acc["used"] < positions) & (acc["kg"] + u["kg"] <= max_kg)
        return F.struct(
            F.when(fits, acc["used"] + 1).otherwise(acc["used"]).alias("used"),
            F.when(fits, acc["kg"] + u["kg"]).otherwise(acc["kg"]).alias("kg"),
            F.when(fits, acc["refused"]).otherwise(acc["refused"] + 1).alias("refused"),
        )

    plan = grouped.withColumn("plan", F.aggregate("units", start, step)).select("flight", "plan.*")
    return plan.withColumn("utilization", F.col("used") / positions).withColumn("weight_utilization", F.col("kg") / max_kg)


def boards(flights: DataFrame, start: Column, end: Column) -> DataFrame:
    """(station, direction, at, flight_number, place) of every station's departures by departure and arrivals by arrival, within start and end."""
    both = F.explode(F.array(*[F.struct(F.col(station).alias("station"), F.lit(direction).alias("direction"), F.col(at).alias("at")) for station, direction, at in (("origin", "departure", "departure"), ("destination", "arrival", "arrival"))]))
    rows = flights.select(both.alias("b"), "flight_number", "l_linenumber", "l_suppkey").select("b.*", "flight_number", "l_linenumber", "l_suppkey").filter(F.col("at").between(start, end))
    place = F.row_number().over(Window.partitionBy("station", "direction").orderBy("at", "flight_number", "l_linenumber", "l_suppkey"))
    return rows.withColumn("place", place)
