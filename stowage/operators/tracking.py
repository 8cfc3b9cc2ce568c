"""Positions and inventory of assets. A position row: uld_id, station, ts, id and whatever else it carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AVAILABLE = ("serviceable", "empty")


def latest_position(positions: DataFrame, key: str = "uld_id") -> DataFrame:
    """The last row of each asset by time, then id. A max over structs combines before its shuffle."""
    rest = [c for c in positions.columns if c not in (key, "ts", "id")]
    last = positions.groupBy(key).agg(F.max(F.struct("ts", "id", *rest)).alias("last"))
    return last.select(key, "last.*")


def at_station(positions: DataFrame, station: str, as_of: Column | None = None) -> DataFrame:
    """Assets whose last position up to as_of is the station."""
    seen = positions if as_of is None else positions.filter(F.col("ts") <= as_of)
    return latest_position(seen).filter(F.col("station") == station)


def history(positions: DataFrame, uld_id, start: Column, end: Column) -> DataFrame:
    """Positions of one asset in the closed interval, in order."""
    return positions.filter((F.col("uld_id") == uld_id) & F.col("ts").between(start, end)).orderBy("ts", "id")


def recent(positions: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return positions.filter((F.col("ts") >= as_of - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col("ts") <= as_of))


def dwell(positions: DataFrame, as_of: Column, lookback_days: int = 30) -> DataFrame:
    """Each asset's trailing run at one station: (uld_id, station, since, dwell_hours). The lookback comes first."""
    by = Window.partitionBy("uld_id").orderBy("ts", "id")
    rows = recent(positions, as_of, lookback_days).withColumn("moved", (~F.col("station").eqNullSafe(F.lag("station").over(by))).cast("int"))
    rows = rows.withColumn("island", F.sum("moved").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    islands = rows.groupBy("uld_id", "island").agg(F.max("station").alias("station"), F.min("ts").alias("since"))
    last = islands.groupBy("uld_id").agg(F.max(F.struct("island", "station", "since")).alias("l")).select("uld_id", "l.station", "l.since")
    hours = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp"))) / 3.6e9
    return last.withColumn("dwell_hours", hours)


def stuck(positions: DataFrame, as_of: Column, threshold_hours: float = 72.0) -> DataFrame:
    return dwell(positions, as_of).filter(F.col("dwell_hours") > threshold_hours)


def inventory(assets: DataFrame) -> DataFrame:
    """Counts by station and type: all, available, in use, damaged. Other states count in the total alone."""
    s = F.col("status")
    counts = [F.count(F.lit(1)).alias("total"), F.count_if(s.isin(*AVAILABLE)).alias("available"), F.count_if(s == "in_use").alias("in_use"), F.count_if(s == "damaged").alias("damaged")]
    return assets.groupBy("station", "uld_type").agg(*counts)


def inventory_maps(counts: DataFrame) -> DataFrame:
    """One row a station with maps by type, totals and the available share (0 without assets)."""
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("uld_type", c)))).alias(c)
    out = counts.groupBy("station").agg(*[entries(c) for c in ("total", "available", "in_use", "damaged")], F.sum("total").alias("total_count"), F.sum("available").alias("total_available"))
    return out.withColumn("availability_ratio", F.when(F.col("total_count") > 0, F.col("total_available") / F.col("total_count")).otherwise(0.0))


def network_summary(counts: DataFrame, stations: DataFrame) -> DataFrame:
    """Totals of every station; those without assets count 0."""
    sums = counts.groupBy("station").agg(F.sum("total").alias("total"), F.sum("available").alias("available"))
    out = stations.select("station").join(sums, "station", "left").na.fill(0, ["total", "available"])
    return out.withColumn("ratio", F.when(F.col("total") > 0, F.col("available") / F.col("total")).otherwise(0.0))


def event_position(loaded: Column, origin: Column, destination: Column, departure: Column, arrival: Column) -> tuple[Column, Column]:
    """Station and time that a flight event implies: loaded is the origin at departure, anything else the destination."""
    return F.when(loaded, origin).otherwise(destination), F.when(loaded, departure).otherwise(arrival)


def inferred_positions(flights: DataFrame, assignments: DataFrame) -> DataFrame:
    """Positions of assets on flights that have landed, from (flight_number, uld_ids)."""
    landed = flights.filter(F.col("status").isin("landed", "arrived"))
    rows = landed.join(assignments, "flight_number").select(F.explode("uld_ids").alias("uld_id"), F.col("destination").alias("station"), F.coalesce("actual_arrival", "scheduled_arrival").alias("ts"), "flight_number")
    return rows.withColumn("confidence", F.lit(0.85))


def latest_generation(forecasts: DataFrame, keys: list[str], generated: str = "generated_at") -> DataFrame:
    """All rows of each key's last generation."""
    by = Window.partitionBy(*keys).orderBy(F.desc(generated))
    return forecasts.withColumn("_r", F.rank().over(by)).filter("_r = 1").drop("_r")


def decayed_confidence(source: Column, age_hours: Column) -> Column:
    """100 less 4 an hour for pings, 95 less 8 for flight events, 100 less 10 for scans, 0 at least."""
    raw = F.when(source == "geolocation", 100 - 4 * age_hours).when(source == "flight_event", 95 - 8 * age_hours).when(source == "scan", 100 - 10 * age_hours).otherwise(0.0)
    return F.greatest(raw, F.lit(0.0))


def day_movements(rows: DataFrame, extra_out: Column, extra_in: Column, per_flight: int = 8) -> DataFrame:
    """A day's stock after its wide-body flights: units out and in (flights times 8 and the given deviations, 0 at least), total, serviceable.

    rows: total, serviceable, departure_flights, arrival_flights.
    """
    moved = lambda n, e: F.greatest(F.lit(0), F.col(n) * per_flight + e)
    out = rows.withColumns({"units_out": moved("departure_flights", extra_out), "units_in": moved("arrival_flights", extra_in)})
    change = F.col("units_in") - F.col("units_out")
    return out.withColumns({"total": F.col("total") + change, "serviceable": F.greatest(F.lit(0), F.col("serviceable") + change)})
