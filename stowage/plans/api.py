"""The service's calls as functions that return tables: a Network holds the inputs, each call builds one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.functions import exprs as X
from stowage.operators import flights, forecast, recommend, tracking
from stowage.plans import dims
from stowage.sources import store


class NotFound(LookupError):
    """No such station or asset."""


@dataclass
class Network:
    spark: SparkSession
    positions: DataFrame  # uld_id, station, ts, id, ...
    assets: DataFrame  # uld_id, station, uld_type, status
    as_of: Column

    # stations
    def stations(self, tier: str | None = None) -> DataFrame:
        out = dims.stations(self.spark)
        return (out if tier is None else out.filter(F.col("tier") == tier)).orderBy("code")

    def hubs(self) -> DataFrame:
        return self.stations("hub")

    def station(self, code: str) -> DataFrame:
        return self.known(code)

    def known(self, code: str) -> DataFrame:
        out = dims.stations(self.spark).filter(F.col("code") == code.upper())
        if out.isEmpty():
            raise NotFound(code)
        return out

    def connections(self, code: str) -> DataFrame:
        self.known(code)
        return flights.connections(dims.stations(self.spark)).filter(F.col("code") == code.upper()).orderBy("other")

    # tracking
    def position(self, uld_id) -> DataFrame:
        out = tracking.latest_position(self.positions.filter(F.col("uld_id") == uld_id))
        if out.isEmpty():
            raise NotFound(uld_id)
        return out

    def movements(self, uld_id, days: int = 7) -> DataFrame:
        if not 1 <= days <= 90:
            raise ValueError("days must be 1 to 90")
        return tracking.recent(self.positions.filter(F.col("uld_id") == uld_id), self.as_of, days).orderBy("ts", "id")

    def ping(self, rows: DataFrame) -> DataFrame:
        """Geolocation rows as valid positions of confidence 0.95; a type that doesn't exist is an error."""
        bad = rows.filter(~F.col("uld_type").isin(*dims.CONTAINER_TYPES))
        if not bad.isEmpty():
            raise ValueError("unknown container type")
        have = set(rows.columns)
        filled = {"confidence": F.coalesce(F.col("confidence"), F.lit(0.95)) if "confidence" in have else F.lit(0.95), "position_source": F.lit("geolocation")}
        out = rows.withColumns({**filled, **{c: F.lit(None).cast("double") for c in ("latitude", "longitude") if c not in have}})
        return store.valid_rows(out, store.position_rules()).filter("valid").drop("valid", "broken")

    def inventory(self, code: str) -> DataFrame:
        return tracking.inventory_maps(tracking.inventory(self.assets.filter(F.col("station") == code.upper())))

    def summary(self) -> DataFrame:
        return tracking.network_summary(tracking.inventory(self.assets), dims.stations(self.spark).select(F.col("code").alias("station")))

    # forecasts
    def demand(self, hours: int = 24, granularity: str = "hourly") -> DataFrame:
        keys = dims.stations(self.spark).select(F.col("code").alias("station"), "tier")
        rows = forecast.horizon(keys, self.as_of, hours, granularity)
        point = forecast.demand_point(dims.lookup(dims.BASE_DEMAND, F.col("tier"), 10.0), F.col("forecast_time"))
        return rows.withColumn("demand", point).withColumn("band", forecast.demand_band(F.col("demand")))

    def supply(self, hours: int = 24, initial: float = 100.0) -> DataFrame:
        """Default movements balance, so stock stays at its start until flights say otherwise."""
        busy = F.hour("forecast_time").between(6, 10) | F.hour("forecast_time").between(15, 20)
        rows = self.demand(hours).select("station", "forecast_time").withColumns({"arrivals": F.when(busy, 10.0).otherwise(3.0), "departures": F.when(busy, 10.0).otherwise(3.0)})
        out = forecast.running_stock(rows, ["station"], ["forecast_time"], F.col("arrivals") - F.col("departures"), initial)
        return out.withColumn("band", forecast.supply_band(F.col("stock")))

    def imbalance(self, hours: int = 24) -> DataFrame:
        d = self.demand(hours).select("station", "forecast_time", F.col("band").alias("d"))
        both = d.join(self.supply(hours).select("station", "forecast_time", F.col("band").alias("s")), ["station", "forecast_time"])
        b, p, _ = forecast.imbalance(F.col("s"), F.col("d"))
        out = both.withColumns({"band": b, "p": p}).withColumn("severity", X.severity(F.col("p")))
        return out.select("station", "forecast_time", F.col("d.q50").alias("demand_q50"), F.col("s.q50").alias("supply_q50"), F.col("band.q50").alias("imbalance_q50"), F.col("band.q05").alias("imbalance_q05"), F.col("p").alias("shortage_probability"), "severity")

    def network(self, hours: int = 24) -> DataFrame:
        return forecast.network_totals(self.first(hours))

    def first(self, hours: int = 24) -> DataFrame:
        return forecast.first_period(self.imbalance(hours), "station", "forecast_time")

    def priority(self, hours: int = 24, top_n: int = 5) -> DataFrame:
        if not 1 <= top_n <= 20:
            raise ValueError("top_n must be 1 to 20")
        return forecast.priority_stations(self.first(hours).withColumnRenamed("station", "station_id"), top_n)

    # recommendations
    def split(self, hours: int) -> DataFrame:
        return self.first(hours).select("station", F.col("imbalance_q50").alias("q50"), F.col("shortage_probability").alias("p"))

    def repositioning(self, hours: int = 24) -> DataFrame:
        recs = recommend.repositioning(self.split(hours)).withColumn("method", F.lit("ground"))
        recs = recs.withColumns(recommend.cost_benefit(F.col("quantity"), F.col("shortage_probability"), F.col("method")))
        return recommend.ids(recs.withColumn("day", F.to_date(self.as_of)), "REC", "day", ["origin", "destination"])

    def plan(self, hours: int = 24) -> DataFrame:
        return recommend.station_plan(self.repositioning(hours).withColumnsRenamed({"total_cost": "cost", "total_benefit": "benefit"}))

    def optimize(self, hours: int = 24, max_moves: int = 3) -> DataFrame:
        if not 1 <= max_moves <= 20:
            raise ValueError("max_moves must be 1 to 20")
        networks = self.split(hours).withColumn("network", F.lit("all"))
        return recommend.move_economics(recommend.greedy_moves(networks.select("network", "station", "q50"), dims.distances(self.spark), max_moves), networks)

    def recommendation_summary(self, hours: int = 24) -> DataFrame:
        return recommend.summary(self.repositioning(hours))
