"""Demand, supply and imbalance forecasts for all stations at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions import exprs as X

STEP_HOURS = {"hourly": 1, "daily": 24, "weekly": 168}


def horizon(keys: DataFrame, as_of: Column, hours_ahead: int, granularity: str = "hourly") -> DataFrame:
    """keys times the periods of the horizon: forecast_time, step."""
    if granularity not in STEP_HOURS or not 1 <= hours_ahead <= 168:
        raise ValueError("granularity must be hourly, daily or weekly; hours_ahead 1 to 168")
    size = STEP_HOURS[granularity]
    count = -(-hours_ahead // size)
    rows = keys.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return rows.withColumn("forecast_time", as_of + F.make_dt_interval(hours=F.col("step") * size))


def demand_point(base: Column, at: Column, departures: Column | None = None) -> Column:
    """Base times hour and weekend factors, at least 8 for each wide-body departure near, in whole units, 1 at least."""
    raw = base * X.hour_factor(F.hour(at)) * X.weekend_factor(at)
    raw = raw if departures is None else F.greatest(raw, 8.0 * departures)
    return F.greatest(F.lit(1), raw.cast("int")).cast("double")


def demand_band(point: Column) -> Column:
    return X.band(point, F.greatest(F.lit(1.0), 0.15 * point))


def demand_by_type(rows: DataFrame, mix: Sequence[tuple[str, float]], point: str = "demand") -> DataFrame:
    """Each row for each (type, share) of the mix: whole units and a wider band."""
    kinds = F.explode(F.array(*[F.struct(F.lit(t).alias("uld_type"), F.lit(s).alias("share")) for t, s in mix]))
    unit = (F.col(point) * F.col("share")).cast("int").cast("double")
    out = rows.withColumn("_k", kinds).select(*rows.columns, "_k.*").withColumn("type_point", unit)
    return out.withColumn("type_band", X.band(F.col("type_point"), F.greatest(F.lit(1.0), 0.2 * F.col("type_point"))))


def running_stock(rows: DataFrame, keys: list[str], order: list[str], change: Column, initial: float, name: str = "stock") -> DataFrame:
    """max(0, previous + change) from initial on, as a running sum less its lowest point below zero."""
    by = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = rows.withColumn("_s", initial + F.sum(change).over(by))
    return total.withColumn(name, F.col("_s") - F.least(F.lit(0.0), F.min("_s").over(by))).drop("_s")


def supply_band(stock: Column) -> Column:
    return X.band(stock, F.greatest(F.lit(1.0), 0.1 * stock))


def imbalance(supply: Column, demand: Column) -> tuple[Column, Column, Column]:
    """(band, shortage probability, severity) of supply less demand."""
    mid = supply["q50"] - demand["q50"]
    sigma = F.sqrt(F.pow(X.iqr(supply) / X.IQR_SIGMA, 2) + F.pow(X.iqr(demand) / X.IQR_SIGMA, 2))
    p = F.when(sigma > 0, X.norm_cdf(-mid / F.when(sigma > 0, sigma))).otherwise(F.when(mid < 0, 1.0).otherwise(0.0))
    return X.band(mid, sigma, clamp=False), p, X.severity(p)


def first_period(rows: DataFrame, key: str, time: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(time))).filter("_r = 1").drop("_r")


def network_totals(first: DataFrame) -> DataFrame:
    """One row: summed medians of demand and supply with the network's band, and how many stations are short or have too much.

    first: station_id, demand_q50, supply_q50, imbalance_q50, shortage_probability.
    """
    short = F.col("shortage_probability") > 0.5
    sums = first.agg(
        F.count(F.lit(1)).alias("stations"), F.sum("demand_q50").alias("demand"), F.sum("supply_q50").alias("supply"),
        F.count_if(short).alias("shortage_stations"), F.count_if(~short & (F.col("imbalance_q50") > 10)).alias("surplus_stations"),
    )
    sigma = 5.0 * F.sqrt("stations")
    out = sums.withColumns({"d": X.band(F.col("demand"), sigma), "s": X.band(F.col("supply"), sigma)})
    balanced = F.abs(F.col("supply") - F.col("demand")) < 0.1 * F.col("demand")
    return out.select("stations", "demand", "supply", F.col("d.q05").alias("demand_q05"), F.col("s.q95").alias("supply_q95"), "shortage_stations", "surplus_stations", balanced.alias("balanced"))


def network_imbalance(flows: DataFrame, initial: float = 200.0) -> DataFrame:
    """Hourly imbalance of every station, from (station_id, forecast_time, arrivals, departures, demand)."""
    rows = running_stock(flows, ["station_id"], ["forecast_time"], F.col("arrivals") - F.col("departures"), initial)
    rows = rows.withColumns({"d": demand_band(F.col("demand")), "s": supply_band(F.col("stock"))})
    b, p, _ = imbalance(F.col("s"), F.col("d"))
    out = rows.withColumns({"b": b, "p": p}).withColumn("severity", X.severity(F.col("p")))
    return out.select("station_id", "forecast_time", F.col("d.q50").alias("demand_q50"), F.col("s.q50").alias("supply_q50"), F.col("b.q50").alias("imbalance_q50"), F.col("b.q05").alias("imbalance_q05"), F.col("p").alias("shortage_probability"), "severity")


def priority_stations(first: DataFrame, top_n: int = 5) -> DataFrame:
    short = F.when(F.col("imbalance_q50") < 0, F.abs("imbalance_q50")).otherwise(0.0)
    return first.withColumn("estimated_shortage", short).orderBy(F.desc("shortage_probability"), "station_id").limit(top_n)


def supply_by_type(rows: DataFrame, mix: Sequence[tuple[str, float]], stock: str = "stock") -> DataFrame:
    """Each row for each (type, share) of the mix: the share of the stock, not in whole units, and its band."""
    kinds = F.explode(F.array(*[F.struct(F.lit(t).alias("uld_type"), F.lit(s).alias("share")) for t, s in mix]))
    out = rows.withColumn("_k", kinds).select(*rows.columns, "_k.*").withColumn("type_point", F.col(stock) * F.col("share"))
    return out.withColumn("type_band", X.band(F.col("type_point"), F.greatest(F.lit(1.0), 0.15 * F.col("type_point"))))


def imbalance_by_type(rows: DataFrame, demand_mix: Sequence[tuple[str, float]], supply_mix: Sequence[tuple[str, float]], demand: str = "demand", stock: str = "stock") -> DataFrame:
    """Each row for each type in both mixes: bands of demand, supply and their difference, which may be below zero.

    A row holds its demand and stock, and the mixes are fixed dimensions, so the inner join on types needs no shuffle.
    """
    own = dict(supply_mix)
    both = [(t, s, own[t]) for t, s in demand_mix if t in own]
    kinds = F.explode(F.array(*[F.struct(F.lit(t).alias("uld_type"), F.lit(d).alias("_d"), F.lit(s).alias("_s")) for t, d, s in both]))
    out = rows.withColumn("_k", kinds).select(*rows.columns, "_k.*")
    d, s = (F.col(demand) * F.col("_d")).cast("int").cast("double"), F.col(stock) * F.col("_s")
    out = out.withColumns({"demand_band": X.band(d, F.greatest(F.lit(1.0), 0.2 * d)), "supply_band": X.band(s, F.greatest(F.lit(1.0), 0.15 * s))})
    return out.withColumn("imbalance_band", imbalance(F.col("supply_band"), F.col("demand_band"))[0]).drop("_d", "_s")


def station_states(first: DataFrame) -> DataFrame:
    """Each station as short, as one with a surplus, or neither: a short one is in no list of surpluses."""
    state = F.when(F.col("shortage_probability") > 0.5, "shortage").when(F.col("imbalance_q50") > 10, "surplus").otherwise("balanced")
    return first.withColumn("state", state)


def chart(demand: DataFrame, supply: DataFrame, key: str = "station", time: str = "forecast_time") -> DataFrame:
    """Demand periods beside the supply periods of the same place in their series; 0 where supply ends earlier.

    supply: key, time and value columns whose names demand doesn't have.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(time))
    values = [c for c in supply.columns if c not in (key, time)]
    right = supply.withColumn("_i", place).select(key, "_i", *values)
    out = demand.withColumn("_i", place).join(right, [key, "_i"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in values}).drop("_i")


def from_schedule(hours: DataFrame, departures: DataFrame, arrivals: DataFrame, base: Column, initial: Column, per_flight: int = 8) -> DataFrame:
    """Demand and stock of (station, hour) rows by the flights (station, ts) less than an hour from each: demand, departures, arrivals, stock.

    Demand is at least per_flight for each departure near, and so many units leave and arrive with each flight. base and
    initial are columns of hours.
    """
    from stowage.operators.flights import movements_near

    near = lambda f, name: movements_near(hours, f, "ts").withColumnRenamed("flights", name)
    rows = hours.join(near(departures, "f_out"), ["station", "hour"]).join(near(arrivals, "f_in"), ["station", "hour"])
    rows = rows.withColumn("demand", demand_point(base, F.col("hour"), F.col("f_out")))
    rows = rows.withColumns({"departures": per_flight * F.col("f_out"), "arrivals": per_flight * F.col("f_in")})
    return running_stock(rows, ["station"], ["hour"], F.col("arrivals") - F.col("departures"), initial).drop("f_out", "f_in")


def first_rows(forecasts: DataFrame, keys: list[str], order: list[str], hours: int, generated: str = "generated_at") -> DataFrame:
    """The first `hours` rows of each key's last generation; each task keeps its own first rows before they meet."""
    from stowage.operators.tracking import latest_generation

    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return latest_generation(forecasts, keys, generated).withColumn("step", rank).filter(F.col("step") <= hours)
