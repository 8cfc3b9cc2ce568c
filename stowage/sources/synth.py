"""Generators: deterministic by seed, since every draw is a hash of the row's own keys and not of a partition's order."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions import exprs as X
from stowage.plans import dims


def uniform(seed: int, tag: str, *keys: Column | str) -> Column:
    """In (0, 1), the same for the same seed, tag and keys."""
    h = F.xxhash64(F.lit(seed), F.lit(tag), *[F.col(k) if isinstance(k, str) else k for k in keys])
    return (F.shiftrightunsigned(h, 11) + 0.5) / float(1 << 53)


def normal(seed: int, tag: str, *keys: Column | str) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, tag + "/r", *keys))) * F.cos(2 * math.pi * uniform(seed, tag + "/a", *keys))


def weighted(u: Column, choices: dict[str, float]) -> Column:
    """The choice whose cumulative weight holds u."""
    total, acc, out = sum(choices.values()), 0.0, None
    for name, w in choices.items():
        acc += w / total
        out = F.when(u < acc, name) if out is None else out.when(u < acc, name)
    return out.otherwise(name)


def route_frequency(a: Column, b: Column) -> Column:
    """Flights a day by the tiers of both ends."""
    pair = F.concat_ws("-", F.least(a, b), F.greatest(a, b))
    return dims.lookup({"hub-hub": 8, "focus_city-hub": 6, "hub-spoke": 3, "focus_city-focus_city": 2}, pair, 0)


def days_of(rows: DataFrame, start: date, days: int) -> DataFrame:
    return rows.withColumn("day", F.explode(F.sequence(F.lit(start), F.date_add(F.lit(start), days - 1))))


def schedule(stations: DataFrame, start: date, days: int, seed: int = 42) -> DataFrame:
    """Flights between all pairs of stations: frequency by tiers and weekend, bank hours, aircraft by distance."""
    s = stations.select("code", "tier", "latitude", "longitude")
    a, b = s.toDF("origin", "ot", "olat", "olon"), s.toDF("destination", "dt", "dlat", "dlon")
    pairs = a.join(F.broadcast(b), F.col("origin") != F.col("destination")).withColumn("base", route_frequency(F.col("ot"), F.col("dt"))).filter("base > 0")
    rows = days_of(pairs, start, days)
    jitter = F.floor(uniform(seed, "frequency", "origin", "destination", "day") * 3) - 1
    count = F.greatest(F.lit(1), (F.col("base") + jitter) * F.when(F.weekday("day") >= 5, 0.85).otherwise(1.0)).cast("int")
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(1), count)))
    key = ["origin", "destination", "day", "n"]
    minute = F.floor(uniform(seed, "hour", *key) * 17).cast("int") * 60 + 300 + F.floor(uniform(seed, "minute", *key) * 12).cast("int") * 5
    km = X.haversine_km(F.col("olat"), F.col("olon"), F.col("dlat"), F.col("dlon"))
    duration = F.least(F.greatest((km / 800 * 60 + 30).cast("int"), F.lit(60)), F.lit(420))
    rows = rows.withColumns({"departure": F.col("day").cast("timestamp_ntz") + F.make_dt_interval(mins=minute), "duration_minutes": duration})
    kind = F.when(F.col("duration_minutes") > 240, weighted(uniform(seed, "aircraft", *key), {"B763": 0.4, "A333": 0.3, "A359": 0.2, "B77W": 0.1})).otherwise(weighted(uniform(seed, "aircraft", *key), {"B738": 0.6, "A321": 0.4}))
    number = F.format_string("F%05d", F.pmod(F.xxhash64(*key), F.lit(100000)))
    return rows.select(number.alias("flight_number"), *key, "departure", (F.col("departure") + F.make_dt_interval(mins=F.col("duration_minutes"))).alias("arrival"), "duration_minutes", kind.alias("aircraft"), F.lit("scheduled").alias("status"))


def delayed(flights: DataFrame, rate: float = 0.15, mean_minutes: float = 30.0, seed: int = 42) -> DataFrame:
    key = ["flight_number", "departure"]
    late = uniform(seed, "late", *key) < rate
    minutes = F.least((-mean_minutes * F.log(uniform(seed, "minutes", *key))).cast("int"), F.lit(240))
    return flights.withColumn("delay_minutes", F.when(late, minutes).otherwise(0)).withColumn("status", F.when(late, "delayed").otherwise(F.col("status")))


def cancelled(flights: DataFrame, rate: float = 0.02, seed: int = 42) -> DataFrame:
    key = ["flight_number", "departure"]
    gone = uniform(seed, "cancel", *key) < rate
    reason = weighted(uniform(seed, "reason", *key), {"weather": 0.4, "mechanical": 0.25, "crew": 0.15, "air traffic": 0.1, "other": 0.1})
    return flights.withColumn("cancellation_reason", F.when(gone, reason)).withColumn("status", F.when(gone, "cancelled").otherwise(F.col("status")))


def fleet(stations: DataFrame, size: int = 5000, seed: int = 42) -> DataFrame:
    """Assets with type, status and station by weight; one in transit has no station."""
    codes = {s[0]: {"hub": 4.0}.get(s[4], 1.5) for s in dims.STATIONS}
    rows = stations.sparkSession.range(size)
    status = {"serviceable": 0.45, "in_use": 0.25, "empty": 0.15, "damaged": 0.05, "out_of_service": 0.03, "in_transit": 0.05, "customs_hold": 0.02}
    rows = rows.select("id", weighted(uniform(seed, "type", "id"), dict(dims.TYPE_MIX)).alias("uld_type"), weighted(uniform(seed, "status", "id"), status).alias("status"), weighted(uniform(seed, "station", "id"), codes).alias("station"))
    rows = rows.withColumn("uld_id", F.concat("uld_type", F.lpad(F.col("id").cast("string"), 5, "0"), F.lit("XX")))
    return rows.withColumn("station", F.when(F.col("status") != "in_transit", F.col("station"))).drop("id")


def position_history(assets: DataFrame, start: Column, moves: int = 20, seed: int = 42) -> DataFrame:
    """A walk of each asset: exponential dwells of 12 h, 72 h at most, and stations by weight. Times are running sums."""
    from pyspark.sql import Window

    codes = {s[0]: {"hub": 4.0}.get(s[4], 1.5) for s in dims.STATIONS}
    rows = assets.select("uld_id").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(moves - 1))))
    hours = F.least(-12.0 * F.log(uniform(seed, "dwell", "uld_id", "step")), F.lit(72.0))
    by = Window.partitionBy("uld_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("hours", hours).withColumn("after", F.coalesce(F.sum("hours").over(by), F.lit(0.0)))
    at = start + F.make_dt_interval(secs=(F.col("after") * 3600).cast("decimal(18,6)"))
    return rows.select("uld_id", "step", weighted(uniform(seed, "where", "uld_id", "step"), codes).alias("station"), at.alias("ts"))


def demand_series(stations: DataFrame, start: date, days: int, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """Daily demand by station: base by tier, season, weekday and the days around fixed holidays, with optional lognormal noise."""
    week = F.array(*[F.lit(v) for v in (1.0, 1.05, 1.0, 0.95, 1.1, 0.85, 0.8)])
    rows = days_of(stations.select(F.col("code").alias("station"), "tier"), start, days)
    base = dims.lookup(dims.DAILY_DEMAND, F.col("tier"), 15.0)
    md = F.month("day") * 100 + F.dayofmonth("day")
    eve = F.month(F.date_add("day", 1)) * 100 + F.dayofmonth(F.date_add("day", 1))
    #: Month and day of the generator's own holidays. Fixed values.
    fixed = (101, 115, 219, 527, 704, 902, 1014, 1111, 1128, 1225)
    holiday = F.when(md.isin(*fixed), 1.25).when(eve.isin(*fixed), 1.15).otherwise(1.0)
    point = base * X.annual_factor(F.dayofyear("day")) * F.element_at(week, F.weekday("day") + 1) * holiday
    point = point * F.exp(noise * normal(seed, "noise", "station", "day")) if noise else point
    rows = rows.withColumn("demand", F.greatest(point, F.lit(0.0)))
    rows = rows.withColumn("b", X.band(F.col("demand"), F.greatest(F.lit(1.0), 0.15 * F.col("demand")), whole=True))
    return rows.select("station", "day", "demand", F.col("b.q05").alias("q05"), F.col("b.q50").alias("q50"), F.col("b.q95").alias("q95"), X.forecast_confidence(F.col("b")).alias("confidence"))


def with_actuals(forecasts: DataFrame, seed: int = 42) -> DataFrame:
    sigma = (F.col("q95") - F.col("q05")) / (2 * X.Z90)
    return forecasts.withColumn("actual", F.greatest(F.lit(0), (F.col("q50") + sigma * normal(seed, "actual", "station", "day")).cast("int")))


def with_anomalies(forecasts: DataFrame, rate: float = 0.05, seed: int = 42) -> DataFrame:
    hit = uniform(seed, "anomaly", "station", "day") < rate
    factor = F.element_at(F.array(F.lit(0.3), F.lit(2.0), F.lit(2.5)), (F.floor(uniform(seed, "factor", "station", "day") * 3) + 1).cast("int"))
    rows = forecasts.withColumn("factor", F.when(hit, factor).otherwise(1.0))
    return rows.withColumns({"q50": F.col("q50") * F.col("factor"), "is_anomaly": F.col("factor") != 1.0, "anomaly_score": F.abs(F.col("factor") - 1), "confidence": F.when(F.col("factor") != 1.0, "low").otherwise(F.col("confidence"))}).drop("factor")


def seasonal_start(year: int, season: str, seed: int, *keys: Column | str) -> Column:
    """An hour of a winter (December to February of the next year) or summer month, on days 1 to 28."""
    draw = lambda tag, n: F.floor(uniform(seed, "season/" + tag, *keys) * n).cast("int")
    months = F.array(*[F.lit(m) for m in {"winter": (12, 1, 2), "summer": (6, 7, 8)}[season]])
    month = F.element_at(months, draw("month", 3) + 1)
    of = F.when(month < 3, year + 1).otherwise(year)
    return F.make_timestamp_ntz(of, month, draw("day", 28) + 1, draw("hour", 24), F.lit(0), F.lit(0))


def after(start: Column, hours: Column) -> Column:
    return start + F.make_dt_interval(secs=F.round(hours * 3600, 3))


def scenarios(stations: DataFrame, count: int, start: Column, seed: int = 42) -> DataFrame:
    """Random disruptions by the shares of their kinds, at stations weighed by tier: severity, hours, impact factor, flights and units affected."""
    tiers = {s[0]: dims.SCENARIO_TIERS[s[4]] for s in dims.STATIONS}
    rows = stations.sparkSession.range(count).withColumns({
        "kind": weighted(uniform(seed, "kind", "id"), dims.SCENARIO_SHARES), "severity": 0.3 + 0.7 * uniform(seed, "severity", "id"), "station": weighted(uniform(seed, "place", "id"), tiers),
    })
    hours = dims.lookup({k: v[0] for k, v in dims.SCENARIOS.items()}, F.col("kind"), 12)
    base = dims.lookup({k: v[1] for k, v in dims.SCENARIOS.items()}, F.col("kind"), 1.0)
    word = F.when(F.col("severity") > 0.7, "Severe").when(F.col("severity") > 0.4, "Moderate").otherwise("Minor")
    begin = start + F.make_dt_interval(hours=F.floor(uniform(seed, "when", "id") * 24 * 90).cast("int"))
    text = F.concat_ws(" ", word, F.replace("kind", F.lit("_"), F.lit(" ")), F.lit("at"), "station")
    rows = rows.withColumns({"start": begin, "hours": hours, "impact": X.scenario_impact(base, F.col("severity")), "description": text})
    part = lambda a_h: (F.col("hours") * a_h * F.col("severity")).cast("int")
    end = after(F.col("start"), F.col("hours").cast("double")).alias("end")
    return rows.select(F.format_string("SCN-%05d", F.col("id") + 1).alias("scenario_id"), "kind", "station", "severity", "start", end, "impact", "description", part(5).alias("flights"), part(40).alias("units"))


def regional_scenarios(spark, preset: str, count: int, year: int, severity: float | None = None, seed: int = 42) -> DataFrame:
    """Events of `count` winter storms, summer thunderstorms or demand spikes, one row for each station that one strikes."""
    p = dims.REGIONAL[preset]
    rows = spark.range(count).withColumn("station", F.explode(F.array(*[F.lit(s) for s in p["stations"]])))
    draw = lambda tag, lo, hi, *keys: lo + (hi - lo) * uniform(seed, preset + tag, *keys)
    if p["season"] is None:
        start = F.make_timestamp_ntz(F.lit(year), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(days=F.floor(draw("/when", 0.0, 90.0, "id")).cast("int"))
    else:
        start = seasonal_start(year, p["season"], seed, "id")
    if p["hour"] is not None:
        start = F.date_trunc("day", start).cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(p["hour"]))
    own = (p["severity"] if severity is None else severity) * draw("/strength", p["least"], 1.0, "id", "station")
    rows = rows.withColumns({"hours": draw("/hours", *p["hours"], "id", "station"), "severity": own, "start": after(start, draw("/lag", 0.0, p["lag"], "id", "station"))})
    scale = F.col("hours") * (F.col("severity") if p["by_severity"] else F.lit(1.0))
    return rows.select(
        F.format_string("SCN-%05d", F.col("id") + 1).alias("scenario_id"), F.lit(p["kind"]).alias("kind"), "station", "severity", "start", after(F.col("start"), F.col("hours")).alias("end"), F.lit(p["impact"]).alias("impact"),
        F.concat(F.lit(p["text"] + " at "), "station").alias("description"), (scale * p["flights"]).cast("int").alias("flights"), (scale * p["units"]).cast("int").alias("units"),
    )


def scenario_totals(events: DataFrame) -> DataFrame:
    """Per scenario: its first start, last end, stations, flights and units of its events."""
    return events.groupBy("scenario_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count_distinct("station").alias("stations"), F.sum("flights").alias("flights"), F.sum("units").alias("units"))
