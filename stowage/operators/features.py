"""Features of daily series: (key, day, value) and what calendars, events and neighbours add."""

from __future__ import annotations

import math

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions import exprs as X
from stowage.functions.bounds import small
from stowage.plans import dims

LAGS = (1, 2, 3, 7, 14, 21, 28, 364, 365, 371)
WINDOWS = (7, 14, 28)
SPANS = (7, 28)


def lags(series: DataFrame, key: str, day: str, value: str, by: tuple[int, ...] = LAGS) -> DataFrame:
    w = Window.partitionBy(key).orderBy(day)
    return series.withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in by})


def rolling(series: DataFrame, key: str, day: str, value: str, widths: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Mean, sample deviation, minimum, maximum and their ratio over the last rows, the current one included."""
    out = {}
    for k in widths:
        w = Window.partitionBy(key).orderBy(day).rowsBetween(-(k - 1), 0)
        out |= {f"mean_{k}": F.avg(value).over(w), f"std_{k}": F.stddev_samp(value).over(w), f"min_{k}": F.min(value).over(w), f"max_{k}": F.max(value).over(w)}
    rows = series.withColumns(out)
    return rows.withColumns({f"cv_{k}": F.coalesce(F.try_divide(F.col(f"std_{k}"), F.col(f"mean_{k}")), F.lit(0.0)) for k in widths})


def ewma(series: DataFrame, key: str, day: str, value: str, spans: tuple[int, ...] = SPANS) -> DataFrame:
    """Adjusted exponentially weighted means over each row's whole past; a null value has no weight.

    A sum of x * w**(t - i) is w**t times a running sum of x * w**-i, which would overflow on a long series. So rows lie
    in blocks in which w**-i stays below 1e100, and a block adds what the one before it ended with; from two blocks before
    comes less than 1e-100 of that.
    """
    order = Window.partitionBy(key).orderBy(day)
    rows = series.withColumn("_i", F.row_number().over(order) - 1)
    for span in spans:
        keep = 1 - 2 / (span + 1)
        if not keep:
            rows = rows.withColumn(f"ewm_{span}", F.col(value).cast("double"))
            continue
        size = int(-230 / math.log(keep))
        place = F.col("_i") % size
        rows = rows.withColumn("_b", F.floor(F.col("_i") / size))
        inside = Window.partitionBy(key, "_b").orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
        for name, x in (("_n", F.col(value).cast("double")), ("_d", F.when(F.col(value).isNotNull(), 1.0))):
            rows = rows.withColumn(name, F.coalesce(F.sum(x * F.pow(F.lit(keep), -place)).over(inside), F.lit(0.0)) * F.pow(F.lit(keep), place))
        before = lambda c: F.coalesce(F.last(F.when(place == size - 1, F.col(c)), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        both = [F.col(c) + before(c) * F.pow(F.lit(keep), place + 1) for c in ("_n", "_d")]
        rows = rows.withColumn(f"ewm_{span}", F.try_divide(*both)).drop("_b", "_n", "_d")
    return rows.drop("_i")


def calendar(series: DataFrame, day: str) -> DataFrame:
    return series.withColumns({**X.calendar(F.col(day)), **X.cyclical(F.col(day)), **X.fourier(F.col(day))})


def holiday_distance(days: DataFrame, day: str, holidays: list[date], default: int = 365) -> DataFrame:
    """is_holiday, is_holiday_eve, days to the next and from the last holiday, both inclusive.

    The holidays of a date range are some dozen a year: an as-of join by binary place in one sorted literal array.
    """
    base = date(1970, 1, 1)
    numbers = F.array(*[F.lit((h - base).days) for h in holidays]) if holidays else F.array().cast("array<int>")
    n = F.unix_date(F.col(day).cast("date"))
    rows = days.withColumns({"_h": numbers, "_n": n})
    ahead = F.array_min(F.filter("_h", lambda h: h >= F.col("_n")))
    behind = F.array_max(F.filter("_h", lambda h: h <= F.col("_n")))
    out = rows.withColumns({
        "is_holiday": F.array_contains("_h", F.col("_n")).cast("int"), "is_holiday_eve": F.array_contains("_h", F.col("_n") + 1).cast("int"),
        "days_to_holiday": F.coalesce(ahead - F.col("_n"), F.lit(default)), "days_from_holiday": F.coalesce(F.col("_n") - behind, F.lit(default)),
    })
    return out.drop("_h", "_n")


def pipeline(series: DataFrame, key: str, day: str, value: str | None, holidays: list[date]) -> DataFrame:
    """Calendar, lags and rolling statistics (only with a value) and holidays, in this order."""
    rows = calendar(series, day)
    if value is not None:
        rows = ewma(rolling(lags(rows, key, day, value), key, day, value), key, day, value)
    return holiday_distance(rows, day, holidays)


def event_impact(events: DataFrame, stations: DataFrame, sigma: float = 50.0) -> DataFrame:
    """log1p(sum of attendance * weight * exp(-km / sigma) / 1000) per station; stations are a bounded dimension."""
    km = X.flat_km(F.col("e_lat"), F.col("e_lon"), F.col("lat"), F.col("lon"))
    weight = dims.lookup(dims.EVENT_WEIGHTS, F.col("category"), 0.5)
    rows = events.crossJoin(small(stations)).withColumn("part", F.col("attendance") * weight * X.decay(km, sigma))
    return rows.groupBy("station").agg(F.log1p(F.sum("part") / 1000.0).alias("impact"), F.count(F.lit(1)).alias("events"))


def hub_pressure(edges: DataFrame, stats: DataFrame) -> DataFrame:
    """Mean z-score of the demand of each station's hubs, from (station, hub) and (hub, demand, baseline, std)."""
    z = (F.col("demand") - F.col("baseline")) / F.greatest(F.col("std"), F.lit(1e-6))
    return edges.join(stats, "hub").groupBy("station").agg(F.avg(z).alias("pressure"), F.count(F.lit(1)).alias("hubs"))


def flow_imbalance(flows: DataFrame) -> DataFrame:
    """Inflow, outflow and net of every node, from (origin, destination, units); a missing side counts 0."""
    ends = F.explode(F.array(F.struct(F.col("destination").alias("node"), F.col("units").alias("i"), F.lit(0).cast("double").alias("o")), F.struct(F.col("origin").alias("node"), F.lit(0).cast("double").alias("i"), F.col("units").alias("o"))))
    rows = flows.withColumn("units", F.col("units").cast("double")).select(ends.alias("e"))
    return rows.groupBy(F.col("e.node").alias("node")).agg(F.sum("e.i").alias("inflow"), F.sum("e.o").alias("outflow")).withColumn("net", F.col("inflow") - F.col("outflow"))


def is_travel_period(day: Column, ranges: tuple[tuple[int, int], ...] = ((1120, 1130), (1220, 105), (701, 707))) -> Column:
    """Whether month * 100 + day lies in a range; a range may cross the year's end."""
    md = F.month(day) * 100 + F.dayofmonth(day)
    out = F.lit(False)
    for a, b in ranges:
        out = out | (md.between(a, b) if a <= b else (md >= a) | (md <= b))
    return out
