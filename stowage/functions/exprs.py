"""Scalar formulas as Catalyst expressions; nothing here leaves the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Hart's rational approximation as published by G. West (2005), highest power first. Fixed values.
CDF_NUM = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_DEN = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
#: Normal quantile multipliers of the 5/95 and 25/75 bands, and the IQR's. Fixed values.
Z90, Z50, IQR_SIGMA = 1.645, 0.675, 1.35


def horner(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + F.lit(float(c))
    return out


def norm_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def norm_cdf(z: Column) -> Column:
    """Standard normal distribution, to about 1e-16."""
    a = F.abs(z)
    e = F.exp(-a * a / 2)
    b = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        b = a + k / b
    tail = F.when(a < 7.07106781186547, e * horner(CDF_NUM, a) / horner(CDF_DEN, a)).when(a <= 37, e / b / 2.506628274631).otherwise(0.0)
    return F.when(z > 0, 1 - tail).otherwise(tail)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def flat_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt(F.pow(lat1 - lat2, 2) + F.pow(lon1 - lon2, 2)) * 111.0


def decay(distance: Column, sigma: float = 50.0) -> Column:
    return F.exp(-distance / sigma)


def band(point: Column, sigma: Column, clamp: bool = True, whole: bool = False) -> Column:
    """struct(q05, q25, q50, q75, q95) around point; clamp keeps the lower quantiles at 0, whole cuts to integers."""
    def q(z: float) -> Column:
        v = point + z * sigma
        v = F.greatest(v, F.lit(0.0)) if clamp and z < 0 else v
        return v.cast("int").cast("double") if whole else v

    return F.struct(*[q(z).alias(n) for z, n in ((-Z90, "q05"), (-Z50, "q25"), (0.0, "q50"), (Z50, "q75"), (Z90, "q95"))])


def band_width(b: Column) -> Column:
    return b["q95"] - b["q05"]


def iqr(b: Column) -> Column:
    return b["q75"] - b["q25"]


def high_uncertainty(b: Column) -> Column:
    return band_width(b) > 0.5 * b["q50"]


def severity(p: Column) -> Column:
    return F.when(p > 0.8, "critical").when(p > 0.5, "warning").otherwise("normal")


def priority(p: Column) -> Column:
    return F.when(p >= 0.8, "critical").when(p >= 0.5, "high").when(p >= 0.3, "medium").otherwise("low")


def priority_rank(p: Column) -> Column:
    return F.when(p == "critical", 0).when(p == "high", 1).when(p == "medium", 2).otherwise(3)


def hour_factor(hour: Column) -> Column:
    return F.when(hour.between(6, 10), 1.3).when(hour.between(11, 14), 1.0).when(hour.between(15, 20), 1.2).otherwise(0.5)


def weekend_factor(day: Column) -> Column:
    return F.when(F.weekday(day) >= 5, 0.85).otherwise(1.0)


def calendar(day: Column) -> dict[str, Column]:
    d = day.cast("date")
    return {
        "day_of_week": F.weekday(d), "day_of_month": F.dayofmonth(d), "week_of_year": F.weekofyear(d), "month": F.month(d), "quarter": F.quarter(d), "year": F.year(d),
        "is_weekend": (F.weekday(d) >= 5).cast("int"), "is_month_start": (F.dayofmonth(d) == 1).cast("int"), "is_month_end": (d == F.last_day(d)).cast("int"),
    }


def cyclical(day: Column) -> dict[str, Column]:
    d, out = day.cast("date"), {}
    for name, value, period in (("dow", F.weekday(d), 7.0), ("month", F.month(d), 12.0), ("doy", F.dayofyear(d), 365.25)):
        angle = 2 * math.pi * value / period
        out |= {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}
    return out


def fourier(day: Column, weekly: int = 2, annual: int = 3) -> dict[str, Column]:
    """Weekly terms of the weekday and annual terms of the day of the year."""
    d, out = day.cast("date"), {}
    for name, t, period, count in (("weekly", F.weekday(d), 7.0, weekly), ("annual", F.dayofyear(d), 365.25, annual)):
        for k in range(1, count + 1):
            angle = 2 * math.pi * k * t / period
            out |= {f"{name}_sin_{k}": F.sin(angle), f"{name}_cos_{k}": F.cos(angle)}
    return out


def weather_severity(is_ifr: Column, is_sigmet: Column, wind: Column, threshold: float = 25.0) -> Column:
    return 3.0 * is_ifr.cast("double") + 2.0 * is_sigmet.cast("double") + F.least(wind / threshold, F.lit(2.0))


def annual_factor(day_of_year: Column) -> Column:
    return 1 + 0.15 * F.sin(2 * math.pi * (day_of_year - 172) / 365)


def day_curve(hour: Column) -> Column:
    return F.when(hour.between(6, 22), 0.7 + 0.6 * F.sin(math.pi * (hour - 6) / 12)).otherwise(0.3)


def scenario_impact(base: Column, strength: Column) -> Column:
    return F.when(base < 1, base + (1 - base) * (1 - strength)).otherwise(1 + (base - 1) * strength)


def forecast_confidence(b: Column) -> Column:
    cv = F.try_divide(iqr(b) / IQR_SIGMA, b["q50"])
    return F.when(cv < 0.1, "high").when(cv < 0.25, "medium").otherwise("low")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def similarity(a: Column, b: Column, kernel: str = "rbf", bandwidth: float = 1.0) -> Column:
    if kernel == "rbf":
        d = euclidean(a, b)
        return F.exp(-d * d / (2 * bandwidth * bandwidth))
    if kernel == "cosine":
        return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
    if kernel == "euclidean":
        return 1 / (1 + euclidean(a, b))
    raise ValueError(f"unknown kernel: {kernel}")


def pinball(y: Column, forecast: Column, level: float) -> Column:
    r = y - forecast
    return F.when(r >= 0, level * r).otherwise((level - 1) * r)


def interval_score(y: Column, lower: Column, upper: Column, alpha: float = 0.1) -> Column:
    zero = F.lit(0.0)
    return upper - lower + 2 / alpha * F.greatest(lower - y, zero) + 2 / alpha * F.greatest(y - upper, zero)


def crps_gaussian(y: Column, mu: Column, sigma: Column) -> Column:
    z = (y - mu) / sigma
    return sigma * (z * (2 * norm_cdf(z) - 1) + 2 * norm_pdf(z) - 1 / math.sqrt(math.pi))


def crps_samples(y: Column, samples: Column) -> Column:
    """Fair empirical CRPS: mean |x - y| less half the mean distance of pairs, from one sort."""
    n = F.size(samples)
    s = F.array_sort(samples)
    near = F.aggregate(s, F.lit(0.0), lambda a, x: a + F.abs(x - y)) / n
    ranked = F.zip_with(s, F.sequence(F.lit(1), n), lambda x, i: (2 * i - n - 1) * x)
    pairs = 2 * F.aggregate(ranked, F.lit(0.0), lambda a, x: a + x) / (n * (n - 1))
    return F.when(n > 1, near - pairs / 2).when(n == 1, near)


def interpolated(ordered: Column, level: Column) -> Column:
    """The linearly interpolated quantile of an ascending array."""
    p = (F.size(ordered) - 1) * level
    lo = F.floor(p).cast("int")
    low = F.element_at(ordered, lo + 1)
    return low + (p - lo) * (F.element_at(ordered, F.least(lo + 2, F.size(ordered))) - low)


def urgency_hours(required_by: Column, as_of: Column) -> Column:
    """Hours from as_of to a deadline, negative once it has passed."""
    return (F.unix_micros(required_by.cast("timestamp")) - F.unix_micros(as_of.cast("timestamp"))) / 3.6e9


#: South, north, west and east end of the map; width, height, left and top of its continental part; share of width that narrows with latitude. Fixed values.
MAP_BOUNDS, MAP_BOX, MAP_NARROW = (24.5, 49.5, -125.0, -66.0), (920.0, 550.0, 250.0, 100.0), (0.85, 0.15)


def map_point(latitude: Column, longitude: Column) -> Column:
    """Struct of x and y on the map of stations: linear in both, narrower to the north."""
    (south, north, west, east), (width, height, left, top), (narrow, rest) = MAP_BOUNDS, MAP_BOX, MAP_NARROW
    x = left + (longitude - west) / (east - west) * width * (F.cos(F.radians(latitude)) * narrow + rest)
    y = top + (1 - (latitude - south) / (north - south)) * height
    return F.struct(x.alias("x"), y.alias("y"))


def number_text(v: Column) -> Column:
    """1234.5678 as 1,234.568: up to three decimals."""
    return F.call_function("format_number", v, F.lit("#,##0.###"))


def percent_text(v: Column) -> Column:
    """0.123 as 12.3%."""
    return F.format_string("%.1f%%", v * 100)


def date_text(at: Column) -> Column:
    """Jan 5, 02:30 PM."""
    return F.date_format(at, "MMM d, hh:mm a")


def register(spark: SparkSession) -> None:
    """SQL names for the formulas that SQL users reach for."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION haversine_km(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN "
        "2 * 6371.0D * asin(sqrt(least(1.0D, pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2))))"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION pinball(y DOUBLE, f DOUBLE, q DOUBLE) RETURNS DOUBLE RETURN CASE WHEN y >= f THEN q * (y - f) ELSE (q - 1) * (y - f) END")
    num = " + ".join(f"{c!r}D * pow(a, {len(CDF_NUM) - 1 - i})" for i, c in enumerate(CDF_NUM))
    den = " + ".join(f"{c!r}D * pow(a, {len(CDF_DEN) - 1 - i})" for i, c in enumerate(CDF_DEN))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION norm_tail(a DOUBLE) RETURNS DOUBLE RETURN CASE WHEN a < 7.07 THEN exp(-a * a / 2) * ({num}) / ({den}) ELSE 0.0D END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION norm_cdf(z DOUBLE) RETURNS DOUBLE RETURN CASE WHEN z > 0 THEN 1 - norm_tail(z) ELSE norm_tail(-z) END")
