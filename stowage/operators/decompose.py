"""Decomposition of all series into a trend that breaks, seasons and regressors, with intervals from their residuals.

Columns are 1, time, a hinge at each candidate break, and sines and cosines of the seasons. The normal equations of every
series come from one pass: tasks sum products of rows by series, the sums combine by series and place, and each series
solves its own small system. Hinges are shrunk, so that the trend breaks only where the data ask for it.

Defined results: rows with a null key, day or value are left out; a series of one day has its value as level; times are
scaled by a series' first and last day, later days go on with the last slope.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions.bounds import small
from stowage.operators.selection import quantiles

#: (days, harmonics) of the seasons.
SEASONS = ((7.0, 3), (365.25, 4))


def design(t: np.ndarray, day: np.ndarray, breaks: np.ndarray, seasons: Sequence[tuple[float, int]]) -> np.ndarray:
    """A row for each time (0 to 1 within the fit) and day number."""
    waves = [f(2 * np.pi * k * day / days) for days, n in seasons for k in range(1, n + 1) for f in (np.sin, np.cos)]
    return np.column_stack([np.ones(len(t)), t, np.maximum(0.0, t[:, None] - breaks[None]), *waves])


def break_places(n: int, upto: float = 0.9) -> np.ndarray:
    """Candidate breaks, evenly spread over the first part of a series."""
    return np.linspace(0, upto, n + 2)[1:-1]


def fit(series: DataFrame, key: str, day: str, y: str, *, breaks: int = 12, seasons: Sequence[tuple[float, int]] = SEASONS, shrink: float = 0.5) -> DataFrame:
    """(key, first, last, n, weights array): the weights of each series' columns; first and last are day numbers since 1970."""
    at, names = break_places(breaks), ["key", "day", "y"]
    rows = series.filter(F.col(key).isNotNull() & F.col(day).isNotNull() & F.col(y).isNotNull())
    rows = rows.select(F.col(key).alias("key"), F.unix_date(F.to_date(day)).alias("day"), F.col(y).cast("double").alias("y"))
    spans = rows.groupBy("key").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count(F.lit(1)).alias("n"))
    p = 2 + breaks + 2 * sum(n for _, n in seasons)
    ridge = np.full(p, 1e-6)
    ridge[2 : 2 + breaks] = shrink

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, own in f.groupby("key", sort=False):
                first, last = own["first"].iloc[0], own["last"].iloc[0]
                x = design((own["day"].to_numpy() - first) / max(1, last - first), own["day"].to_numpy(dtype=float), at, seasons)
                both = np.column_stack([x, own["y"].to_numpy()])
                out.append((k, (both.T @ both).reshape(-1)))
            yield pd.DataFrame({"key": [k for k, _ in out], "g": [g for _, g in out]})

    kind = rows.schema["key"].dataType.simpleString()
    placed = rows.select(*names).join(small(spans.drop("n")), "key")
    parts = placed.mapInPandas(products, f"key {kind}, g array<double>").select("key", F.posexplode("g").alias("i", "v"))
    sums = parts.groupBy("key", "i").agg(F.sum("v").alias("v")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("g"))  # (p + 1) ** 2 numbers a series

    @F.pandas_udf("array<double>")
    def solved(g: pd.Series) -> pd.Series:
        out = []
        for flat in g:
            m = np.asarray(flat, dtype=float).reshape(p + 1, p + 1)
            out.append(np.linalg.solve(m[:p, :p] + np.diag(ridge), m[:p, p]))
        return pd.Series(out)

    weights = sums.select("key", solved(F.transform("g", lambda s: s["v"])).alias("weights"))
    return spans.join(weights, "key").select(F.col("key").alias(key), "first", "last", "n", "weights")


def components(days: DataFrame, models: DataFrame, key: str, day: str, *, breaks: int = 12, seasons: Sequence[tuple[float, int]] = SEASONS) -> DataFrame:
    """days with trend, season and yhat of their series' model; days of a series without a model are left out."""
    at = break_places(breaks)

    @F.pandas_udf("trend double, season double")
    def parts(d: pd.Series, first: pd.Series, last: pd.Series, weights: pd.Series) -> pd.DataFrame:
        if not len(d):
            return pd.DataFrame({"trend": [], "season": []})
        t = (d - first) / np.maximum(1, last - first)
        x, w = design(t.to_numpy(dtype=float), d.to_numpy(dtype=float), at, seasons), np.stack(weights.to_numpy())
        both = x * w
        return pd.DataFrame({"trend": both[:, : 2 + breaks].sum(1), "season": both[:, 2 + breaks :].sum(1)})

    m = models.select(F.col(key).alias("_k"), "first", "last", "weights")
    rows = days.join(m, F.col(key) == F.col("_k")).withColumn("_p", parts(F.unix_date(F.to_date(day)), "first", "last", "weights"))
    return rows.withColumns({"trend": F.col("_p.trend"), "season": F.col("_p.season"), "yhat": F.col("_p.trend") + F.col("_p.season")}).drop("_k", "_p", "first", "last", "weights")


def slope_changes(models: DataFrame, key: str, *, breaks: int = 12) -> DataFrame:
    """(key, day, change): the change of slope a day at each candidate break."""
    at = F.array(*[F.lit(float(b)) for b in break_places(breaks)])
    span = F.greatest(F.lit(1), F.col("last") - F.col("first"))
    rows = models.select(key, "first", span.alias("span"), F.posexplode(at).alias("i", "place"), "weights")
    return rows.select(key, F.date_from_unix_date((F.col("first") + F.round(F.col("place") * F.col("span"))).cast("int")).alias("day"), (F.element_at("weights", F.col("i") + 3) / F.col("span")).alias("change"))


def residual_band(fitted: DataFrame, key: str, y: str, width: float = 0.8) -> DataFrame:
    """(key, low, high): what is added to yhat so that the middle `width` of the residuals lie between."""
    left = F.col(y) - F.col("yhat")
    low = quantiles(fitted, [key], left, (1 - width) / 2).withColumnRenamed("q", "low")
    return low.join(quantiles(fitted, [key], left, (1 + width) / 2).withColumnRenamed("q", "high"), key)
