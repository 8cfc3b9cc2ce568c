"""Lag selection by conditional mutual information: what a lag tells of a series beyond the lags already chosen.

Values are binned by each series' own quantiles. A step counts value, candidate and chosen lags together, for all
candidates of all series in one aggregate; gains are sums over those counts, and the lag that adds most is chosen.

Defined results: rows with a null are left out; steps follow each other by order, gaps are no steps; of equal gains (to 12 digits) the
shortest lag is chosen; a series of too few rows has no lags.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.bounds import small
from stowage.functions.shared import cut
from stowage.operators.selection import values_at


def binned_lags(series: DataFrame, key: str, order: str, y: str, lags: Sequence[int], bins: int) -> DataFrame:
    """(key, b, lagged array): each row's bin from 0, and those of its lags; rows without all lags are left out.

    A bin's edges are the values at rank floor((n - 1) * k / bins); bins count the edges below a value.
    """
    rows = series.filter(F.col(key).isNotNull() & F.col(y).isNotNull() & F.col(order).isNotNull())
    edges = None
    for k in range(1, bins):
        own = values_at(rows, [key], F.col(y), lambda n, k=k: F.floor((n - 1) * k / bins)).select(key, F.col("a").alias(f"e{k}"))
        edges = own if edges is None else edges.join(own, key)
    place = sum(((F.col(y) > F.col(f"e{k}")).cast("int") for k in range(1, bins)), F.lit(0))
    rows = rows.join(small(edges), key).select(key, order, place.alias("b"))
    w = Window.partitionBy(key).orderBy(order)
    rows = rows.select(key, "b", F.array(*[F.lag("b", n).over(w) for n in lags]).alias("lagged"))
    return rows.filter(~F.exists("lagged", lambda v: v.isNull()))


def gains(rows: DataFrame, key: str, lags: Sequence[int]) -> DataFrame:
    """(key, lag, gain): the conditional mutual information, in nats, of value and lag given z, from rows (key, b, lagged, z)."""
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in lags]).alias("lag"), F.col("lagged").alias("x"))
    counts = rows.select(key, "b", "z", F.explode(pairs).alias("p")).select(key, "b", "z", "p.lag", "p.x").groupBy(key, "lag", "z", "b", "x").agg(F.count(F.lit(1)).cast("double").alias("n"))
    over = lambda *c: F.sum("n").over(Window.partitionBy(key, "lag", *c))  # noqa: E731, of at most bins ** (chosen + 2) counts
    term = F.col("n") / over() * F.log(F.col("n") * over("z") / (over("z", "x") * over("z", "b")))
    return counts.withColumn("term", term).groupBy(key, "lag").agg(F.greatest(F.lit(0.0), F.sum("term")).alias("gain"))


def select_lags(series: DataFrame, key: str, order: str, y: str, lags: Sequence[int], *, choose: int = 3, bins: int = 4) -> DataFrame:
    """(key, step from 1, lag, gain): greedily, the lag of greatest gain given those chosen before it."""
    rows = cut(binned_lags(series, key, order, y, lags, bins).withColumn("z", F.lit(0)))
    out, every = None, F.array(*[F.lit(n) for n in lags])
    taken = None
    for step in range(1, min(choose, len(lags)) + 1):
        found = gains(rows, key, lags)
        if taken is not None:
            found = found.join(taken, [key, "lag"], "left_anti")
        top = cut(found.groupBy(key).agg(F.max(F.struct(F.round("gain", 12).alias("g"), (-F.col("lag")).alias("lag"), "gain")).alias("t")).select(key, F.lit(step).alias("step"), (-F.col("t.lag")).alias("lag"), "t.gain"))
        out = top if out is None else out.unionByName(top)
        taken = top.select(key, "lag") if taken is None else taken.unionByName(top.select(key, "lag"))
        chosen = F.element_at("lagged", F.array_position(every, F.col("lag")).cast("int"))
        rows = cut(rows.join(small(top.select(key, "lag")), key).select(key, "b", "lagged", (F.col("z") * bins + chosen).alias("z")))
    return out
