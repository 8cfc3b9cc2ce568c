"""Exact order statistics of keys of any size: brackets are narrowed by histograms until few values are left in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.bounds import small
from stowage.functions.shared import cut


def bin_of(s: Column, a: Column, b: Column, bins: int) -> Column:
    """The bin of s in [a, b], rising with s; a lies in the first and b in the last. Endless brackets split off their ends."""
    finite = F.floor((s / 2 - a / 2) / (b / 2 - a / 2) * bins)
    endless = F.when(s == a, 0).when(s == b, bins - 1).otherwise(1)
    return F.when((a == float("-inf")) | (b == float("inf")), endless).otherwise(F.least(finite, F.lit(bins - 1))).cast("int")


def values_at(scores: DataFrame, keys: list[str], score: Column, place: Callable[[Column], Column], *, bins: int = 1024, few: int = 4096) -> DataFrame:
    """(keys, n, place, a, b) of each key: the n scores' values at rank floor(place(n)), from 0, and at the next rank (null past the end).

    Each round counts the values of every open bracket by bin, which combines before its shuffle, and goes on with the
    bin that holds the rank, between the least and greatest value that it has. A bracket of one value is settled; one
    of at most `few` values is sorted. Rounds grow with the logarithm of the range over the gaps; keys of few values take none.
    Null and NaN scores take no part; a key without scores is left out; null keys are a key.
    """
    rows = scores.select(F.struct(F.lit(0).alias("_all"), *keys).alias("_key"), score.cast("double").alias("_s"))
    rows = cut(rows.filter(F.col("_s").isNotNull() & ~F.isnan("_s")))
    sizes = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.min("_s").alias("a"), F.max("_s").alias("b"))
    sizes = cut(sizes.withColumn("place", place(F.col("n")).cast("double")))
    which = F.explode(F.filter(F.array(F.lit(0), F.lit(1)), lambda w: F.floor("place") + w < F.col("n")))
    state = sizes.select("_key", which.alias("which"), "n", "place", "a", "b").select("_key", "which", (F.floor("place") + F.col("which")).alias("r"), F.col("n").alias("m"), "a", "b")
    is_open = (F.col("m") > few) & (F.col("a") < F.col("b"))
    while not (wide := state.filter(is_open)).isEmpty():
        inside = rows.join(small(wide), "_key").filter(F.col("_s").between(F.col("a"), F.col("b")))
        counted = inside.groupBy("_key", "which", "r", bin_of(F.col("_s"), F.col("a"), F.col("b"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("m"), F.min("_s").alias("a"), F.max("_s").alias("b"))
        upto = F.sum("m").over(Window.partitionBy("_key", "which").orderBy("bin"))  # over at most `bins` rows
        chosen = counted.withColumn("upto", upto).filter((F.col("upto") > F.col("r")) & (F.col("upto") - F.col("m") <= F.col("r")))
        chosen = chosen.select("_key", "which", (F.col("r") - (F.col("upto") - F.col("m"))).alias("r"), "m", "a", "b")
        state = cut(state.filter(~is_open).unionByName(chosen))
    settled = state.filter("a = b").select("_key", "which", F.col("a").alias("v"))
    left = state.filter("a < b")
    order = F.row_number().over(Window.partitionBy("_key", "which").orderBy("_s")) - 1  # over at most `few` rows
    sorted_out = rows.join(small(left), "_key").filter(F.col("_s").between(F.col("a"), F.col("b"))).withColumn("at", order).filter("at = r").select("_key", "which", F.col("_s").alias("v"))
    both = settled.unionByName(sorted_out).groupBy("_key").agg(F.max(F.when(F.col("which") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("which") == 1, F.col("v"))).alias("b"))
    return sizes.select("_key", "n", "place").join(both, "_key").select(*[F.col("_key")[k].alias(k) for k in keys], "n", "place", "a", "b")


def quantiles(scores: DataFrame, keys: list[str], score: Column, level: Callable[[Column], Column] | float, **options: int) -> DataFrame:
    """(keys, q): the linear quantile of each key's scores at a level, which may follow from their number."""
    at = level if callable(level) else lambda n: F.lit(float(level))
    found = values_at(scores, keys, score, lambda n: (n - 1) * at(n), **options)
    part = F.col("place") - F.floor("place")
    return found.select(*keys, (F.col("a") + part * (F.coalesce("b", "a") - F.col("a"))).alias("q"))
