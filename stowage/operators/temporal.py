"""Temporal hierarchies: forecasts of days, weeks and longer blocks of every series agree, by least squares in closed form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reconcile_temporal(days: DataFrame, blocks: Sequence[tuple[int, DataFrame]], *, key: str = "k", step: str = "step", value: str = "yhat", method: str = "ols") -> DataFrame:
    """(key, size, block, value) of all levels, size 1 being the days themselves, such that each block is the sum of its parts.

    days (key, step from 0, value); blocks: (size, forecasts (key, block, value)) from the shortest, each size a multiple
    of the one before; block b holds steps b * size and up. Each level's estimate from below joins its own forecast by
    precision ("ols": all variances 1; "structural": the number of days), upwards; downwards a block's surplus over its
    parts goes to them by their variance. A block that has no forecast of its own, or a null, takes the sum of its parts.
    The rows of one longest block are all that meets in a group.
    """
    if method not in ("ols", "structural"):
        raise ValueError(f"unknown method: {method}")
    sizes = [1, *(size for size, _ in blocks)]
    if any(b % a or b <= a for a, b in zip(sizes, sizes[1:])):
        raise ValueError("each block's size is a multiple of the one before")
    at = lambda size: F.floor(F.col(step) / size).cast("long")
    rows = days.select(key, F.col(step).cast("long").alias(step), F.col(value).cast("double").alias("m0"), F.lit(1.0).alias("v0"), F.lit(1.0).alias("days0"))
    rows = rows.filter(F.col("m0").isNotNull())
    for i, (size, own) in enumerate(blocks, 1):
        part = own.select(F.col(key).alias("_k"), F.col("block").alias("_b"), F.col(value).cast("double").alias(f"own{i}"))
        rows = rows.join(part, (F.col(key) == F.col("_k")) & (at(size) == F.col("_b")), "left").drop("_k", "_b")
    longest = sizes[-1]
    rows = rows.repartition(key, at(longest).alias("_longest")).withColumn("_longest", at(longest))

    def whole(i: int) -> Window:
        return Window.partitionBy(key, "_longest", at(sizes[i]))

    def per_part(c: str, i: int) -> Column:
        """A column of level i - 1, counted once for each of its blocks: every day of a block has it."""
        return F.col(c) / F.col(f"days{i - 1}")

    for i in range(1, len(sizes)):
        rows = rows.withColumns({f"days{i}": F.sum(F.lit(1.0)).over(whole(i)), f"sum{i}": F.sum(per_part(f"m{i - 1}", i)).over(whole(i)), f"spread{i}": F.sum(per_part(f"v{i - 1}", i)).over(whole(i))})
        noise = F.col(f"days{i}") if method == "structural" else F.lit(1.0)
        var = F.when(F.col(f"own{i}").isNull(), F.col(f"spread{i}")).otherwise(1 / (1 / F.col(f"spread{i}") + 1 / noise))
        mean = F.when(F.col(f"own{i}").isNull(), F.col(f"sum{i}")).otherwise(var * (F.col(f"sum{i}") / F.col(f"spread{i}") + F.col(f"own{i}") / noise))
        rows = rows.withColumns({f"m{i}": mean, f"v{i}": var})
    last = len(sizes) - 1
    rows = rows.withColumn(f"f{last}", F.col(f"m{last}"))
    for i in range(last, 0, -1):
        surplus = (F.col(f"f{i}") - F.col(f"sum{i}")) / F.col(f"spread{i}")
        rows = rows.withColumn(f"f{i - 1}", F.col(f"m{i - 1}") + F.col(f"v{i - 1}") * surplus)
    levels = F.array(*[F.struct(F.lit(size).alias("size"), at(size).alias("block"), F.col(f"f{i}").alias(value)) for i, size in enumerate(sizes)])
    out = rows.select(key, F.explode(levels).alias("l")).select(key, "l.*")
    # every day of a block has its value: one of them stays
    return out.groupBy(key, "size", "block").agg(F.min(value).alias(value))
