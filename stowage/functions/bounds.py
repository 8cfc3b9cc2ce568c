"""Broadcasts behind a check of size, and searches in blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def small(df: DataFrame, most: int = 20_000) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows, else df as it is: the join is then planned by size alone."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def against(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """Each of a stated set of asked rows beside each of rows, in as many blocks of hashed rows as there are blocks of as many asked rows.

    A join on the block's number: asked rows are sent once a block, rows once, and with a square root of the asked rows'
    number in blocks neither side's copies outgrow the result. Top-k windows on the result prune each task's part first.
    """
    blocks = max(1, int(asked.count() ** 0.5))
    left = asked.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.withColumn("_block", F.pmod(F.xxhash64(*rows.columns), F.lit(blocks)).cast("int"))
    return left.join(right, "_block").drop("_block")
