"""Conformal intervals: quantiles of calibration scores that hold their level in finite samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.operators.neighbours import k_nearest
from stowage.operators.selection import quantiles


def conformal_level(n: Column, alpha: float) -> Column:
    return F.least(F.ceil((n + 1) * (1 - alpha)) / n, F.lit(1.0))


def score_quantile(scores: DataFrame, keys: list[str], score: Column, alpha: float = 0.1, **options: int) -> DataFrame:
    """(keys, q): the level's linear quantile of each key's scores, by narrowing brackets: no key is gathered or sorted as a whole."""
    return quantiles(scores, keys, score, lambda n: conformal_level(n, alpha), **options)


def split_conformal(calibration: DataFrame, keys: list[str], alpha: float = 0.1) -> DataFrame:
    """Half-width of intervals around yhat, and the width."""
    q = score_quantile(calibration, keys, F.abs(F.col("y") - F.col("yhat")), alpha)
    return q.withColumn("width", 2 * F.col("q"))


def conformalized_quantiles(calibration: DataFrame, rows: DataFrame, keys: list[str], alpha: float = 0.1) -> DataFrame:
    """rows (lower, upper) corrected by the score max(lower - y, y - upper); the correction may be negative."""
    q = score_quantile(calibration, keys, F.greatest(F.col("lower") - F.col("y"), F.col("y") - F.col("upper")), alpha)
    out = rows.join(q, keys).withColumns({"lower": F.col("lower") - F.col("q"), "upper": F.col("upper") + F.col("q")})
    return out.withColumn("point", (F.col("lower") + F.col("upper")) / 2).drop("q")


def local_conformal(calibration: DataFrame, queries: DataFrame, k: int = 100, alpha: float = 0.1, **index: int) -> DataFrame:
    """(query_id, q): the level's quantile of the k calibration scores nearest in features.

    calibration (cal_id, x array, score). A query that is a calibration row itself is left out of its own neighbours: its
    score is what the interval is to cover.
    """
    near = k_nearest(calibration, queries, k, id_col="cal_id", asked_id="query_id", others=True, **index)
    scores = near.join(calibration.select(F.col("cal_id").alias("id"), "score"), "id")
    return score_quantile(scores.withColumnRenamed("asked_id", "query_id"), ["query_id"], F.col("score"), alpha)
