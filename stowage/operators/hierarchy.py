"""Hierarchical reconciliation. Structure and projections are small matrices; forecasts stay tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions.bounds import small
from stowage.functions.shared import cut


def closure(edges: DataFrame, most_levels: int = 100) -> DataFrame:
    """(node, leaf): every node with each leaf below it, a leaf with itself; from (child, parent), a join for each level.

    There is no bound on rows; more than most_levels levels, or a cycle, are an error.
    """
    e = cut(edges.filter("child IS NOT NULL AND parent IS NOT NULL").select("child", "parent").distinct())
    every = level = e.join(e.select(F.col("parent").alias("child")), "child", "left_anti").select(F.col("child").alias("node"), F.col("child").alias("leaf")).distinct()
    for _ in range(most_levels):
        level = cut(level.join(e, F.col("node") == F.col("child")).select(F.col("parent").alias("node"), "leaf").distinct())
        if level.isEmpty():
            return every.distinct()
        every = every.unionByName(level)
    raise ValueError(f"the hierarchy has a cycle or more than {most_levels} levels")


def bottom_up(forecasts: DataFrame, edges: DataFrame, value: str = "yhat", keys: tuple[str, ...] = ()) -> DataFrame:
    """Every node's sum of its leaves' forecasts (node, keys, value)."""
    rows = closure(edges).join(forecasts.withColumnRenamed("node", "leaf"), "leaf")
    return rows.groupBy("node", *keys).agg(F.sum(value).alias(value))


def top_down(total: DataFrame, past: DataFrame, value: str = "yhat", keys: tuple[str, ...] = ()) -> DataFrame:
    """Leaves' shares of past sums times the total: total (keys, value), past (leaf, amount)."""
    sums = past.groupBy("leaf").agg(F.sum("amount").alias("amount"))
    everything = sums.agg(F.sum("amount")).first()[0]
    shares = sums.select("leaf", F.try_divide("amount", F.lit(everything)).alias("share"))
    return total.crossJoin(small(shares)).select(*keys, "leaf", (F.col(value) * F.col("share")).alias(value))


def summing_matrix(pairs: list[tuple[str, str]]) -> tuple[list[str], list[str], np.ndarray]:
    """Nodes (most leaves first), leaves and S from closure pairs. A hierarchy has a few thousand nodes at most."""
    leaves = sorted({leaf for _, leaf in pairs})
    size: dict[str, int] = {}
    for node, _ in pairs:
        size[node] = size.get(node, 0) + 1
    nodes = sorted(set(size) - set(leaves), key=lambda n: (-size[n], n)) + leaves
    s = np.zeros((len(nodes), len(leaves)))
    row, col = {n: i for i, n in enumerate(nodes)}, {n: i for i, n in enumerate(leaves)}
    for node, leaf in pairs:
        s[row[node], col[leaf]] = 1
    return nodes, leaves, s


def shrunk_covariance(residuals: np.ndarray) -> np.ndarray:
    """Sample covariance shrunk to its diagonal; residuals (observations, nodes)."""
    n, p = residuals.shape
    x = residuals - residuals.mean(0)
    sample = x.T @ x / (n - 1)
    target = np.diag(np.diag(sample))
    apart = ((sample - target) ** 2).sum()
    if apart < 1e-10:
        return sample
    a = (((x**4).sum() / p - (x**2).sum() ** 2 / (n * p)) / (n * (n - 1))) / apart
    a = min(1.0, max(0.0, a))
    return (1 - a) * sample + a * target


def projection(s: np.ndarray, method: str = "ols", residuals: np.ndarray | None = None) -> np.ndarray:
    """P = S (S' W^-1 S)^-1 S' W^-1 of the method's W."""
    if method in ("wls_variance", "mint") and residuals is None:
        raise ValueError(f"{method} needs residuals")
    if method == "ols":
        w = np.eye(len(s))
    elif method == "wls_structural":
        w = np.diag(s.sum(1))
    elif method == "wls_variance":
        w = np.diag(np.maximum(residuals.var(0), 1e-6))
    elif method == "mint":
        w = shrunk_covariance(residuals) + 1e-9 * np.eye(len(s))
    else:
        raise ValueError(f"unknown method: {method}")
    inv = np.linalg.inv(w)
    return s @ np.linalg.inv(s.T @ inv @ s) @ s.T @ inv


def reconcile(forecasts: DataFrame, nodes: list[str], p: np.ndarray, value: str = "yhat", keys: tuple[str, ...] = ()) -> DataFrame:
    """Coherent forecasts: the projection as a small table joined to all (keys, node, value) and summed."""
    spark = forecasts.sparkSession
    rows = [(nodes[i], nodes[j], float(p[i, j])) for i in range(len(nodes)) for j in range(len(nodes)) if abs(p[i, j]) > 1e-15]
    matrix = spark.createDataFrame(rows, "to string, node string, weight double")
    return forecasts.join(matrix, "node").groupBy(F.col("to").alias("node"), *keys).agg(F.sum(F.col("weight") * F.col(value)).alias(value))


def reconcile_tree(forecasts: DataFrame, edges: DataFrame, value: str = "yhat", method: str = "wls_structural", most_levels: int = 100, variances: DataFrame | None = None) -> DataFrame:
    """Coherent forecasts (node, value) of a tree of any size by least squares, "ols", "wls_structural" or with variances (node, d), "wls_variance"; no matrix is formed.

    On a tree the normal equations solve in two passes of joins. Upwards each node joins its own forecast with the sum
    of its children's estimates, both by their precision; downwards a node's surplus over that sum goes to the children
    by their variance. forecasts has a row for every node.
    """
    if method not in ("ols", "wls_structural", "wls_variance"):
        raise ValueError(f"unknown method: {method}")
    if (method == "wls_variance") != (variances is not None):
        raise ValueError("wls_variance needs variances, and the other methods have their own")
    e = cut(edges.filter("child IS NOT NULL AND parent IS NOT NULL").select("child", "parent").distinct())
    levels, level = [], e.join(e.select(F.col("child").alias("parent")), "parent", "left_anti").select(F.col("parent").alias("node")).distinct()
    while not level.isEmpty():
        levels.append(level)
        if len(levels) > most_levels:
            raise ValueError(f"the hierarchy has a cycle or more than {most_levels} levels")
        level = cut(level.join(e, F.col("node") == F.col("parent")).select(F.col("child").alias("node")))
    base = forecasts.select("node", F.col(value).cast("double").alias("own"))
    base = cut(base.withColumn("d", F.lit(1.0)) if variances is None else base.join(variances.select("node", "d"), "node"))
    below, estimates = None, []
    for level in reversed(levels):
        rows = level.join(base, "node")
        if below is not None:
            sums = below.join(e, F.col("node") == F.col("child")).groupBy(F.col("parent").alias("of")).agg(F.sum("mean").alias("total"), F.sum("var").alias("spread"), F.sum("leaves").alias("below"))
            rows = rows.join(sums, F.col("node") == F.col("of"), "left").drop("of")
        else:
            rows = rows.withColumns({"total": F.lit(None).cast("double"), "spread": F.lit(None).cast("double"), "below": F.lit(None).cast("long")})
        leaves = F.coalesce("below", F.lit(1).cast("long"))
        own_var = leaves.cast("double") if method == "wls_structural" else F.col("d")
        var = F.when(F.col("spread").isNull(), own_var).otherwise(1 / (1 / F.col("spread") + 1 / own_var))
        mean = F.when(F.col("spread").isNull(), F.col("own")).otherwise(var * (F.col("total") / F.col("spread") + F.col("own") / own_var))
        below = cut(rows.select("node", mean.alias("mean"), var.alias("var"), "total", "spread", leaves.alias("leaves")))
        estimates.append(below)
    final = estimates.pop().select("node", F.col("mean").alias("value"), "total", "spread")
    out = final
    while estimates:
        surplus = final.select(F.col("node").alias("of"), ((F.col("value") - F.col("total")) / F.col("spread")).alias("surplus"))
        rows = estimates.pop().join(e, F.col("node") == F.col("child")).join(surplus, F.col("parent") == F.col("of"))
        final = cut(rows.select("node", (F.col("mean") + F.col("var") * F.col("surplus")).alias("value"), "total", "spread"))
        out = out.unionByName(final)
    return out.select("node", F.col("value").alias(value))


def reconciled_covariance(s: np.ndarray, p: np.ndarray, covariance: np.ndarray) -> np.ndarray:
    return p @ covariance @ p.T


def temporal_matrix(days: int = 28, blocks: tuple[int, ...] = (28, 7)) -> np.ndarray:
    """Sums over blocks of days, from the longest, and the days themselves."""
    parts = [np.kron(np.eye(days // b), np.ones((1, b))) for b in blocks]
    return np.vstack([*parts, np.eye(days)])
