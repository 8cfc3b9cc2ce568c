"""Connected components of a graph of any size, as joins: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import cut, cut_and_sum


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (the larger ones, or the smaller ones and itself) to its smallest neighbour or itself.

    Sums over a node combine before their shuffle, and neighbours are never collected.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    joined = both.join(low, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
    return out.filter("u <> v").distinct()


def counted(edges: DataFrame) -> tuple[DataFrame, dict]:
    """edges as a table, with figures that tell whether a round has changed them."""
    return cut_and_sum(edges, n=F.count(F.lit(1)), hash=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of edges (u long, v long); root is the component's smallest node.

    Converges in about log2 of the longest path rounds; each is written to the shared folder, which cuts lineage.
    """
    now, before = counted(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        if not before["n"]:
            break
        now, after = counted(star(star(now, True), False))
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not converge")
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return cut(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()))


def extended(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) once edges are added to the components of roots (node, root): only the roots that they touch are linked anew."""
    end = lambda c: F.coalesce(f"{c}_root", c).alias(c)
    lifted = edges.select("u", "v").join(roots.toDF("u", "u_root"), "u", "left").join(roots.toDF("v", "v_root"), "v", "left").select(end("u"), end("v"))
    upper = connected_components(lifted)
    every = roots.unionByName(upper.select("node", F.col("node").alias("root"))).distinct()
    return cut(every.join(upper.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root")))
