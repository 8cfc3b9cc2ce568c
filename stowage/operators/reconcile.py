"""Reconciliation by conjugate gradients on the edges of a hierarchy: no matrix of nodes by nodes is formed, neither on the driver nor as a table.

Coherent forecasts are y - W C' (C W C')^-1 C y, where C has a row for each node that has children: its value less the
sum of theirs. C and C' are joins with the edges. W is a diagonal, or the shrunk covariance of residuals, a diagonal plus
a product of residual rows, whose action is two aggregates over the residual table. Nodes with several parents are fine.
Rounds see inner nodes alone: C W C' is summed up once, as the pairs of inner nodes that share a node and as C's residual rows.
Tables with a row for each node are joined by merging, so none of them is sent to the driver for a broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions.bounds import small
from stowage.functions.shared import cut, release

LEAST_VARIANCE = 1e-6


def beside(df: DataFrame) -> DataFrame:
    """df for a join: broadcast if it has few rows, else merged."""
    few = small(df)
    return df.hint("merge") if few is df else few


def variances(residuals: DataFrame) -> DataFrame:
    """(node, d): the population variance of each node's residuals (node, obs, e), of 1e-6 at least."""
    return residuals.groupBy("node").agg(F.greatest(F.var_pop("e"), F.lit(LEAST_VARIANCE)).alias("d"))


def shrunk(residuals: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The shrunk covariance as (node, d) and (node, obs, u): W = diag(d) + sum over obs of u u'.

    The sample covariance S moves to its diagonal T by the share a. Sums of S**2 come from the observations' products,
    a table of observations by observations; of nodes by nodes there is none. Residuals have a row for each node and observation.
    """
    mean = residuals.groupBy("node").agg(F.avg("e").alias("m"))
    x = cut(residuals.join(mean.hint("merge"), "node").select("node", "obs", (F.col("e") - F.col("m")).alias("x")))
    n, p = x.select("obs").distinct().count(), mean.count()
    if n < 2:
        return mean.select("node", F.lit(LEAST_VARIANCE).alias("d")), None
    diagonal = cut(x.groupBy("node").agg((F.sum(F.col("x") * F.col("x")) / (n - 1)).alias("s"), F.sum(F.pow("x", F.lit(4.0))).alias("x4"), F.sum(F.col("x") * F.col("x")).alias("x2")))
    products = x.join(x.select(F.col("node").alias("n2"), F.col("obs").alias("o2"), F.col("x").alias("y")).hint("merge"), F.col("node") == F.col("n2")).groupBy("obs", "o2").agg(F.sum(F.col("x") * F.col("y")).alias("g"))
    # |S|**2 is the sum of squared products of observations over (n - 1)**2
    total = products.agg(F.sum(F.col("g") * F.col("g"))).first()[0] / (n - 1) ** 2
    own, x4, x2 = diagonal.agg(F.sum(F.col("s") * F.col("s")), F.sum("x4"), F.sum("x2")).first()
    apart = total - own
    a = 0.0 if apart < 1e-10 else min(1.0, max(0.0, ((x4 / p - x2 * x2 / (n * p)) / (n * (n - 1))) / apart))
    return diagonal.select("node", (a * F.col("s") + 1e-9).alias("d")), x.select("node", "obs", (F.col("x") * ((1 - a) / (n - 1)) ** 0.5).alias("u"))


def weighed(v: DataFrame, d: DataFrame, u: DataFrame | None) -> DataFrame:
    """W v for (node, key, v)."""
    out = v.join(d.hint("merge"), "node").select("node", "key", (F.col("d") * F.col("v")).alias("v"))
    return out if u is None else out.unionByName(through(v, u)).groupBy("node", "key").agg(F.sum("v").alias("v"))


def through(v: DataFrame, u: DataFrame) -> DataFrame:
    """The sum over obs of u u' v for (node, key, v). The products by obs and key lie between as a table, whose size is then known."""
    along = cut(v.join(u.hint("merge"), "node").groupBy("obs", "key").agg(F.sum(F.col("u") * F.col("v")).alias("t")))
    return u.join(beside(along), "obs").groupBy("node", "key").agg(F.sum(F.col("u") * F.col("t")).alias("v"))


def surplus(y: DataFrame, edges: DataFrame) -> DataFrame:
    """C y: each inner node's value less the sum of its children's."""
    inner = edges.select(F.col("parent").alias("node")).distinct()
    own = y.join(beside(inner), "node", "left_semi")
    below = y.join(edges.hint("merge"), F.col("node") == F.col("child")).select(F.col("parent").alias("node"), "key", (-F.col("v")).alias("v"))
    return own.unionByName(below).groupBy("node", "key").agg(F.sum("v").alias("v"))


def spread(x: DataFrame, edges: DataFrame) -> DataFrame:
    """C' x: an inner node's multiplier for itself, less those of its parents."""
    below = edges.join(beside(x), F.col("node") == F.col("parent")).select(F.col("child").alias("node"), "key", (-F.col("v")).alias("v"))
    return x.unionByName(below).groupBy("node", "key").agg(F.sum("v").alias("v"))


def middle(edges: DataFrame, d: DataFrame, u: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """C W C' in the parts of W: (node, other, a) for the diagonal, a row for each two inner nodes that are linked or share a child, and C's rows of the residuals (node, obs, u)."""
    inner = edges.select(F.col("parent").alias("node")).distinct()
    c = cut(inner.select("node", F.col("node").alias("at"), F.lit(1.0).alias("c")).unionByName(edges.select(F.col("parent").alias("node"), F.col("child").alias("at"), F.lit(-1.0).alias("c"))))
    with_d = c.join(d.withColumnRenamed("node", "at").hint("merge"), "at")
    a = with_d.join(c.select("at", F.col("node").alias("other"), F.col("c").alias("c2")).hint("merge"), "at").groupBy("node", "other").agg(F.sum(F.col("c") * F.col("d") * F.col("c2")).alias("a"))
    return cut(a), None if u is None else cut(surplus(u.select("node", F.col("obs").alias("key"), F.col("u").alias("v")), edges).select("node", F.col("key").alias("obs"), F.col("v").alias("u")))


def multipliers(b: DataFrame, edges: DataFrame, d: DataFrame, u: DataFrame | None, tolerance: float, most: int) -> DataFrame:
    """x with C W C' x = b, by conjugate gradients scaled by the diagonal, all keys at once; a key ends when its residual is `tolerance` of b's."""
    a, cu = middle(edges, d, u)
    a = beside(a)
    children = edges.join(d.withColumnRenamed("node", "child").hint("merge"), "child").groupBy(F.col("parent").alias("node")).agg(F.sum("d").alias("below"))
    scale = cut(children.join(d.hint("merge"), "node").select("node", (F.col("d") + F.col("below")).alias("scale")))
    start = b.join(beside(scale), "node").select("node", "key", F.lit(0.0).alias("x"), F.col("v").alias("r"), (F.col("v") / F.col("scale")).alias("p"), "scale")
    state = cut(start)
    sums = cut(state.groupBy("key").agg(F.sum(F.col("r") * F.col("r") / F.col("scale")).alias("rho")))
    first, old = sums.withColumnRenamed("rho", "rho0"), []
    for _ in range(most):
        live = sums.join(first, "key").filter(F.col("rho") > tolerance * tolerance * F.col("rho0")).select("key", "rho")
        if live.isEmpty():
            return state.select("node", "key", F.col("x").alias("v"))
        p = state.join(live, "key").select("node", "key", F.col("p").alias("v"))
        q = p.join(a, "node").select(F.col("other").alias("node"), "key", (F.col("a") * F.col("v")).alias("q"))
        if cu is not None:
            q = q.unionByName(through(p, cu).withColumnRenamed("v", "q"))
        both = cut(state.join(q.groupBy("node", "key").agg(F.sum("q").alias("q")).hint("merge"), ["node", "key"], "left"))
        length = both.groupBy("key").agg(F.sum(F.col("p") * F.col("q")).alias("pq")).join(live, "key").select("key", (F.col("rho") / F.col("pq")).alias("alpha"), "rho")
        step = F.coalesce("alpha", F.lit(0.0))
        moved = both.join(length, "key", "left").select("node", "key", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.coalesce("q", F.lit(0.0))).alias("r"), "p", "scale", "rho")
        moved = cut(moved)
        after = moved.groupBy("key").agg(F.sum(F.col("r") * F.col("r") / F.col("scale")).alias("after"), F.max("rho").alias("before"))
        turn = F.coalesce(F.col("after") / F.col("before"), F.lit(0.0))
        state = moved.join(after, "key").select("node", "key", "x", "r", (F.col("r") / F.col("scale") + turn * F.col("p")).alias("p"), "scale")
        release(both, *old)
        sums, old = after.select("key", F.col("after").alias("rho")), [moved]
    raise ValueError(f"no solution within {most} rounds")


def project(y: DataFrame, edges: DataFrame, d: DataFrame, u: DataFrame | None = None, *, tolerance: float = 1e-10, most: int = 500) -> DataFrame:
    """(node, key, v): coherent values nearest to y in W's measure."""
    y = cut(y.select("node", "key", F.col("v").cast("double").alias("v")))
    edges = cut(edges.filter("child IS NOT NULL AND parent IS NOT NULL").select("child", "parent").distinct())
    x = multipliers(surplus(y, edges), edges, d, u, tolerance, most)
    moves = weighed(spread(x, edges), d, u).select("node", "key", (-F.col("v")).alias("v"))
    return y.unionByName(moves).groupBy("node", "key").agg(F.sum("v").alias("v"))


def reconcile_sparse(forecasts: DataFrame, edges: DataFrame, *, method: str = "ols", residuals: DataFrame | None = None, value: str = "yhat", key: str | None = None, **options) -> DataFrame:
    """Coherent forecasts (node, key, value) by "ols", "wls_variance" or "mint"; the last two need residuals (node, obs, e). key parts forecasts that are made coherent one by one, such as dates or draws."""
    if method not in ("ols", "wls_variance", "mint"):
        raise ValueError(f"unknown method: {method}")
    if method != "ols" and residuals is None:
        raise ValueError(f"{method} needs residuals")
    y = forecasts.select("node", (F.col(key) if key else F.lit(0)).alias("key"), F.col(value).alias("v"))
    d, u = (y.select("node").distinct().withColumn("d", F.lit(1.0)), None) if method == "ols" else (variances(residuals), None) if method == "wls_variance" else shrunk(residuals)
    out = project(y, edges, cut(d), None if u is None else cut(u), **options)
    return out.select("node", *([F.col("key").alias(key)] if key else []), F.col("v").alias(value))


def covariance_of(nodes: DataFrame, edges: DataFrame, residuals: DataFrame, *, method: str = "mint", **options) -> DataFrame:
    """(node, other, covariance) of the reconciled forecasts of some asked nodes with all nodes, if base forecasts have covariance W. A row of P W for each asked node: P' e, then W."""
    d, u = shrunk(residuals) if method == "mint" else (variances(residuals), None)
    d, u = cut(d), None if u is None else cut(u)
    edges = cut(edges.filter("child IS NOT NULL AND parent IS NOT NULL").select("child", "parent").distinct())
    units = cut(nodes.select("node", F.col("node").alias("key"), F.lit(1.0).alias("v")))
    w = cut(weighed(units, d, u))
    x = multipliers(surplus(w, edges), edges, d, u, options.get("tolerance", 1e-10), options.get("most", 500))
    out = w.unionByName(weighed(spread(x, edges), d, u).select("node", "key", (-F.col("v")).alias("v"))).groupBy("node", "key").agg(F.sum("v").alias("v"))
    return out.select(F.col("key").alias("node"), F.col("node").alias("other"), F.col("v").alias("covariance"))
