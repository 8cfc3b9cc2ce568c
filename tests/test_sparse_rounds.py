import numpy as np
from pyspark.sql import functions as F

from stowage.functions.shared import cut
from stowage.operators import reconcile


def test_rounds_see_inner_nodes_and_give_the_dense_result(spark):
    """A leaf and an inner node with two parents; the covariance of two asked nodes against the matrices."""
    pairs = [("a", "all"), ("b", "all"), ("g", "all"), ("g", "a"), ("a1", "a"), ("a2", "a"), ("b1", "b"), ("b2", "b"), ("a2", "g"), ("g1", "g")]
    edges = spark.createDataFrame(pairs, "child string, parent string")
    nodes = sorted({n for p in pairs for n in p})
    at = {n: k for k, n in enumerate(nodes)}
    inner = sorted({p for _, p in pairs})
    c = np.zeros((len(inner), len(nodes)))
    for k, n in enumerate(inner):
        c[k, at[n]] = 1
        for child, parent in pairs:
            c[k, at[child]] -= parent == n
    e = np.random.default_rng(5).normal(size=(6, len(nodes)))
    residuals = spark.createDataFrame([(n, t, float(e[t, k])) for k, n in enumerate(nodes) for t in range(len(e))], "node string, obs int, e double")
    d, u = (cut(x) for x in reconcile.shrunk(residuals))
    dense_d = np.diag([{r["node"]: r["d"] for r in d.collect()}[n] for n in nodes])
    dense_u = np.zeros((len(nodes), len(e)))
    for r in u.collect():
        dense_u[at[r["node"]], r["obs"]] = r["u"]
    a, cu = reconcile.middle(edges, d, u)
    got = {(r["node"], r["other"]): r["a"] for r in a.collect()}
    want = c @ dense_d @ c.T
    assert np.allclose([[got.get((i, j), 0.0) for j in inner] for i in inner], want)
    got = {(r["node"], r["obs"]): r["u"] for r in cu.collect()}
    assert np.allclose([[got[n, t] for t in range(len(e))] for n in inner], c @ dense_u)
    w = dense_d + dense_u @ dense_u.T
    want = w - w @ c.T @ np.linalg.solve(c @ w @ c.T, c @ w)
    rows = reconcile.covariance_of(spark.createDataFrame([("b",), ("a2",)], "node string"), edges, residuals).collect()
    assert len(rows) == 2 * len(nodes)
    assert np.allclose([r["covariance"] for r in rows], [want[at[r["node"]], at[r["other"]]] for r in rows], atol=1e-6)


def test_tables_of_nodes_are_not_sent_to_the_driver(spark):
    """What a stage sends to the driver stays under 150 kB with 20,000 leaves, whose names alone are more."""
    n = 20_000
    leaf = F.sha2(F.col("id").cast("string"), 256)
    edges = spark.range(n).select(leaf.alias("child"), F.concat(F.lit("p"), F.col("id") % 4).alias("parent")).unionByName(spark.range(4).select(F.concat(F.lit("p"), F.col("id")).alias("child"), F.lit("all").alias("parent")))
    base = cut(edges.select(F.col("child").alias("node"), F.when(F.col("parent") == "all", 11.0 * n / 40).otherwise(1.0).alias("v")).unionByName(spark.createDataFrame([("all", float(n))], "node string, v double")).withColumn("key", F.lit(0)))
    d = cut(base.select("node", F.lit(1.0).alias("d")))
    store = spark._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    seen = {(s.stageId(), s.attemptId()) for s in (stages().apply(k) for k in range(stages().size()))}
    out = cut(reconcile.project(base, edges, d))
    found = stages()
    sent = [s.resultSize() for s in (found.apply(k) for k in range(found.size())) if (s.stageId(), s.attemptId()) not in seen]
    assert sent and max(sent) < 150_000, max(sent)
    values = {r["node"]: r["v"] for r in out.filter("length(node) < 5").collect()}
    sums = {r["parent"]: r["v"] for r in out.join(edges, F.col("node") == F.col("child")).groupBy("parent").agg(F.sum("v").alias("v")).collect()}
    assert len(values) == 5 and all(abs(values[k] - sums[k]) < 1e-3 for k in values)
