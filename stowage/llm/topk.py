"""Exact top-k by inner product over a pivot-distance index.

Vectors are keyed by nearest pivot and distance to it, and each pivot's range of distances is cut into rings: an annulus is
one ring of one pivot, with the least and greatest distance and the greatest norm of its rows. By the triangle
inequality |q - x| >= max(|q - p| - hi, lo - |q - p|) for each x of an annulus, so q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 has a
bound there; q.p + |q| * hi is another. Every query sorts the annuli by the lower of both, best first, and expands
them in that order in rounds that grow; after a round its k-th score is the floor, and it stops where the next bound
can't reach it. Nothing is approximate: the index only decides where to look, and scores are exact integers.

The index is packed into units of at most about `unit` rows, queries into blocks of about `query_block`; both meet in a join on the annulus
(and, for large ones, a slot of it), so neither all rows nor all queries of an annulus are ever gathered, and units aren't copied for
each block of queries. What moves is the index once a round and each query once for each annulus that it visits. Vectors
without structure (independent components) leave all bounds above all floors: then every annulus is visited.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter vectors count as
padded with zeros; equal scores order by vec_id; rows that repeat a vec_id are candidates on their own, and as queries
pool their candidates; rows with null vec_id take no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.common import cut

RESULT = "query_id long, vec_id long, score long"
#: Below every score.
LOWEST = -(2**62)
#: Rows of a block whose scores with a unit are held at a time.
STEP = 128


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact: by floats where every partial sum fits their 24 or 53 bits, else by integers."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if bound < 2.0**53:
        kind = np.float32 if bound < 2.0**24 else np.float64
        return q.astype(kind) @ x.astype(kind).T
    return q.astype(np.int64) @ x.astype(np.int64).T


def choose_pivots(sample: np.ndarray, count: int, rounds: int = 4) -> np.ndarray:
    """Lloyd's rounds from rows spread evenly over the sample."""
    pivots = sample[np.linspace(0, len(sample) - 1, min(count, len(sample))).astype(int)]
    for _ in range(rounds):
        near = distances(sample, pivots).argmin(1)
        pivots = np.array([sample[near == k].mean(0) if (near == k).any() else pivots[k] for k in range(len(pivots))])
    return pivots


def score_bounds(q: np.ndarray, pivot: np.ndarray, low: np.ndarray, high: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """(queries, annuli): what no score with a row of the annulus exceeds; pivot holds each annulus's own."""
    square, d = (q * q).sum(1)[:, None], distances(q, pivot)
    gap = np.maximum(np.maximum(d - high, low - d), 0)
    bound = np.minimum((square + norm - gap**2) / 2, q @ pivot.T + np.sqrt(square) * high)
    return bound + 1e-6 * (1 + np.abs(bound) + norm)  # distances are floats


def best(query_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[np.ndarray]:
    """Queries, vectors and scores of the k best of x for each query that reach its floor, ties to smaller ids; its own row is no candidate."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    own = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
    out = []
    for at in range(0, len(q), STEP):
        part = slice(at, at + STEP)
        scores, floor = inner_products(q[part], x), floors[part]
        for i in np.flatnonzero(own[1][part] > own[0][part]):
            scores[i, own[0][at + i] : own[1][at + i]] = LOWEST
        reach = (scores >= floor[:, None]) & (scores > LOWEST)
        for i in np.flatnonzero(reach.sum(1) > k):
            reach[i] &= scores[i] >= np.partition(scores[i], len(ids) - k)[len(ids) - k]
        which, where = np.nonzero(reach)
        score = scores[which, where].astype(np.int64)
        order = np.lexsort((where, -score, which))
        which, where, score = which[order], where[order], score[order]
        rank = np.arange(len(which)) - np.searchsorted(which, which)
        keep = rank < k
        out.append((query_ids[part][which[keep]], ids[where[keep]], score[keep]))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3


def top_k(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 64.0,
    every: int = 20,
    k: int = 20,
    pivots: int = 16,
    rings: int = 8,
    sample: int = 2048,
    unit: int = 16384,
    query_block: int = 4096,
    first: int = 4,
    growth: int = 4,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best for each row whose id is divisible by every, against all other rows.

    Pivots and ring edges are fitted on at most `sample` rows (those of lowest hash), every row is indexed. Rounds end
    after the first, first * growth, ... annuli of each query's order.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ints = vectors.filter(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale)).alias("v"))
    largest = F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, v: F.greatest(a, F.abs(v))))
    dim, most, total, asked = ints.agg(F.max(F.size("v")), largest, F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    if not total or not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, kind = max(dim, 1), next(t for t in ("<i2", "<i4", "<i8") if t == "<i8" or most <= np.iinfo(t).max)

    def padded(rows: list) -> np.ndarray:
        out = np.zeros((len(rows), dim), dtype=np.int64)
        for i, r in enumerate(rows):
            out[i, : len(r)] = r
        return out

    some = padded([r["v"] for r in ints.orderBy(F.xxhash64("vec_id", "v")).limit(sample).collect()]).astype(np.float64)
    centres = choose_pivots(some, pivots)
    to_own = distances(some, centres)
    near = to_own.argmin(1)
    edges = [np.quantile(to_own[near == c, c], np.linspace(0, 1, rings + 1)[1:-1]) if (near == c).any() else np.zeros(rings - 1) for c in range(len(centres))]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = padded(b.column("v").to_pylist())
                d = distances(v.astype(np.float64), centres)
                cell = d.argmin(1)
                far = d[np.arange(len(v)), cell]
                ring = np.array([np.searchsorted(edges[c], r) for c, r in zip(cell, far, strict=True)])
                norm = (v.astype(np.float64) ** 2).sum(1)
                cols = [b.column("vec_id"), pa.array([r.tobytes() for r in v.astype(kind)], pa.binary()), pa.array(cell * rings + ring), pa.array(far), pa.array(norm)]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "vec", "annulus", "far", "norm"])

    index = cut(ints.mapInArrow(keyed, "vec_id long, vec binary, annulus long, far double, norm double"))
    # at most pivots * rings rows, however many vectors there are
    stats = index.groupBy("annulus").agg(F.count(F.lit(1)), F.min("far"), F.max("far"), F.max("norm")).orderBy("annulus").collect()
    known, sizes, lows, highs, norms = (np.array(c) for c in zip(*stats, strict=True))
    # a slot holds at most about 64 units, which a task may meet one after the other
    parts, slots = -(-sizes // unit), -(-sizes // (64 * unit))
    of = lambda counts: F.element_at(F.create_map(*[F.lit(int(v)) for a, n in zip(known, counts, strict=True) for v in (a, n)]), F.col("annulus"))
    placed = index.withColumn("part", F.pmod(F.xxhash64("vec_id", "vec"), of(parts))).withColumn("slot", F.col("part") % of(slots))
    units = cut(placed.groupBy("annulus", "slot", "part").agg(F.collect_list(F.struct("vec_id", "vec")).alias("rows")).select("annulus", "slot", "rows"))
    queries = index.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vec")

    def unpack(vecs: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(vecs.to_pylist()), dtype=kind).reshape(len(vecs), dim)

    def visits(begin: int, end: int):
        """The annuli that come at places begin to end of each query's order and may reach its floor."""

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    b = whole.slice(at, 512)
                    v = unpack(b.column("vec")).astype(np.float64)
                    bound = score_bounds(v, centres[known // rings], lows, highs, norms)
                    order = np.argsort(-bound, axis=1, kind="stable")[:, begin:end]
                    floor = b.column("floor").to_numpy()
                    which, place = np.nonzero(np.take_along_axis(bound, order, axis=1) >= floor[:, None])
                    where = order[which, place]
                    times = slots[where]
                    which, where = np.repeat(which, times), np.repeat(where, times)
                    slot = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                    took = b.take(pa.array(which))
                    yield pa.RecordBatch.from_arrays([*took.columns, pa.array(known[where]), pa.array(slot)], names=["query_id", "vec", "floor", "annulus", "slot"])

        return go

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q, u = b.column("asks")[i].values, b.column("rows")[i].values
                found = best(q.field("query_id").to_numpy(), unpack(q.field("vec")), q.field("floor").to_numpy(), u.field("vec_id").to_numpy(), unpack(u.field("vec")), k)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["query_id", "vec_id", "score"])

    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    chunk = F.pmod(F.xxhash64("query_id"), F.lit(-(-asked // query_block)))
    found, begin, end = None, 0, first
    while begin < len(known):
        asks = queries.withColumn("floor", F.lit(LOWEST))
        if found is not None:
            kth = found.filter(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").alias("kth"))
            asks = queries.join(kth, F.col("query_id") == F.col("of"), "left").select("query_id", "vec", F.coalesce("kth", F.lit(LOWEST)).alias("floor"))
        asks = asks.mapInArrow(visits(begin, end), "query_id long, vec binary, floor long, annulus long, slot long")
        blocks = asks.groupBy("annulus", "slot", chunk.alias("chunk")).agg(F.collect_list(F.struct("query_id", "vec", "floor")).alias("asks"))
        more = units.join(blocks, ["annulus", "slot"]).select("asks", "rows").mapInArrow(search, RESULT)
        every_one = more if found is None else more.unionByName(found.select("query_id", "vec_id", "score"))
        ranked = every_one.withColumn("rank", F.row_number().over(by_score).cast("int")).filter(F.col("rank") <= k)
        found = cut(ranked.select("query_id", "rank", "vec_id", "score"))
        begin, end = end, end * growth
    return found
