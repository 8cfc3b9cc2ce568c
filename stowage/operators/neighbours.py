"""Exact nearest neighbours of a set of asked rows, by a metric index that leaves out what can't be near.

Rows lie in rings around pivots. From a row's distances to the pivots and a ring's least and greatest distance to its
own, the triangle inequality bounds how near that ring's rows can be. An asked row first visits the rings of least bound
that hold k rows together; the k-th distance found there is the reach of its second visit, to every other ring whose
bound is within it. A ring of many rows has many shares; shares of about UNIT rows together are a unit, in which a task compares
the rows of visited rings with blocks of asked rows as matrices and keeps the k nearest of each asked row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.bounds import small
from stowage.functions.shared import cut

#: Relative slack of bounds, for rounding.
SLACK = 1e-9
#: Rows of a unit, asked rows that meet it in one group, and distances that are held at once.
UNIT, ASKED, HELD = 32_000, 16_000, 8_000_000


def unit_vector(x: Column) -> Column:
    """x scaled to length 1, zeros if it has none: distances then order as cosine similarities do."""
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(x, lambda v: F.when(norm > 0, v / norm).otherwise(F.lit(0.0)))


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n different rows, each the farthest from those before; the first is the one farthest from the mean."""
    chosen = [int(((x - x.mean(0)) ** 2).sum(1).argmax())]
    near = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(((x - p) ** 2).sum(1))
    return out


@dataclass
class Index:
    """rows (id, x, ring, share), the pivots, and of each ring: its pivot, least and greatest distance, rows and shares."""

    rows: DataFrame | None
    pivots: np.ndarray
    rings: pd.DataFrame

    def bounds(self, d: np.ndarray) -> np.ndarray:
        """The least distance that each ring's rows can have from a row with these distances to the pivots."""
        own = d[self.rings["pivot"].to_numpy()]
        low, high = self.rings["low"].to_numpy(), self.rings["high"].to_numpy()
        return np.maximum(0.0, np.maximum(own - high, low - own)) * (1 - SLACK) - SLACK


def build(rows: DataFrame, id_col: str, x_col: str, *, pivots: int = 32, sample: int = 4096, rings: int = 16, share: int = 2000) -> Index:
    """Pivots come from the `sample` rows of lowest hash (a bounded sample on the driver); all rows are in the index. Rows with a null vector or a null in it are left out."""
    x = F.col(x_col).cast("array<double>")
    rows = rows.select(F.col(id_col).alias("id"), x.alias("x")).filter(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    few = rows.orderBy(F.xxhash64("id", "x"), "id").limit(sample).select("x").toPandas()["x"]
    if not len(few):
        return Index(rows.select("id", "x", F.lit(0).alias("ring"), F.lit(0).alias("share")), np.zeros((0, 0)), pd.DataFrame({"pivot": [], "low": [], "high": [], "n": [], "shares": []}))
    centres = farthest_first(np.stack(few.to_numpy()), pivots)

    @F.pandas_udf("pivot int, d double")
    def nearest_pivot(v: pd.Series) -> pd.DataFrame:
        d = distances(np.stack(v.to_numpy()), centres) if len(v) else np.zeros((0, len(centres)))
        at = d.argmin(1)
        return pd.DataFrame({"pivot": at.astype(np.int32), "d": d[np.arange(len(d)), at]})

    placed = cut(rows.withColumn("p", nearest_pivot("x")).select("id", "x", "p.*"))
    spans = placed.groupBy("pivot").agg(F.min("d").alias("near"), F.max("d").alias("far"))
    ring = F.when(F.col("far") > F.col("near"), F.least(F.floor((F.col("d") - F.col("near")) / (F.col("far") - F.col("near")) * rings), F.lit(rings - 1))).otherwise(0)
    placed = placed.join(F.broadcast(spans), "pivot").withColumn("ring", (F.col("pivot") * rings + ring).cast("int"))  # spans: a row a pivot
    stats = placed.groupBy("ring").agg(F.first("pivot").alias("pivot"), F.min("d").alias("low"), F.max("d").alias("high"), F.count(F.lit(1)).alias("n"))
    stats = stats.orderBy("ring").toPandas()  # at most pivots * rings rows
    stats["shares"] = -(-stats["n"] // share)
    shares = placed.sparkSession.createDataFrame(stats[["ring", "shares"]])
    split = placed.join(F.broadcast(shares), "ring").select("id", "x", "ring", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share"))
    return Index(cut(split), centres, stats)


def visited(index: Index, asked: DataFrame, k: int, reach: bool) -> DataFrame:
    """asked (asked_id, ax, and with reach a distance `within`) and the rings that each visits: those of least bound that hold k rows, or all others within its reach (null: all)."""

    own = Index(None, index.pivots, index.rings)  # what goes to the tasks: pivots and rings, both of bounded size

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ring, n = own.rings["ring"].to_numpy(), own.rings["n"].to_numpy()
        for f in frames:
            d = distances(np.stack(f["ax"].to_numpy()), own.pivots) if len(f) else []
            found = []
            for i, row in enumerate(d):
                low = own.bounds(row)
                order = np.argsort(low, kind="stable")
                first = 1 + int(np.searchsorted(np.cumsum(n[order]), k))
                if reach:
                    within = f["within"].iloc[i]
                    rest = order[first:]
                    found.append(ring[rest if pd.isna(within) else rest[low[rest] <= within]].tolist())
                else:
                    found.append(ring[order[:first]].tolist())
            yield f.assign(rings=found)[["asked_id", "ax", "rings"]]

    return asked.mapInPandas(go, f"asked_id {asked.schema['asked_id'].dataType.simpleString()}, ax array<double>, rings array<int>")


def visits(index: Index, asked: DataFrame, k: int, reach: bool) -> DataFrame:
    """The same with a row for each ring."""
    return visited(index, asked, k, reach).select("asked_id", "ax", F.explode("rings").alias("ring"))


def nearest_of(a: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, rows: list[np.ndarray], columns: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place in a, places in x, distances) of the k nearest of x to each of a, ties to the least id; rows[j] of a look at columns[j] of x.

    A matrix product gives distances but for rounding; those that can be among the k are computed anew as the root of the
    sum of squared differences.
    """
    a2, x2 = (a * a).sum(1), (x * x).sum(1)
    rough = np.full((len(a), len(x)), np.inf)
    for r, c in zip(rows, columns, strict=True):
        rough[np.ix_(r, c)] = a2[r, None] + x2[None, c] - 2 * (a[r] @ x[c].T)
    slack = 1e-12 * (a2 + x2.max(initial=0.0)) * max(1, x.shape[1])
    for i, row in enumerate(rough):
        kth = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
        near = np.flatnonzero((row <= kth + 2 * slack[i]) & np.isfinite(row))
        d = np.sqrt(((a[i] - x[near]) ** 2).sum(1))
        top = np.lexsort((ids[near], d))[:k]
        yield i, near[top], d[top]


def meet(index: Index, visit: DataFrame, k: int, asked_rows: int) -> DataFrame:
    """(asked_id, id, d) of the k nearest rows of the visited rings; each unit keeps its own k before they meet."""
    pieces = index.rings.loc[index.rings.index.repeat(index.rings["shares"]), ["ring", "n", "shares"]].reset_index(drop=True)
    pieces["share"] = pieces.groupby("ring").cumcount()
    pieces["piece"] = np.arange(len(pieces))
    pieces["unit"] = ((pieces["n"] / pieces["shares"]).cumsum() // UNIT).astype(int)
    of_ring = {r: own.to_numpy() for r, own in pieces.groupby("ring")["piece"]}
    unit_of, blocks = pieces["unit"].to_numpy(), max(1, -(-asked_rows // ASKED))
    spark = visit.sparkSession
    names = spark.createDataFrame(pieces[["ring", "share", "piece", "unit"]])
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = index.rows.join(small(names), ["ring", "share"]).select("id", "x", "piece", F.col("unit").cast("long").alias("unit"), block.alias("block"))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for asked_id, ax, rings in zip(f["asked_id"], f["ax"], f["rings"], strict=True):
                own = np.concatenate([of_ring[r] for r in rings]) if len(rings) else np.zeros(0, dtype=int)
                out += [(asked_id, ax, int(u), own[unit_of[own] == u].tolist()) for u in np.unique(unit_of[own])]
            yield pd.DataFrame(out, columns=["asked_id", "ax", "unit", "pieces"])

    kind, id_kind = visit.schema["asked_id"].dataType.simpleString(), index.rows.schema["id"].dataType.simpleString()
    right = visit.mapInPandas(deal, f"asked_id {kind}, ax array<double>, unit long, pieces array<int>")
    right = right.withColumn("block", F.pmod(F.xxhash64("asked_id"), F.lit(blocks)).cast("int"))

    def compare(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"asked_id": [], "id": [], "d": []}
        if len(rows) and len(asked):
            x, ids, piece = np.stack(rows["x"].to_numpy()), rows["id"].to_numpy(), rows["piece"].to_numpy()
            places = {p: np.flatnonzero(piece == p) for p in np.unique(piece)}
            many = max(1, HELD // len(x))
            for at in range(0, len(asked), many):
                part = asked.iloc[at : at + many]
                look: dict[int, list[int]] = {}
                for i, own in enumerate(part["pieces"]):
                    for p in own:
                        look.setdefault(int(p), []).append(i)
                seen = [p for p in look if p in places]
                names = part["asked_id"].to_numpy()
                for i, near, d in nearest_of(np.stack(part["ax"].to_numpy()), x, ids, k, [np.array(look[p]) for p in seen], [places[p] for p in seen]):
                    out["asked_id"].append(np.repeat(names[i : i + 1], len(near)))
                    out["id"].append(ids[near])
                    out["d"].append(d)
        return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in out.items()})

    tasks = blocks * (int(unit_of.max()) + 1)
    both = left.repartition(tasks, "unit", "block").groupBy("unit", "block").cogroup(right.repartition(tasks, "unit", "block").groupBy("unit", "block"))
    return best(both.applyInPandas(compare, f"asked_id {kind}, id {id_kind}, d double"), k)


def best(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("asked_id").orderBy("d", "id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def k_nearest(rows: DataFrame, asked: DataFrame, k: int, *, id_col: str = "id", x_col: str = "x", asked_id: str = "id", asked_x: str = "x", others: bool = False, index: Index | None = None, **options: int) -> DataFrame:
    """(asked_id, id, d) of the k rows nearest to each asked row by Euclidean distance, of equals those of least id; with others, an asked row's own id is no answer.

    Asked rows with a null in their vector have no answer.
    """
    index = index or build(rows, id_col, x_col, **options)
    a = asked.select(F.col(asked_id).alias("asked_id"), F.col(asked_x).cast("array<double>").alias("ax")).filter(F.col("ax").isNotNull() & ~F.exists("ax", lambda v: v.isNull() | F.isnan(v)))
    if not len(index.rings):
        return a.join(index.rows, F.lit(False)).select("asked_id", "id", F.lit(0.0).alias("d"))
    a = cut(a)
    most = k + 1 if others else k
    n = a.count()
    first = cut(meet(index, visited(index, a, most, False), most, n))
    reach = first.groupBy("asked_id").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d")).select("asked_id", F.when(F.col("n") >= most, F.col("d") * (1 + SLACK) + SLACK).alias("within"))
    second = meet(index, visited(index, a.join(small(reach), "asked_id", "left"), most, True), most, n)
    found = first.unionByName(second)
    return best(found.filter("id <> asked_id") if others else found, k)


def visited_share(index: Index, asked: DataFrame, k: int, found: DataFrame, *, asked_id: str = "id", asked_x: str = "x") -> float:
    """The share of (asked row, row) pairs whose distance a search looks at, given its result."""
    a = asked.select(F.col(asked_id).alias("asked_id"), F.col(asked_x).cast("array<double>").alias("ax"))
    reach = found.groupBy("asked_id").agg(F.max("d").alias("d")).select("asked_id", (F.col("d") * (1 + SLACK) + SLACK).alias("within"))
    sizes = a.sparkSession.createDataFrame(index.rings[["ring", "n"]])
    seen = visits(index, a, k, False).unionByName(visits(index, a.join(reach, "asked_id"), k, True))
    looked = seen.join(F.broadcast(sizes), "ring").agg(F.sum("n")).first()[0]
    return float(looked) / (float(index.rings["n"].sum()) * a.count())
