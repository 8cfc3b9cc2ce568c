"""Forecasts where data is scarce: hierarchical priors, similar routes, and blending towards own data."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions import exprs as X
from stowage.functions.bounds import against
from stowage.operators.neighbours import k_nearest, unit_vector

#: Asked rows and rows that meet as one block of a similarity matrix, asked rows that a task holds, and rows that it gives at once.
ASKED, ROUTES, HELD, GIVEN = 512, 4096, 16_384, 262_144
#: Units of rows that even few rows may be dealt to, so that a matrix has tasks enough.
UNITS = 64


def priors(rows: DataFrame, value: str, tier: str = "tier", station: str = "station") -> DataFrame:
    """Mean, sample variance and count over all, by tier and by station, in one pass over grouping sets."""
    view = rows.select(F.col(tier).alias("tier"), F.col(station).alias("station"), F.col(value).alias("v"))
    out = view.groupingSets([[], ["tier"], ["station"]], "tier", "station").agg(F.grouping_id().alias("g"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"), F.count("v").alias("n"))
    return out.withColumn("level", F.when(F.col("g") == 3, "global").when(F.col("g") == 1, "tier").otherwise("station")).drop("g")


def prior_of(keys: DataFrame, table: DataFrame) -> DataFrame:
    """Each (station, tier) with its station's prior if there is one, else its tier's, else the global one, else (0, 100)."""
    s = table.filter("level = 'station'").select("station", F.struct("mean", "var", "n").alias("s"))
    t = table.filter("level = 'tier'").select("tier", F.struct("mean", "var", "n").alias("t"))
    g = table.filter("level = 'global'").select("level", F.struct("mean", "var", "n").alias("g"))
    rows = keys.join(s, "station", "left").join(t, "tier", "left").withColumn("level", F.lit("global")).join(g, "level", "left")
    none = F.struct(F.lit(0.0).alias("mean"), F.lit(100.0).alias("var"), F.lit(0).cast("long").alias("n"))
    return rows.withColumn("p", F.coalesce("s", "t", "g", none)).select("station", "tier", F.col("p.mean").alias("prior_mean"), F.col("p.var").alias("prior_var"))


def posterior(prior_mean: Column, prior_var: Column, n: Column, mean: Column, var: Column) -> tuple[Column, Column]:
    """Normal-normal update by n observations of this mean and population variance; one observation has the prior's variance."""
    floor = F.lit(1e-6)
    pv = F.greatest(prior_var, floor)
    dv = F.when(n > 1, F.greatest(var, floor)).otherwise(pv)
    post = 1 / (1 / pv + n / dv)
    return F.when(n > 0, post * (prior_mean / pv + n * mean / dv)).otherwise(prior_mean), F.when(n > 0, post).otherwise(prior_var)


def route_vector(r: dict[str, Column]) -> Column:
    """Eight features of a route: tiers (hub 0, focus 1, else 2), distance, duration, wide-body share, international, purpose (business 0, leisure 1, else 2), log frequency."""
    tier = lambda c: F.when(c == "hub", 0.0).when(c.isin("focus", "focus_city"), 1.0).otherwise(2.0)
    purpose = F.when(r["purpose"] == "business", 0.0).when(r["purpose"] == "leisure", 1.0).otherwise(2.0)
    return F.array(tier(r["origin_tier"]), tier(r["destination_tier"]), r["distance_km"] / 5000, r["hours"] / 12, r["widebody"], r["international"].cast("double"), purpose, F.log1p(r["flights_per_day"]))


def register_routes(routes: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """(id, x) of routes with their features; a route that is registered again replaces its entry in keep."""
    names = ["origin_tier", "destination_tier", "distance_km", "hours", "widebody", "international", "purpose", "flights_per_day"]
    new = routes.select("id", route_vector({n: F.col(n) for n in names}).alias("x"))
    return new if keep is None else keep.join(new.select("id"), "id", "left_anti").unionByName(new)


def similar(new: DataFrame, known: DataFrame, k: int = 5, kernel: str = "rbf", bandwidth: float = 1.0, **index: int) -> DataFrame:
    """(id, other, weight): the k most similar of known for each of new, weights summing to 1.

    All kernels fall with a distance (of cosine: that of the vectors at length 1), so a metric index finds them.
    """
    place = unit_vector if kernel == "cosine" else lambda x: x
    x = lambda df, *names: df.select(*names, place(F.col("x").cast("array<double>")).alias("x"))
    near = k_nearest(x(known, "id"), x(new, "id"), k, others=True, **index)
    pairs = near.select(F.col("asked_id").alias("id"), F.col("id").alias("other")).join(new.select("id", "x"), "id").join(known.select(F.col("id").alias("other"), F.col("x").alias("ox")), "other")
    top = pairs.withColumn("s", X.similarity(F.col("x"), F.col("ox"), kernel, bandwidth))
    total = F.sum("s").over(Window.partitionBy("id"))
    return top.select("id", "other", F.when(total > 0, F.col("s") / total).otherwise(F.col("s")).alias("weight"))


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products of paired rows, added from the first component to the last as the expression does."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def half_up(s: np.ndarray, digits: int) -> np.ndarray:
    """Rounded by their decimal digits, as Spark rounds doubles; not finite values stay."""
    return np.array([float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) if np.isfinite(v) else v for v in s.tolist()]) + 0.0


def cosines(a: np.ndarray, b: np.ndarray, digits: int) -> np.ndarray:
    """Cosine similarities of all rows of a and b, rounded; 0 for a row without length.

    A matrix product gives them but for the last bits. Values that lie so near a tie that those bits could turn it, and
    rows of extreme length, are computed anew in the order of their components.
    """
    na, nb = np.sqrt(in_order(a, a)), np.sqrt(in_order(b, b))
    with np.errstate(all="ignore"):
        s = (a @ b.T) / (na[:, None] * nb[None, :])
        scaled = np.abs(s) * 10.0**digits
        whole = np.floor(scaled + 0.5)
        plain = lambda n: (n > 1e-100) & (n < 1e100)
        anew = ~plain(na)[:, None] | ~plain(nb)[None, :] | ~(np.abs(scaled - np.floor(scaled) - 0.5) > 1e-6)
        out = np.copysign(whole / 10.0**digits, s) + 0.0
        i, j = np.nonzero(anew)
        length = na[i] * nb[j]
        out[i, j] = half_up(np.where(length == 0, 0.0, in_order(a[i], b[j]) / length), digits)
    return out


def stacked(x: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The vectors of a column by their number of components: (places, rows); vectors that are null or hold a null are in none."""
    sizes = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)
    flat = x.flatten()
    begins = np.cumsum(sizes) - sizes
    nulls = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    whole = x.is_valid().to_numpy(zero_copy_only=False) & (nulls[begins + sizes] == nulls[begins])
    values = flat.to_numpy(zero_copy_only=False)
    return [(at, values[begins[at][:, None] + np.arange(n)]) for n in np.unique(sizes[whole]) for at in [np.flatnonzero(whole & (sizes == n))]]


def dealt(asked: int, routes: int) -> tuple[int, int]:
    """(groups of asked rows, units of rows) of a similarity matrix: each row is sent once a group, each asked row once a unit.

    Beyond UNITS there are no more units than let the asked rows' copies weigh as much as the rows', so that what is sent
    grows as the tables do as long as asked rows are one group.
    """
    across = max(1, -(-asked // HELD))
    return across, min(max(1, -(-routes // ROUTES)), max(UNITS, across * routes // max(1, asked)))


def block(ids: tuple[pa.Array, pa.Array], x: tuple[pa.Array, pa.Array], digits: int) -> Iterator[pa.RecordBatch]:
    """Pairs of asked rows and rows in the order of their similarity: equal values then lie together, also on a disk."""
    out = np.zeros((len(ids[0]), len(ids[1])))
    rows = [stacked(v) for v in x]
    for at, ax in rows[0]:
        for of, bx in rows[1]:
            if ax.shape[1] == bx.shape[1]:
                out[np.ix_(at, of)] = cosines(ax, bx, digits)
    codes = pa.concat_arrays(list(ids)).dictionary_encode().indices.to_numpy()
    same = codes[: out.shape[0], None] == codes[None, out.shape[0] :]
    values = out.ravel()
    order = np.argsort(values)
    if same.any():
        order = order[~same.ravel()[order]]
    for begin in range(0, len(order), GIVEN):
        part = order[begin : begin + GIVEN]
        i, j = np.divmod(part.astype(np.int32), np.int32(out.shape[1]))
        yield pa.RecordBatch.from_arrays([ids[0].take(pa.array(i)), ids[1].take(pa.array(j)), pa.array(values[part])], names=["a", "b", "similarity"])


def cosine_matrix(asked: DataFrame, routes: DataFrame, digits: int) -> DataFrame:
    """Groups of asked rows meet units of all rows as matrices, in blocks of ASKED by ROUTES rows.

    A task holds a group's asked rows (about HELD at most) while the unit's rows stream by, and gives a block before it takes
    the next, so its memory doesn't depend on the number of pairs.
    """
    x = F.col("x").cast("array<double>").alias("x")
    kinds = [df.schema["id"].dataType.simpleString() for df in (asked, routes)]
    asked, routes = (df.filter("id IS NOT NULL").select("id", x) for df in (asked, routes))
    across, down = dealt(asked.count(), routes.count())
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id", "x"), F.lit(n)).cast("int")
    none = lambda k: F.lit(None).cast(kinds[k])
    left = asked.select(F.lit(0).alias("side"), F.col("id").alias("a"), none(1).alias("b"), "x", own(across).alias("i"), every(down).alias("j"))
    right = routes.select(F.lit(1).alias("side"), none(0).alias("a"), F.col("id").alias("b"), "x", every(across).alias("i"), own(down).alias("j"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meeting, held = None, []
        for b in batches:
            place = np.column_stack([b.column(k).to_numpy() for k in (0, 1)])
            ends = np.r_[np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1, len(place)]
            for begin, end in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                if begin == end:
                    continue
                (now, side), part = place[begin].tolist(), b.slice(begin, end - begin)
                if now != meeting:
                    meeting, held = now, []
                if side == 0:
                    held += [part.slice(k, ASKED) for k in range(0, len(part), ASKED)]
                    continue
                for k in range(0, len(part), ROUTES):
                    some = part.slice(k, ROUTES)
                    for few in held:
                        yield from block((few.column(2), some.column(3)), (few.column(4), some.column(4)), digits)

    both = left.unionByName(right).select((F.col("i") * down + F.col("j")).alias("meeting"), "side", "a", "b", "x")
    both = both.repartitionById(min(across * down, 10_000), "meeting").sortWithinPartitions("meeting", "side")
    return both.mapInArrow(go, f"a {kinds[0]}, b {kinds[1]}, similarity double")


def similarity_matrix(asked: DataFrame, routes: DataFrame, kernel: str = "rbf", bandwidth: float = 1.0, *, digits: int | None = None) -> DataFrame:
    """(a, b, similarity): the matrix rows of the asked routes, against all others; the diagonal is 1. With digits, similarities are rounded to so many, and cosines are taken by matrices."""
    if kernel == "cosine" and digits is not None:
        return cosine_matrix(asked, routes, digits)
    pairs = against(asked.select(F.col("id").alias("a"), F.col("x").alias("ax")), routes.select(F.col("id").alias("b"), F.col("x").alias("bx")))
    s = X.similarity(F.col("ax"), F.col("bx"), kernel, bandwidth)
    return pairs.filter(F.col("a") != F.col("b")).select("a", "b", (s if digits is None else F.round(s, digits)).alias("similarity"))


def transfer(weights: DataFrame, forecasts: DataFrame, scale: float = 1.0) -> DataFrame:
    """Weighted mean forecast of the similar ones: forecasts (other, step, yhat)."""
    return weights.join(forecasts, "other").groupBy("id", "step").agg((scale * F.sum(F.col("weight") * F.col("yhat"))).alias("yhat"))


def blend(n: Column, own: Column, prior_mean: Column, prior_var: Column, full: int = 30) -> dict[str, Column]:
    """Own forecast weighs min(1, n / full); the band shrinks with the prior's part."""
    w = F.least(F.lit(1.0), n / full)
    mid = w * F.coalesce(own, F.lit(0.0)) + (1 - w) * prior_mean
    half = 1.96 * F.sqrt(prior_var * (1 - w) * (1 - w))
    return {"weight": w, "yhat": mid, "lower": mid - half, "upper": mid + half}
