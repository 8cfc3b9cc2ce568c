"""Change points and outliers, for all series at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Relative size of what rounding can add to a running sum.
ROUNDING = 1e-11


def cusum(rows: DataFrame, key: str, order: list[str], x: str, mean: float, slack: float, limit: float) -> DataFrame:
    """Both one-sided sums without resets, as running sums less their lowest point: up, down, alarm.

    Sums of doubles that equal the limit in decimals end on either side of it by the order of their additions; an alarm
    is a sum above the limit by more than that rounding.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumns({"_u": F.sum(F.col(x) - mean - slack).over(w), "_d": F.sum(mean - slack - F.col(x)).over(w)})
    zero = F.lit(0.0)
    out = out.withColumns({"up": F.col("_u") - F.least(zero, F.min("_u").over(w)), "down": F.col("_d") - F.least(zero, F.min("_d").over(w))})
    least = limit + ROUNDING * F.greatest(F.lit(abs(limit)), F.abs("_u"), F.abs("_d"))
    return out.withColumn("alarm", (F.col("up") > least) | (F.col("down") > least)).drop("_u", "_d")


class CusumState:
    """The same with the alarmed side reset to 0; used by batch groups and by streams.

    A series' first value has no sum to be added to and meets mean + slack and mean - slack: values of few decimals then
    round no more than once, where x - mean + slack would round twice.
    """

    def __init__(self, mean: float, slack: float, limit: float, up: float | None = None, down: float | None = None):
        self.mean, self.slack, self.limit, self.up, self.down = mean, slack, limit, up, down

    def update(self, x: float) -> tuple[float, float, str | None]:
        if self.up is None:
            self.up, self.down = max(0.0, x - (self.mean + self.slack)), max(0.0, self.mean - self.slack - x)
        else:
            self.up = max(0.0, self.up + x - self.mean - self.slack)
            self.down = max(0.0, self.down - (x - self.mean + self.slack))
        up, down = self.up, self.down
        side = "up" if up > self.limit else "down" if down > self.limit else None
        if up > self.limit:
            self.up = 0.0
        if down > self.limit:
            self.down = 0.0
        return up, down, side


def step_by_step(rows: DataFrame, key: str, order: list[str], x: str, begin: Callable[[], CusumState | RunLengths], given: str) -> DataFrame:
    """key, position and what the model that begin() makes anew for each series gives for each value.

    Rows go through Python sorted by series, many series in a batch and a series in as many batches as it fills; beside a
    batch a task holds one model. A call of Python for each series would take longer than the steps of short ones.
    """
    kind = rows.schema[key].dataType.simpleString()
    parts = [part.split() for part in given.split(", ")]
    types = [{"double": pa.float64(), "string": pa.string()}[t] for _, t in parts]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own, position = None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0)
            codes = (keys if last is None else pa.concat_arrays([last, keys])).dictionary_encode(null_encoding="encode").indices.to_numpy()
            first = np.r_[[True] if last is None else [], codes[1:] != codes[:-1]].astype(bool)
            last, at, out = keys.slice(b.num_rows - 1), [], []
            for new, v in zip(first.tolist(), b.column(1).to_numpy(zero_copy_only=False).tolist(), strict=True):
                if new:
                    own, position = begin(), 0
                position += 1
                at.append(position)
                out.append(own.update(v))
            columns = [pa.array(c, t, from_pandas=True) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([keys, pa.array(at, pa.int64()), *columns], names=[key, "position", *(n for n, _ in parts)])

    placed = rows.repartition(key).sortWithinPartitions(key, *[F.col(c).asc_nulls_last() for c in order])
    return placed.select(key, F.col(x).cast("double").alias("x")).mapInArrow(go, f"{key} {kind}, position long, {given}")


def cusum_with_reset(rows: DataFrame, key: str, order: list[str], x: str, mean: float, slack: float, limit: float) -> DataFrame:
    """key, position, up, down, side. A reset makes each step depend on the last, so a series lies in one task."""
    return step_by_step(rows.select(key, *order, x), key, order, x, lambda: CusumState(mean, slack, limit), "up double, down double, side string")


def zscore(rows: DataFrame, key: str, x: str, limit: float = 3.0) -> DataFrame:
    """Distance from the series' mean in population deviations of 1e-6 at least."""
    stats = rows.groupBy(key).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    out = rows.join(stats, key).withColumn("z", F.abs(F.col(x) - F.col("_m")) / F.greatest("_s", F.lit(1e-6)))
    return out.withColumn("outlier", F.col("z") > limit).drop("_m", "_s")


class RunLengths:
    """Bayesian online change points of a Gaussian mean with known variance; run lengths below `least` probability are dropped."""

    def __init__(self, hazard: float, mean: float, prior_var: float, var: float, least: float = 1e-6):
        self.hazard, self.mean, self.prior_var, self.var, self.least = hazard, mean, prior_var, var, least
        self.p, self.n, self.s, self.r = np.ones(1), np.zeros(1), np.zeros(1), np.zeros(1)

    def update(self, x: float) -> tuple[float, float]:
        """(probability that a run has just begun, expected run length) after x."""
        sd = np.sqrt(np.where(self.n == 0, self.prior_var, self.var))
        mu = (self.mean + self.s) / (1 + self.n)
        like = np.exp(-0.5 * ((x - mu) / sd) ** 2) / (sd * np.sqrt(2 * np.pi))
        grown = like * self.p
        p = np.concatenate([[(grown * self.hazard).sum()], grown * (1 - self.hazard)])
        total = p.sum()
        p = p / total if total > 0 else np.r_[1.0, np.zeros(len(p) - 1)]
        n, s, r = np.r_[0.0, self.n + 1], np.r_[0.0, self.s + x], np.r_[0.0, self.r + 1]
        n[0], s[0] = 1.0, x
        keep = p > self.least
        keep[0] = True
        self.p, self.n, self.s, self.r = p[keep], n[keep], s[keep], r[keep]
        self.p = self.p / self.p.sum()
        return float(self.p[0]), float((self.r * self.p).sum())


def change_points(rows: DataFrame, key: str, order: list[str], x: str, *, hazard: float = 0.01, mean: float = 0.0, prior_var: float = 100.0, var: float = 1.0) -> DataFrame:
    """key, position, p_change, run_length; the state of a series is pruned, so it stays small; a series lies in one task."""
    return step_by_step(rows.select(key, *order, x), key, order, x, lambda: RunLengths(hazard, mean, prior_var, var), "p_change double, run_length double")


def grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple:
    """An isolation tree: (feature, split, left, right) or the number of rows in a leaf."""
    lo, hi = x.min(0), x.max(0)
    usable = np.flatnonzero(hi > lo)
    if depth == 0 or len(x) <= 1 or not len(usable):
        return (len(x),)
    f = int(rng.choice(usable))
    split = float(rng.uniform(lo[f], hi[f]))
    left = x[:, f] < split
    return f, split, grow(x[left], depth - 1, rng), grow(x[~left], depth - 1, rng)


def expected_depth(n: int) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def depths(tree: tuple, x: np.ndarray, at: np.ndarray, out: np.ndarray, depth: int = 0) -> None:
    if len(tree) == 1:
        out[at] += depth + expected_depth(tree[0])
        return
    f, split, left, right = tree
    below = x[at, f] < split
    for side, part in ((left, at[below]), (right, at[~below])):
        if len(part):
            depths(side, x, part, out, depth + 1)


def isolation_scores(rows: DataFrame, features: list[str], *, keys: tuple[str, ...] = (), trees: int = 100, sample: int = 256, contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """rows with score (near 1 is odd) and outlier (the contamination's share of highest scores).

    Trees grow from a bounded sample of trees * sample rows, those of lowest hash of keys and features, so that with keys
    equal rows are drawn one by one; all rows are scored in their place.
    """
    few = rows.orderBy(F.xxhash64(*keys, *features)).select(*[F.col(f).cast("double") for f in features]).limit(trees * sample).toPandas().to_numpy()
    if not len(few):
        return rows.withColumns({"score": F.lit(None).cast("double"), "outlier": F.lit(None).cast("boolean")})
    rng = np.random.default_rng(seed)
    size = min(sample, len(few))
    deep = int(np.ceil(np.log2(max(2, size))))
    forest = [grow(few[rng.choice(len(few), size, replace=False)], deep, rng) for _ in range(trees)]
    scale = max(expected_depth(size), 1e-9)

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        total = np.zeros(len(x))
        for tree in forest:
            depths(tree, x, np.arange(len(x)), total)
        return pd.Series(2 ** (-total / trees / scale))

    scored = rows.withColumn("score", score(*[F.col(f).cast("double") for f in features]))
    cut = scored.agg(F.percentile_approx("score", 1 - contamination, 10000)).first()[0]
    return scored.withColumn("outlier", F.col("score") > cut)


def ensemble(flags: dict[str, tuple[str, str]]):
    """Columns of an OR of flags, the mean of scores clipped to 1, and the names of those that fired: {name: (flag, score)}."""
    any_flag = F.lit(False)
    for flag, _ in flags.values():
        any_flag = any_flag | F.coalesce(F.col(flag), F.lit(False))
    mean = sum((F.least(F.col(s), F.lit(1.0)) for _, s in flags.values()), F.lit(0.0)) / len(flags)
    names = F.array_compact(F.array(*[F.when(F.col(f), F.lit(n)) for n, (f, _) in flags.items()]))
    return {"is_anomaly": any_flag, "anomaly_score": mean, "reasons": names}
