"""Boosting on quantile loss: trees on histograms of binned features, leaves refilled by the quantiles of what is left.

Features are binned once by their quantiles. A round grows one tree for each level, a depth at a time: each task counts its
rows, and those below their prediction, by level, node, feature and bin, in arrays of levels * nodes * features * bins
counts, whatever the table holds; they give the sums of the loss's gradient from which the splits are chosen. A leaf then moves its rows towards
the level's quantile of their residuals, which is what lowers quantile loss. All levels go through one pass.

Defined results: rows with a null label are left out of the fit; a null feature is in its first bin; without rows every
prediction is null; quantiles of a row are sorted, so that they never cross.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.shared import cut, release


@dataclass
class Tree:
    """Node n has children 2n + 1 and 2n + 2. splits: node -> (feature, bin): rows of a bin up to it go left; values: leaf -> step."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def node(self, bins: Column | Sequence[Column]) -> Column:
        """The leaf of a row with these bins."""

        return self.of_leaf(bins, F.lit)

    def value(self, bins: Column | Sequence[Column]) -> Column:
        """The step of the leaf of a row with these bins."""
        return self.of_leaf(bins, lambda n: F.lit(float(self.values.get(n, 0.0))))

    def of_leaf(self, bins: Column | Sequence[Column], result: Callable[[int], Column]) -> Column:
        def at(n: int) -> Column:
            if n not in self.splits:
                return result(n)
            f, b = self.splits[n]
            return F.when(bins[f] <= b, at(2 * n + 1)).otherwise(at(2 * n + 2))

        return at(0)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), dtype=np.int64)
        for n in sorted(self.splits):
            own = np.flatnonzero(at == n)
            f, b = self.splits[n]
            at[own] = np.where(bins[own, f] <= b, 2 * n + 1, 2 * n + 2)
        return at

    def apply(self, bins: np.ndarray) -> np.ndarray:
        at = self.leaves(bins)
        return np.array([self.values.get(n, 0.0) for n in range(int(at.max(initial=0)) + 1)])[at]


@dataclass
class Boosted:
    """The fitted model; of a size that the parameters bound."""

    features: list[str]
    levels: list[float]
    edges: list[list[float]]
    start: list[float] | None
    rate: float
    rounds: list[list[Tree]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Predictions by level, sorted within each row."""
        if self.start is None:
            return np.full((len(x), len(self.levels)), np.nan)
        bins = np.stack([np.where(np.isnan(x[:, j]), 0, np.searchsorted(e, x[:, j], side="left")) for j, e in enumerate(self.edges)], axis=1)
        out = np.tile(np.array(self.start, dtype=float), (len(x), 1))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[:, k] += self.rate * tree.apply(bins)
        order = np.argsort(np.argsort(self.levels))
        return np.sort(out, axis=1)[:, order]

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with q_<level> for each level."""
        model = self

        @F.pandas_udf("array<double>")
        def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for cols in parts:
                yield pd.Series(list(model.raw(np.stack([c.to_numpy(dtype=float, na_value=np.nan) for c in cols], axis=1))))

        scored = rows.withColumn("_q", score(*[F.col(f).cast("double") for f in self.features]))
        return scored.withColumns({f"q_{q}": F.nanvl(F.get("_q", k), F.lit(None)) for k, q in enumerate(self.levels)}).drop("_q")


def binned(x: Column, edges: Sequence[float]) -> Column:
    """How many edges lie below x; 0 for null."""
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < x)), F.lit(0)) if edges else F.lit(0)


def best_splits(sums: pd.DataFrame, levels: int, least: int) -> list[dict[int, tuple[int, int]]]:
    """For each level, node -> (feature, bin) of the split that lowers squared gradients most, with `least` rows on both sides."""
    out: list[dict[int, tuple[int, int]]] = [{} for _ in range(levels)]
    for (level, node), own in sums.groupby(["level", "node"]):
        found = (1e-12, 0, 0)
        for f, part in own.sort_values("bin").groupby("feature"):
            g, n, bins = np.cumsum(part["g"].to_numpy()), np.cumsum(part["n"].to_numpy()), part["bin"].to_numpy()
            left, right = n[:-1], n[-1] - n[:-1]
            gain = np.where((left >= least) & (right >= least), g[:-1] ** 2 / np.maximum(left, 1) + (g[-1] - g[:-1]) ** 2 / np.maximum(right, 1) - g[-1] ** 2 / n[-1], 0.0)
            if len(gain) and gain.max() > found[0] * (1 + 1e-12):
                found = (float(gain.max()), int(f), int(bins[gain.argmax()]))
        if found[0] > 1e-12:
            out[int(level)][int(node)] = found[1:]
    return out


def counts(state: DataFrame, trees: list[Tree], depth: int, features: int, bins: int) -> DataFrame:
    """(level, node, feature, bin, n, below): rows of (y, b0.., p0..) in the nodes of this depth, and those of them whose y is below the prediction."""
    first, nodes = 2**depth - 1, 2**depth
    size = nodes * features * bins

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, below = (np.zeros((len(trees), size), dtype=np.int64) for _ in range(2))
        for b in batches:
            y, x = b.column("y").to_numpy(), np.stack([b.column(f"b{f}").to_numpy() for f in range(features)], axis=1)
            for j, tree in enumerate(trees):
                at = tree.leaves(x)
                own = np.flatnonzero(at >= first)
                low = (y < b.column(f"p{j}").to_numpy())[own]
                for f in range(features):
                    place = ((at[own] - first) * features + f) * bins + x[own, f]
                    n[j] += np.bincount(place, minlength=size)
                    below[j] += np.bincount(place[low], minlength=size)
        level, place = np.nonzero(n)
        columns = [level, place // (features * bins) + first, place // bins % features, place % bins, n[level, place], below[level, place]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["level", "node", "feature", "bin", "n", "below"])

    each = state.mapInArrow(go, "level long, node long, feature long, bin long, n long, below long")
    return each.groupBy("level", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("below").alias("below"))


def pinball(y: Column, prediction: Column, levels: Sequence[float]) -> Column:
    """The mean quantile loss of an array of predictions."""
    parts = [F.when(y >= F.get(prediction, k), q * (y - F.get(prediction, k))).otherwise((q - 1) * (y - F.get(prediction, k))) for k, q in enumerate(levels)]
    return sum(parts[1:], parts[0]) / len(parts)


def fit_quantiles(train: DataFrame, features: list[str], label: str, levels: Sequence[float], *, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 20, valid: DataFrame | None = None, patience: int = 8) -> Boosted:
    """With valid rows, rounds end when the loss on them hasn't fallen for `patience` rounds, and those after the best are dropped."""
    levels = list(levels)
    cols = [F.col(f).cast("double") for f in features]
    y = F.col(label).cast("double")
    known = train.filter(y.isNotNull())
    edges = [sorted(set(e)) for e in known.approxQuantile(features, [k / bins for k in range(1, bins)], 0.25 / bins)] if features else []
    edges = edges or [[] for _ in features]
    first = known.agg(F.percentile_approx(y, levels, 10_000).alias("q")).first()["q"]
    model = Boosted(list(features), levels, edges, first, rate)
    if first is None:
        return model

    bs, ps = [F.col(f"b{f}") for f in range(len(features))], [F.col(f"p{j}") for j in range(len(levels))]

    def prepared(rows: DataFrame) -> DataFrame:
        at = [binned(c, e).cast("int").alias(f"b{f}") for f, (c, e) in enumerate(zip(cols, edges, strict=True))]
        return cut(rows.filter(y.isNotNull()).select(y.alias("y"), *at, *[F.lit(float(v)).alias(f"p{j}") for j, v in enumerate(first)]))

    state, held, best = prepared(known), prepared(valid) if valid is not None else None, (float("inf"), 0)
    for k in range(rounds):
        trees = [Tree() for _ in levels]
        for d in range(depth if features else 0):
            sums = counts(state, trees, d, len(features), max(map(len, edges)) + 1).toPandas()
            sums["g"] = np.array(levels)[sums["level"]] * sums["n"] - sums["below"]
            for tree, splits in zip(trees, best_splits(sums, len(levels), least), strict=True):
                tree.splits |= splits
        leaves = F.array(*[F.struct(F.lit(j).alias("level"), t.node(bs).alias("node"), (F.col("y") - ps[j]).alias("left")) for j, t in enumerate(trees)])
        steps = state.select(F.explode(leaves).alias("n")).select("n.*").groupBy("level", "node").agg(F.percentile_approx("left", levels, 10_000).alias("q")).collect()
        for r in steps:
            trees[r["level"]].values[r["node"]] = r["q"][r["level"]]
        model.rounds.append(trees)
        moved = {f"p{j}": ps[j] + rate * t.value(bs) for j, t in enumerate(trees)}
        state, old = cut(state.withColumns(moved)), state
        release(old)
        if held is not None:
            held, old = cut(held.withColumns(moved)), held
            release(old)
            loss = held.agg(F.avg(pinball(F.col("y"), F.array(*ps), levels))).first()[0]
            model.losses.append(loss)
            if loss is not None and loss < best[0]:
                best = (loss, k + 1)
            elif k + 1 - best[1] >= patience:
                break
    if held is not None and best[1]:
        del model.rounds[best[1] :]
    return model
