"""Exponential smoothing with level, trend and season (additive), for all series and a grid of parameters at once.

One step is an affine map of the state and adds a quadratic form of it to the squared errors, so that a block of a
series sums up to (A, c) and (Q, r, z) for each set of parameters: state -> A state + c, errors += state'Q state + 2 r'state + z.
Blocks are summed up where they lie and folded in order, one series a group of as many rows as it has blocks.

Defined results: rows with a null value or time are no steps; steps follow each other by time, gaps are no steps, and a
season's place is the step's time modulo the period; a series of one value forecasts it; of equal errors the first set of
parameters is taken; an empty table gives an empty result. Times repeat in no series.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shares of an error that go to level, trend and season.
GRID = tuple(product((0.1, 0.3, 0.6), (0.0, 0.05), (0.0, 0.1, 0.3)))


def block_sums(y: np.ndarray, place: np.ndarray, period: int, grid: np.ndarray) -> tuple[np.ndarray, ...]:
    """(A, c, Q, r, z) of a block's steps for each row (alpha, beta, gamma) of grid; the state is level, trend and the period's seasons."""
    n, d = len(grid), 2 + period
    a, c = np.broadcast_to(np.eye(d), (n, d, d)).copy(), np.zeros((n, d))
    q, r, z = np.zeros((n, d, d)), np.zeros((n, d)), np.zeros(n)
    for value, j in zip(y, place + 2, strict=True):
        # error = value - (level + trend + season) as a row e of the state before the block, and a constant
        e, k = -(a[:, 0] + a[:, 1] + a[:, j]), value - (c[:, 0] + c[:, 1] + c[:, j])
        q += e[:, :, None] * e[:, None, :]
        r += e * k[:, None]
        z += k * k
        a[:, 0] += a[:, 1] + grid[:, :1] * e
        c[:, 0] += c[:, 1] + grid[:, 0] * k
        a[:, 1] += grid[:, 1:2] * e
        c[:, 1] += grid[:, 1] * k
        a[:, j] += grid[:, 2:] * e
        c[:, j] += grid[:, 2] * k
    return a, c, q, r, z


def fold(blocks: Sequence[tuple[np.ndarray, ...]], first: float, period: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(states, squared errors) after the blocks, in order, from level `first` without trend and season."""
    state, errors = np.zeros((n, 2 + period)), np.zeros(n)
    state[:, 0] = first
    for a, c, q, r, z in blocks:
        errors += np.einsum("ni,nij,nj->n", state, q, state) + 2 * (r * state).sum(1) + z
        state = np.einsum("nij,nj->ni", a, state) + c
    return state, errors


def fit(series: DataFrame, key: str, time: str, y: str, *, period: int = 7, grid: Sequence[tuple[float, float, float]] = GRID, block: int = 4096) -> DataFrame:
    """(key, alpha, beta, gamma, sse, n, last_time, level, trend, season array): the best set of the grid for each series, and its state at the end.

    time is an integer (days since some day, hours, ...); a block holds the steps of `block` units of it.
    """
    sets, d = np.array(grid, dtype=float), 2 + period
    rows = series.filter(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(y).isNotNull())
    rows = rows.select(F.col(key).alias("key"), F.col(time).cast("long").alias("t"), F.col(y).cast("double").alias("y")).withColumn("block", F.floor(F.col("t") / block))

    def sum_up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        parts = block_sums(pdf["y"].to_numpy(), pdf["t"].to_numpy() % period, period, sets)
        flat = np.concatenate([p.reshape(-1) for p in parts])
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "block": [pdf["block"].iloc[0]], "n": [len(pdf)], "first": [pdf["y"].iloc[0]], "last_t": [pdf["t"].iloc[-1]], "sums": [flat]})

    kind = rows.schema["key"].dataType.simpleString()
    blocks = rows.groupBy("key", "block").applyInPandas(sum_up, f"key {kind}, block long, n long, first double, last_t long, sums array<double>")
    shapes = [(len(sets), d, d), (len(sets), d), (len(sets), d, d), (len(sets), d), (len(sets),)]
    cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        parts = [[p.reshape(s) for p, s in zip(np.split(np.asarray(v), cuts), shapes, strict=True)] for v in pdf["sums"]]
        states, errors = fold(parts, pdf["first"].iloc[0], period, len(sets))
        best = int(np.flatnonzero(errors <= errors.min() * (1 + 1e-9))[0])
        alpha, beta, gamma = sets[best]
        return pd.DataFrame({key: [pdf["key"].iloc[0]], "alpha": alpha, "beta": beta, "gamma": gamma, "sse": errors[best], "n": int(pdf["n"].sum()), "last_time": pdf["last_t"].iloc[-1], "level": states[best, 0], "trend": states[best, 1], "season": [states[best, 2:]]})

    return blocks.groupBy("key").applyInPandas(choose, f"{key} {kind}, alpha double, beta double, gamma double, sse double, n long, last_time long, level double, trend double, season array<double>")


def forecast(models: DataFrame, key: str, horizon: int, period: int = 7) -> DataFrame:
    """(key, step from 1, time, yhat) of the `horizon` steps after each series' last time."""
    rows = models.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("time", F.col("last_time") + F.col("step"))
    yhat = F.col("level") + F.col("step") * F.col("trend") + F.element_at("season", (F.pmod(F.col("time"), F.lit(period)) + 1).cast("int"))
    return rows.select(key, "step", "time", yhat.alias("yhat"))
