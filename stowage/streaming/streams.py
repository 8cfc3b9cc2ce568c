"""Structured Streaming: the same rules as in batch, over events as they come."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stowage.operators.anomaly import CusumState, RunLengths
from stowage.sources.deltas import DeltaTable

PINGS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def pings(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(PINGS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def latest_positions(stream: DataFrame) -> DataFrame:
    """Each asset's position of the highest event time, whatever the order of arrival; for update or complete mode."""
    return stream.groupBy(F.col("user_id").alias("uld_id")).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("last")).select("uld_id", F.col("last.event_type").alias("station"), F.col("last.ts").alias("ts"))


def windowed(stream: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "24 hours") -> DataFrame:
    """Counts and sums by event time; the watermark lets a day's late pings in."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def once(stream: DataFrame, late: str = "24 hours") -> DataFrame:
    """Each ping once, also if it is sent again within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def with_flights(stream: DataFrame, flight_events: DataFrame, within: str = "6 hours", late: str = "24 hours") -> DataFrame:
    """Pings with the flight events of the same asset up to `within` before."""
    p = stream.withWatermark("ts", late)
    f = flight_events.select(F.col("user_id").alias("f_user"), F.col("ts").alias("f_ts"), F.col("event_type").alias("flight_event")).withWatermark("f_ts", late)
    return p.join(f, (F.col("user_id") == F.col("f_user")) & (F.col("f_ts") <= F.col("ts")) & (F.col("f_ts") >= F.col("ts") - F.expr(f"INTERVAL {within}")))


def online_cusum(stream: DataFrame, mean: float, slack: float, limit: float) -> DataFrame:
    """CUSUM with resets per asset, in the order of each micro-batch's event times; the state is two numbers and a count."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up, down, seen = state.get if state.exists else (None, None, 0)
        own = CusumState(mean, slack, limit, up, down)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = [(key[0], i, seen + k, *own.update(v)) for k, (i, v) in enumerate(zip(rows["event_id"], rows["value"], strict=True), 1)]
        state.update((own.up, own.down, seen + len(out)))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "position", "up", "down", "side"])

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, position long, up double, down double, side string", "up double, down double, seen long", "append", GroupStateTimeout.NoTimeout)


def online_change_points(stream: DataFrame, *, hazard: float = 0.01, mean: float = 0.0, prior_var: float = 100.0, var: float = 1.0) -> DataFrame:
    """Probability of a change and expected run length per asset after each ping, in the order of each micro-batch's event times.

    The state is the pruned distribution of run lengths: four short arrays and a count.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own, seen = RunLengths(hazard, mean, prior_var, var), 0
        if state.exists:
            *parts, seen = state.get
            own.p, own.n, own.s, own.r = (np.array(v, dtype=float) for v in parts)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = [(key[0], i, seen + k, *own.update(v)) for k, (i, v) in enumerate(zip(rows["event_id"], rows["value"], strict=True), 1)]
        state.update((own.p.tolist(), own.n.tolist(), own.s.tolist(), own.r.tolist(), seen + len(out)))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "position", "p_change", "run_length"])

    kept = "p array<double>, n array<double>, s array<double>, r array<double>, seen long"
    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, position long, p_change double, run_length double", kept, "append", GroupStateTimeout.NoTimeout)


def fit_counts(stream: DataFrame, key: str = "user_id", warmup: int = 30) -> DataFrame:
    """Observations of each series so far, whether they suffice for a model of its own, and that model's weight; for update or complete mode."""
    n = F.col("observations")
    out = stream.groupBy(key).agg(F.count(F.lit(1)).alias("observations")).withColumn("fitted", n >= warmup)
    return out.withColumn("weight", F.when(F.col("fitted"), F.least(F.lit(1.0), n / float(warmup))).otherwise(0.0))


def upsert(table: DeltaTable):
    """A foreachBatch function that keeps the last row of each key: batch n writes what it changes as delta n. A batch that runs again replaces its delta, so the result is exact once."""
    return table.upsert
