"""Keyed state in the order of event time, whatever the order of arrival.

Each asset buffers its pings until the watermark has passed them; then they go through its model in order, so that a
stream gives what the batch operators give on the same rows. One event-time timer an asset wakes it: at its earliest
buffered ping, or, with none, when it has been silent for `idle`, at which its state goes. A ping that comes more than
`idle` after the one before starts a new session, whether or not the timer has already fired.

Defined results: pings without key, time or value are left out; equal times are ordered by event id; a ping that is sent
again within the watermark counts once; pings later than the watermark are dropped by Spark. State is held in RocksDB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from stowage.operators.anomaly import CusumState, RunLengths

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_MS = 3_600_000


def prepare(spark: SparkSession) -> None:
    """State with timers needs the RocksDB state store."""
    spark.conf.set(PROVIDER, ROCKS)


class Cusum:
    """CUSUM with resets as a model of a series: what it keeps and what it gives for each value."""

    kept, given = "up double, down double", "up double, down double, side string"

    def __init__(self, mean: float, slack: float, limit: float):
        self.parameters = (mean, slack, limit)

    def load(self, kept: tuple | None) -> CusumState:
        return CusumState(*self.parameters, *(kept or ()))

    def dump(self, own: CusumState) -> tuple:
        return own.up, own.down


class ChangePoints:
    """Run lengths of a Gaussian mean as a model of a series."""

    kept, given = "p array<double>, n array<double>, s array<double>, r array<double>", "p_change double, run_length double"

    def __init__(self, hazard: float = 0.01, mean: float = 0.0, prior_var: float = 100.0, var: float = 1.0):
        self.parameters = (hazard, mean, prior_var, var)

    def load(self, kept: tuple | None) -> RunLengths:
        own = RunLengths(*self.parameters)
        if kept is not None:
            own.p, own.n, own.s, own.r = (np.array(v, dtype=float) for v in kept)
        return own

    def dump(self, own: RunLengths) -> tuple:
        return tuple(v.tolist() for v in (own.p, own.n, own.s, own.r))


class Buffered(StatefulProcessor):
    """Holds a key's rows (us, event_id, held) back until the watermark has passed them, with one event-time timer for what comes next."""

    def __init__(self, held: str, kept: str):
        self.held, self.kept = held, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getMapState("buffer", "us long, event_id long", self.held)
        self.series = handle.getValueState("series", self.kept)
        self.alarm = handle.getValueState("alarm", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        for r in rows:
            self.buffer.updateValue((r["us"], r["event_id"]), (r["held"],))
        yield from self.advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.alarm.exists() and self.alarm.get()[0] == expiredTimerInfo.getExpiryTimeInMs():
            self.alarm.clear()
        yield from self.advance(key, timerValues.getCurrentWatermarkInMs())

    def taken(self, watermark: int) -> tuple[list[tuple], int | None]:
        """The rows that the watermark has passed, in order, out of the buffer; and the time in milliseconds of the first that is left."""
        waiting = sorted((us, i, v[0]) for (us, i), v in self.buffer.iterator())
        ready = [w for w in waiting if w[0] <= 1000 * watermark]
        for us, event, _ in ready:
            self.buffer.removeKey((us, event))
        return ready, -(-waiting[len(ready)][0] // 1000) if len(ready) < len(waiting) else None

    def wake(self, at: int | None) -> None:
        """Sets the key's one timer, or takes it away."""
        before = self.alarm.get()[0] if self.alarm.exists() else None
        if before == at:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if at is None:
            self.alarm.clear()
        else:
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def advance(self, key: tuple, watermark: int) -> Iterator[Row]:
        raise NotImplementedError


class InOrder(Buffered):
    """Gives (key, event_id, us, session, position, ...) of each row once the watermark has passed it."""

    def __init__(self, model: Cusum | ChangePoints, idle_ms: int, names: list[str]):
        super().__init__("value double", f"last_us long, session long, position long, {model.kept}")
        self.model, self.idle_ms, self.names = model, idle_ms, names

    def advance(self, key: tuple, watermark: int) -> Iterator[Row]:
        ready, following = self.taken(watermark)
        known = self.series.get() if self.series.exists() else None
        last, session, position = known[:3] if known else (None, 0, 0)
        if ready:
            own = self.model.load(known[3:] if known else None)
            for us, event, value in ready:
                if last is None or us - last > 1000 * self.idle_ms:
                    own, session, position = self.model.load(None), us, 0
                last, position = us, position + 1
                yield Row(**dict(zip(self.names, (key[0], event, us, session, position, *own.update(value)), strict=True)))
            self.series.update((last, session, position, *self.model.dump(own)))
        ends = None if last is None else last // 1000 + self.idle_ms + 1
        if following is None and ends is not None and ends <= watermark:
            self.series.clear()
            ends = None
        self.wake(ends if following is None else following)


def in_order(stream: DataFrame, model: Cusum | ChangePoints, *, key: str = "user_id", late: str = "24 hours", idle: int = 168 * HOUR_MS) -> DataFrame:
    """(key, event_id, ts, session, position, what the model gives) for each ping, in append mode, once it is `late` behind the latest one.

    session is the time of the session's first ping in microseconds; idle is in milliseconds.
    """
    prepare(stream.sparkSession)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = stream.filter(F.col(key).isNotNull() & F.col("ts").isNotNull() & F.col("value").isNotNull() & F.col("event_id").isNotNull())
    rows = rows.withWatermark("ts", late).select(key, "ts", "event_id", us.alias("us"), F.col("value").cast("double").alias("held"))
    out = f"{key} {stream.schema[key].dataType.simpleString()}, event_id long, us long, session long, position long, {model.given}"
    names = [part.split()[0] for part in out.split(", ")]
    done = rows.groupBy(key).transformWithState(InOrder(model, idle, names), out, "append", "EventTime")
    return done.select(key, "event_id", F.timestamp_micros("us").alias("ts"), *names[3:])


def sessions_of(rows: DataFrame, key: str = "user_id", idle: int = 168 * HOUR_MS) -> DataFrame:
    """The sessions that in_order works by, in batch: rows with session (microseconds of its first ping)."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    begins = F.coalesce(us - F.lag(us).over(w) > 1000 * idle, F.lit(True))
    return rows.withColumn("_b", F.when(begins, us)).withColumn("session", F.last("_b", ignorenulls=True).over(w)).drop("_b")


class Newest(StatefulProcessor):
    """The newest (us, event_id, station) of a key; gives a row only where it moves on. Its state goes after a time without pings."""

    def __init__(self, key: str, ttl_ms: int):
        self.key, self.ttl_ms = key, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "us long, event_id long, station string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        known = tuple(self.newest.get()) if self.newest.exists() else None
        top = max([(r["us"], r["event_id"], r["station"]) for r in rows] + ([known] if known else []), key=lambda t: t[:2])
        self.newest.update(top)
        if known is None or top[:2] > known[:2]:
            yield Row(**{self.key: key[0], "event_id": top[1], "us": top[0], "station": top[2]})


def newest_positions(stream: DataFrame, *, key: str = "user_id", ttl: int = 168 * HOUR_MS) -> DataFrame:
    """Each move of an asset's newest position (key, event_id, ts, station); pings that come late move nothing. State goes `ttl` milliseconds of clock time after the last ping."""
    prepare(stream.sparkSession)
    rows = stream.filter(F.col(key).isNotNull() & F.col("ts").isNotNull() & F.col("event_id").isNotNull())
    rows = rows.select(key, "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_type").alias("station"))
    out = f"{key} {stream.schema[key].dataType.simpleString()}, event_id long, us long, station string"
    done = rows.groupBy(key).transformWithState(Newest(key, ttl), out, "update", "ProcessingTime")
    return done.select(key, "event_id", F.timestamp_micros("us").alias("ts"), "station")


class Cadence(Buffered):
    """Gives a row for each silence of more than a time, once the watermark has passed its end."""

    def __init__(self, key: str, every_ms: int):
        super().__init__("station string", "us long, station string")
        self.key, self.every_ms = key, every_ms

    def advance(self, key: tuple, watermark: int) -> Iterator[Row]:
        ready, following = self.taken(watermark)
        last = tuple(self.series.get()) if self.series.exists() else None
        missed = lambda us, station: Row(**{self.key: key[0], "last_us": us, "station": station, "due_ms": us // 1000 + self.every_ms})
        for us, _, station in ready:
            if last and us - last[0] > 1000 * self.every_ms:
                yield missed(*last)
            last = (us, station)
        if ready:
            self.series.update(last)
        due = None if last is None else last[0] // 1000 + self.every_ms + 1
        if due is not None and due <= watermark:
            yield missed(*last)
            self.series.clear()
            due = None
        self.wake(min((t for t in (due, following) if t is not None), default=None))


def overdue(stream: DataFrame, *, key: str = "user_id", every: int = 24 * HOUR_MS, late: str = "1 hour") -> DataFrame:
    """(key, last_ts, station, due) of each asset from which no ping has come for `every` milliseconds, once for each silence; what an asset's position is then inferred from is its flights."""
    prepare(stream.sparkSession)
    rows = stream.filter(F.col(key).isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    rows = rows.select(key, "ts", F.coalesce("event_id", F.lit(0)).alias("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_type").alias("held"))
    out = f"{key} {stream.schema[key].dataType.simpleString()}, last_us long, station string, due_ms long"
    done = rows.groupBy(key).transformWithState(Cadence(key, every), out, "append", "EventTime")
    return done.select(key, F.timestamp_micros("last_us").alias("last_ts"), "station", F.timestamp_millis("due_ms").alias("due"))


def supplemented(pings: DataFrame, flights: DataFrame, key: str = "user_id", every_hours: int = 24) -> DataFrame:
    """Pings, and where the next one comes later than every_hours, the flight events in between: (key, ts, station, inferred), in batch."""
    w = Window.partitionBy(key).orderBy("ts")
    gaps = pings.select(key, "ts", F.lead("ts").over(w).alias("until")).filter(F.col("until").isNull() | (F.col("until") > F.col("ts") + F.expr(f"INTERVAL {every_hours} HOURS")))
    moved = flights.select(F.col(key).alias("f_key"), F.col("ts").alias("f_ts"), F.col("event_type").alias("station"))
    between = gaps.join(moved, (F.col(key) == F.col("f_key")) & (F.col("f_ts") > F.col("ts")) & (F.col("until").isNull() | (F.col("f_ts") < F.col("until"))))
    own = pings.select(key, "ts", F.col("event_type").alias("station"), F.lit(False).alias("inferred"))
    return own.unionByName(between.select(key, F.col("f_ts").alias("ts"), "station", F.lit(True).alias("inferred")))


def run_available(frame: DataFrame, checkpoint: str, path: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Takes what a stream has to offer now, into Parquet or through a function of each batch; a run that ended halfway is taken up again from its checkpoint."""
    writer = frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").start(path)
    query.awaitTermination()
    return None if each else frame.sparkSession.read.schema(frame.schema).parquet(path)
