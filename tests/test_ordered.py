"""State with timers: pings that come out of order, over several batches, give what batch gives on the same rows."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from stowage.operators import anomaly
from stowage.streaming import ordered, streams

START = dt.datetime(2024, 1, 1)
FAR = START + dt.timedelta(days=400)
HOUR = ordered.HOUR_MS


def ping(event, hours, user, value, kind="ATL"):
    return (event, START + dt.timedelta(hours=hours), user, kind, value, None)


def spread(rows, rng, within):
    """rows in an order in which none comes more than `within` hours behind the latest before it."""
    return sorted(rows, key=lambda r: (r[1] + dt.timedelta(hours=rng.uniform(0, within)), r[0]))


def stream_of(spark, rows, path, batches):
    """One file a batch, read in that order; at the end a ping of another asset, far ahead, moves the watermark past all."""
    size = -(-len(rows) // batches)
    parts = [rows[i : i + size] for i in range(0, len(rows), size)] + [[(10**6 + k, FAR + dt.timedelta(days=k), -1, "END", 0.0, None)] for k in (0, 40)]
    for part in parts:
        spark.createDataFrame(part, streams.PINGS).coalesce(1).write.mode("append").parquet(path)
    return streams.pings(spark, path)


@pytest.fixture()
def run(spark, tmp_path):
    def go(frame, mode="append"):
        out = ordered.run_available(frame, str(tmp_path / "state"), str(tmp_path / "out"), mode) if mode == "append" else None
        if out is None:
            # with a clock, a stream never has nothing left to do: it is stopped once it has read all files
            seen: dict[int, int] = {}
            q = frame.writeStream.outputMode(mode).format("memory").queryName("ordered_out").start()
            for _ in range(150):
                seen |= {p["batchId"]: p["numInputRows"] for p in q.recentProgress}
                if sum(seen.values()) >= spark.read.schema(streams.PINGS).parquet(str(tmp_path / "in")).count():
                    break
                time.sleep(0.4)
            q.stop()
            out = spark.table("ordered_out")
        return [r.asDict() for r in out.filter("user_id >= 0").collect()]

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield go
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset(ordered.PROVIDER)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = []
    for user in range(4):
        at = 0.0
        for k in range(25):
            at += rng.uniform(0.5, 6) + (300 if k == 12 and user % 2 else 0)
            out.append(ping(100 * user + k, round(at, 3), user, rng.gauss(55 if k > 8 else 50, 6)))
    return spread(out, rng, 20)


def by_event(rows):
    return {r["event_id"]: r for r in rows}


def test_cusum_of_late_pings_is_the_batch_one(spark, rows, tmp_path, run):
    assert [r[1] for r in rows] != sorted(r[1] for r in rows)
    got = by_event(run(ordered.in_order(stream_of(spark, rows, str(tmp_path / "in"), 3), ordered.Cusum(50.0, 2.0, 12.0))))
    batch = ordered.sessions_of(spark.createDataFrame(rows, streams.PINGS)).withColumn("k", F.concat_ws(":", "user_id", "session"))
    want = {(r["k"], r["position"]): r for r in anomaly.cusum_with_reset(batch, "k", ["ts", "event_id"], "value", 50.0, 2.0, 12.0).collect()}
    assert len(got) == len(rows) == len(want) and any(r["side"] for r in got.values())
    for r in got.values():
        w = want[f"{r['user_id']}:{r['session']}", r["position"]]
        assert (r["up"], r["down"], r["side"]) == (pytest.approx(w["up"]), pytest.approx(w["down"]), w["side"])
    # a silence of more than a week begins a session anew
    assert {len({r["session"] for r in got.values() if r["user_id"] == u}) for u in (1, 3)} == {2} and len({r["session"] for r in got.values() if r["user_id"] == 0}) == 1


def test_change_points_of_late_pings_are_the_batch_ones(spark, rows, tmp_path, run):
    model = ordered.ChangePoints(mean=50.0, prior_var=100.0, var=36.0)
    got = by_event(run(ordered.in_order(stream_of(spark, rows, str(tmp_path / "in"), 2), model, idle=10_000 * HOUR)))
    want = anomaly.change_points(spark.createDataFrame(rows, streams.PINGS), "user_id", ["ts", "event_id"], "value", mean=50.0, prior_var=100.0, var=36.0)
    want = {(r["user_id"], r["position"]): r for r in want.collect()}
    assert len(got) == len(want) == len(rows)
    for r in got.values():
        w = want[r["user_id"], r["position"]]
        assert r["p_change"] == pytest.approx(w["p_change"]) and r["run_length"] == pytest.approx(w["run_length"])


def test_state_of_silent_assets_goes(spark, rows, tmp_path, run):
    again = rows + [ping(5, 0.25, 3, 50.0)] + [(None, START, 1, "x", 1.0, None), ping(7, 1, None, 1.0), ping(8, 1, 1, None)]
    run(ordered.in_order(stream_of(spark, rows[:1] + again, str(tmp_path / "in"), 1), ordered.Cusum(50.0, 2.0, 12.0)))
    kept = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "series").load()
    assert {r["key"]["user_id"] for r in kept.select("key").collect()} <= {-1}
    waiting = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "buffer").load()
    assert {r["key"]["user_id"] for r in waiting.select("key").collect()} <= {-1}


def test_newest_positions_move_on_only(spark, tmp_path, run):
    rows = [ping(1, 5, 1, 0.0, "A"), ping(2, 3, 1, 0.0, "B"), ping(3, 9, 1, 0.0, "C"), ping(4, 7, 1, 0.0, "D"), ping(5, 9, 1, 0.0, "E"), ping(6, 1, 2, 0.0, "F")]
    got = run(ordered.newest_positions(stream_of(spark, rows, str(tmp_path / "in"), 3)), "update")
    assert [(r["user_id"], r["station"]) for r in sorted(got, key=lambda r: r["event_id"])] == [(1, "A"), (1, "C"), (1, "E"), (2, "F")]


def test_overdue_once_for_each_silence(spark, tmp_path, run):
    rows = [ping(1, 0, 1, 0.0, "A"), ping(2, 20, 1, 0.0, "B"), ping(3, 0, 2, 0.0, "C"), ping(4, 30, 1, 0.0, "D"), ping(5, 60, 2, 0.0, "E")]
    got = run(ordered.overdue(stream_of(spark, rows, str(tmp_path / "in"), 3), late="30 hours"))
    assert sorted((r["user_id"], r["station"], r["due"]) for r in got) == [(1, "D", START + dt.timedelta(hours=54)), (2, "C", START + dt.timedelta(hours=24)), (2, "E", START + dt.timedelta(hours=84))]


def test_flights_fill_the_silences(spark):
    pings = spark.createDataFrame([ping(1, 0, 1, 0.0, "A"), ping(2, 30, 1, 0.0, "B"), ping(3, 40, 1, 0.0, "C")], streams.PINGS)
    flights = spark.createDataFrame([ping(4, 10, 1, 0.0, "F1"), ping(5, 35, 1, 0.0, "F2"), ping(6, 70, 1, 0.0, "F3"), ping(7, 10, 2, 0.0, "F4")], streams.PINGS)
    got = {r["station"]: r["inferred"] for r in ordered.supplemented(pings, flights).collect()}
    assert got == {"A": False, "B": False, "C": False, "F1": True, "F3": True}
