"""Streams give what batch gives on the same rows."""

import pytest
from pyspark.sql import functions as F

from stowage.operators import anomaly, tracking
from stowage.sources.deltas import DeltaTable
from stowage.streaming import streams


@pytest.fixture(scope="module")
def feed(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pings"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "user_id", "event_type", "value", "props").cache()
    for k in range(3):
        rows.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(path)
    return rows, path


def run(frame, mode, name):
    q = frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return frame.sparkSession.table(name)


def test_latest(spark, feed):
    rows, path = feed
    got = run(streams.latest_positions(streams.pings(spark, path)), "complete", "latest")
    want = tracking.latest_position(rows.select(F.col("user_id").alias("uld_id"), F.col("event_type").alias("station"), "ts", F.col("event_id").alias("id"))).select("uld_id", "station", "ts")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_windows(spark, feed):
    rows, path = feed
    got = run(streams.windowed(streams.pings(spark, path), "1 day"), "complete", "windows")
    assert got.agg(F.sum("n")).first()[0] == rows.count()


def test_online_cusum_counts(spark, feed):
    rows, path = feed
    got = run(streams.online_cusum(streams.pings(spark, path, 10), 50.0, 5.0, 100.0), "append", "cusum")
    want = anomaly.cusum_with_reset(rows, "user_id", ["ts", "event_id"], "value", 50.0, 5.0, 100.0)
    assert got.count() == want.count() and got.filter("side IS NOT NULL").count() == want.filter("side IS NOT NULL").count()


def test_duplicates_go(spark, feed, tmp_path):
    rows, _ = feed
    rows.union(rows).coalesce(1).write.parquet(str(tmp_path / "twice"))
    assert run(streams.once(streams.pings(spark, str(tmp_path / "twice"))), "append", "once").count() == rows.count()


def test_upsert_keeps_the_last(spark, feed, tmp_path):
    rows, path = feed
    table = DeltaTable(spark, str(tmp_path / "t"), streams.PINGS, "user_id", "ts", buckets=4)
    q = streams.pings(spark, path).writeStream.foreachBatch(streams.upsert(table)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = rows.groupBy("user_id").agg(F.max("ts").alias("ts"))
    got = table.read().select("user_id", "ts")
    assert got.exceptAll(last).isEmpty() and last.exceptAll(got).isEmpty() and table.folders("delta") == [0, 1, 2]


def test_online_change_points_are_the_batch_ones(spark, feed):
    rows, path = feed
    one = spark.read.schema(streams.PINGS).parquet(path)
    got = run(streams.online_change_points(streams.pings(spark, path, 10), mean=50.0, prior_var=400.0, var=900.0), "append", "changes")
    want = anomaly.change_points(one, "user_id", ["ts", "event_id"], "value", mean=50.0, prior_var=400.0, var=900.0)
    both = got.join(want.withColumnsRenamed({"p_change": "p", "run_length": "l"}), ["user_id", "position"], "full")
    assert both.filter("p_change IS NULL OR p IS NULL OR abs(p_change - p) > 1e-9 OR abs(run_length - l) > 1e-6").isEmpty()


def test_change_point_state_lasts_over_batches(spark, feed):
    rows, path = feed
    got = run(streams.online_change_points(streams.pings(spark, path, 1), mean=50.0, prior_var=400.0, var=900.0), "append", "changes_by_batch")
    assert got.groupBy("user_id").agg(F.max("position").alias("m"), F.count("*").alias("n")).filter("m <> n").isEmpty() and got.count() == rows.count()


def test_fit_counts(spark, feed):
    rows, path = feed
    got = run(streams.fit_counts(streams.pings(spark, path), warmup=10), "complete", "fits")
    want = rows.groupBy("user_id").count()
    assert got.join(want, "user_id").filter("observations <> count OR fitted <> (count >= 10) OR weight < 0 OR weight > 1").isEmpty() and got.count() == want.count()
