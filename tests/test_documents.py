"""Feeds as a data source: partitions by place and day, pushed filters, streaming by days."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from stowage.sources import documents, feeds


def answer(*numbers):
    end = lambda place, hour: {"iata": place, "scheduled": f"2024-01-02T{hour:02d}:00:00Z"}
    return json.dumps({"data": [{"flight": {"iata": n}, "departure": end("ATL", 5), "arrival": end("JFK", 7), "flight_status": "active"} for n in numbers]})


@pytest.fixture()
def path(spark, tmp_path):
    rows = [("ATL-JFK", dt.date(2024, 1, d), answer(f"DL{d}", f"DL{d}0")) for d in (1, 2, 3)] + [("ATL/LAX", dt.date(2024, 1, 2), answer("DL9")), ("ATL-SEA", dt.date(2024, 1, 2), '{"error": "limit"}'), ("ATL-SEA", dt.date(2024, 1, 2), "no json")]
    documents.keep(spark.createDataFrame(rows, documents.SCHEMA), str(tmp_path / "feed"))
    (tmp_path / "feed" / "place=ATL-SEA" / "day=never").mkdir()
    (tmp_path / "feed" / "other").mkdir()
    return str(tmp_path / "feed")


def test_filters_prune_partitions_in_the_plan(spark, path):
    rows = documents.feed(spark, "Flight_Feed", path)
    assert rows.rdd.getNumPartitions() == 5 and rows.count() == 6
    one = rows.filter((F.col("place") == "ATL-JFK") & (F.col("day") >= F.lit("2024-01-02").cast("date")) & (F.length("document") > 5))
    plan = one._jdf.queryExecution().executedPlan().toString()
    left = next(line for line in plan.splitlines() if "Filter (" in line)
    assert "length" in left and "place" not in left and "day" not in left and one.rdd.getNumPartitions() == 2
    assert {r["day"].day for r in one.collect()} == {2, 3}
    assert rows.filter(F.col("place").isin("ATL/LAX", "x")).count() == 1 and rows.filter("place = 'none'").count() == 0
    assert rows.filter("place <> 'ATL-JFK' OR day > DATE '2024-01-02'").count() == 4
    assert rows.count() == 6 and rows.filter("document LIKE '%DL%'").count() == 4
    assert [p.days for p in documents.listed(path, most=3)][0][0][0] == "2024-01-01" and len(documents.listed(path, most=3)) == 4


def test_answers(spark, path):
    got = feeds.parse_answers(documents.feed(spark, "flight_feed", path)).collect()
    assert sorted(r["flight_number"] for r in got) == ["DL1", "DL10", "DL2", "DL20", "DL3", "DL30", "DL9"] and {r["status"] for r in got} == {"departed"}
    assert {r["position"] for r in feeds.parse_answers(documents.feed(spark, "flight_feed", path), limit=1).collect()} == {0}


def test_unknown_feed_and_a_feed_of_ones_own(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown feed: Nothing"):
        documents.feed(spark, "Nothing", str(tmp_path))

    class Cargo(documents.Feed):
        @classmethod
        def name(cls):
            return "cargo_feed"

    documents.register_feed(Cargo)
    assert documents.feed(spark, "CARGO_FEED", str(tmp_path / "nowhere")).count() == 0
    del documents.FEEDS["cargo_feed"]


def test_days_are_offsets(spark, path, tmp_path):
    def take(open_last):
        q = documents.feed_stream(spark, "flight_feed", path, open_last).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"c{open_last}")).option("path", str(tmp_path / f"o{open_last}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(r["day"].day for r in spark.read.parquet(str(tmp_path / f"o{open_last}")).select("day").collect())

    assert take(True) == [1, 2, 2, 2, 2, 3] and take(False) == [1, 2, 2, 2, 2]
    documents.keep(spark.createDataFrame([("ATL-JFK", dt.date(2024, 1, 4), answer("DL4"))], documents.SCHEMA), path)
    assert take(True) == [1, 2, 2, 2, 2, 3, 4] and take(False) == [1, 2, 2, 2, 2, 3]
