"""Feeds, tables and generators round-trip."""

import io
import json
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from stowage.plans import dims
from stowage.sources import feeds, store, synth


def test_flight_json(spark):
    good = {"flight": {"iata": "XY12"}, "departure": {"iata": "ATL", "scheduled": "2024-01-01T10:00:00Z", "delay": 12.7}, "arrival": {"iata": "JFK", "scheduled": "2024-01-01T12:00:00+00:00"}, "flight_status": "active"}
    rows = spark.createDataFrame([(json.dumps(good),), ('{"flight": {}}',), ("not json",)], "value string")
    out = feeds.parse_flights(rows, "value").collect()
    assert len(out) == 1 and out[0]["airline"] == "XY" and out[0]["delay_minutes"] == 12 and out[0]["status"] == "departed" and out[0]["departure"] == datetime(2024, 1, 1, 10)


def test_weather_json(spark):
    m = {"icaoId": "KATL", "reportTime": "2024-01-01T10:00:00Z", "visib": "2", "clouds": [{"cover": "FEW", "base": 100}, {"cover": "BKN", "base": 900}, {"cover": "OVC", "base": 300}]}
    got = feeds.parse_metar(spark.createDataFrame([(json.dumps(m),)], "value string"), "value").first()
    assert (got["ceiling_ft"], got["conditions"]) == (900, "mist")
    both = feeds.for_stations(spark.createDataFrame([("KATL",), ("KJFK",)], "station string"), feeds.parse_metar(spark.createDataFrame([(json.dumps(m),)], "value string"), "value"))
    assert both.count() == 2
    taf = {"icaoId": "KATL", "fcsts": [{"timeFrom": 0, "timeTo": 3600}, {"timeFrom": None, "timeTo": 1}, {"timeFrom": 3600, "timeTo": 7200}]}
    assert feeds.parse_taf(spark.createDataFrame([(json.dumps(taf),)], "value string"), "value", 2).count() == 1
    hourly = {"station": "ATL", "hourly": {"time": ["2024-01-01T23:00"], "temperature_2m": [1.5], "precipitation_probability": [50], "windspeed_10m": [9.9], "weathercode": [95]}}
    h = feeds.parse_hourly(spark.createDataFrame([(json.dumps(hourly),)], "value string"), "value").first()
    assert (h["end"], h["precipitation"], h["wind"], h["conditions"], h["flight_category"]) == (datetime(2024, 1, 2), 0.5, 9, "thunderstorm", "IFR")


def test_zipped_csv(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("t.csv", "ORIGIN,DISTANCE,EXTRA\nATL,100,1\nJFK,bad,2\n")
    (tmp_path / "a.zip").write_bytes(data.getvalue())
    (tmp_path / "b.zip").write_bytes(b"broken")
    rows = feeds.zipped_csv(spark, str(tmp_path), "ORIGIN string, DISTANCE int, MISSING string").orderBy("ORIGIN").collect()
    assert [(r["ORIGIN"], r["DISTANCE"], r["MISSING"]) for r in rows] == [("ATL", 100, None), ("JFK", None, None)]


def test_traffic_partitions(spark, tmp_path):
    rows = spark.createDataFrame([(2023, 1, "DL", "ATL"), (2024, 2, "XX", "JFK")], "year int, month int, CARRIER string, ORIGIN string")
    assert feeds.save_partitioned(rows, str(tmp_path / "t")) and not feeds.save_partitioned(rows.limit(0), str(tmp_path / "e"))
    assert store.source("TRAFFIC", spark, str(tmp_path / "t"), 2024, carriers=("XX",)).count() == 1
    assert store.source("ontime", spark, str(tmp_path / "t"), 2023).columns == ["ORIGIN"]
    with pytest.raises(ValueError):
        store.source("nothing")


def test_tables(spark, tmp_path):
    base = str(tmp_path)
    store.create(spark, base)
    store.append(spark.createDataFrame([("r1", "critical", "ATL", "JFK", "pending"), ("r2", "low", "SEA", "BOS", "pending")], "recommendation_id string, priority string, origin_station string, destination_station string, status string"), base, "recommendations")
    recs = store.read(spark, base, "recommendations")
    assert [r["recommendation_id"] for r in store.pending(recs).collect()] == ["r1", "r2"] and store.pending(recs, "BOS").count() == 1
    done = store.rewrite(store.with_status(recs, "r1", "executed", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")), f"{base}/v2")
    assert store.pending(done).count() == 1 and store.without(done, F.col("recommendation_id") == "r2").count() == 1
    assert store.page(done, "recommendation_id", 1, 1).first()["recommendation_id"] == "r2"
    assert store.with_forecast_defaults(spark.range(1)).first()["granularity"] == "hourly"


def test_rules(spark):
    rows = spark.createDataFrame([("AKE12345XX", "XX", "ATL"), ("short", "x", None)], "uld_id string, owner_airline string, current_station string")
    assert [r["valid"] for r in store.valid_rows(rows, store.uld_rules()).collect()] == [True, False]


def test_generators_repeat_and_vary(spark):
    s = dims.stations(spark)
    a, b = (synth.schedule(s, date(2024, 1, 1), 2, seed) for seed in (1, 2))
    assert a.exceptAll(synth.schedule(s, date(2024, 1, 1), 2, 1)).isEmpty() and not a.exceptAll(b).isEmpty()
    late = synth.delayed(a, 0.15).agg(F.avg((F.col("delay_minutes") > 0).cast("int"))).first()[0]
    assert 0.05 < late < 0.25 and synth.cancelled(a, 0.5).filter("status = 'cancelled'").count() > 0
    f = synth.fleet(s, 2000)
    share = f.agg(F.avg((F.col("uld_type") == "AKE").cast("int"))).first()[0]
    assert abs(share - 0.5) < 0.05 and f.filter("status = 'in_transit' AND station IS NOT NULL").isEmpty()
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    assert synth.position_history(f.limit(3), at, 5).count() == 15 and synth.scenarios(s, 10, at).count() == 10
    d = synth.with_anomalies(synth.with_actuals(synth.demand_series(s, date(2024, 1, 1), 30, noise=0.1)), 0.2)
    assert d.filter("is_anomaly").count() > 10


def test_observation_beside_forecast(spark):
    def seen(code, second, temp):
        return (json.dumps({"icaoId": code, "obsTime": second, "temp": temp}),)

    m = feeds.parse_metar(spark.createDataFrame([seen("KATL", 60, 1.0), seen("KATL", 120, 2.0), seen("KJFK", 60, 3.0)], "value string"), "value")
    taf = {"icaoId": "KATL", "fcsts": [{"timeFrom": 0, "timeTo": 3600}, {"timeFrom": 3600, "timeTo": 7200}]}
    t = feeds.parse_taf(spark.createDataFrame([(json.dumps(taf),), (json.dumps({**taf, "icaoId": "KSEA"}),)], "value string"), "value")
    got = {x["station"]: x for x in feeds.aviation(m, t).collect()}
    assert set(got) == {"KATL", "KJFK", "KSEA"} and got["KATL"]["observation"]["temperature_c"] == 2.0 and [p["pos"] for p in got["KATL"]["periods"]] == [0, 1]
    assert got["KJFK"]["periods"] is None and got["KSEA"]["observation"] is None


def test_regional_scenarios(spark):
    storm = synth.regional_scenarios(spark, "winter_storm", 30, 2024)
    assert storm.count() == 120 and storm.filter("month(start) NOT IN (12, 1, 2, 3)").isEmpty() and storm.filter("severity > 0.7 OR severity < 0.56").isEmpty()
    totals = synth.scenario_totals(storm)
    assert totals.count() == 30 and totals.filter("stations <> 4 OR flights < 4 * 64 OR flights > 4 * 192").isEmpty()
    summer = synth.regional_scenarios(spark, "thunderstorm", 20, 2024)
    assert summer.filter("month(start) NOT IN (6, 7, 8) OR hour(start) <> 15").isEmpty()
    assert synth.regional_scenarios(spark, "demand_spike", 5, 2024, 0.5).filter("units <> 360 OR flights <> 0").isEmpty()
    assert storm.exceptAll(synth.regional_scenarios(spark, "winter_storm", 30, 2024).repartition(7)).isEmpty()
