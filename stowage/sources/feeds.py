"""Feeds: traffic tables, flight, weather and event JSON. Providers' documents are files of JSON lines here, parsed by schema."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.operators.flights import first_of
from stowage.plans import dims
from stowage.sources.store import reader

#: Columns of the on-time table that are kept where present. Fixed values.
ON_TIME = (
    "FL_DATE OP_CARRIER OP_CARRIER_FL_NUM TAIL_NUM ORIGIN ORIGIN_CITY_NAME DEST DEST_CITY_NAME CRS_DEP_TIME DEP_TIME DEP_DELAY TAXI_OUT WHEELS_OFF WHEELS_ON TAXI_IN CRS_ARR_TIME ARR_TIME ARR_DELAY CANCELLED CANCELLATION_CODE DIVERTED "
    "CRS_ELAPSED_TIME ACTUAL_ELAPSED_TIME AIR_TIME DISTANCE DISTANCE_GROUP"
).split()


def unzipped(content: bytes) -> bytes | None:
    """The first .csv member of a zip archive."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            name = next((n for n in z.namelist() if n.lower().endswith(".csv")), None)
            return z.read(name) if name else None
    except zipfile.BadZipFile:
        return None


@reader("zipped_csv")
def zipped_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of zipped CSV files, an archive a task; bad archives give no rows. Types come from the schema."""
    names = spark.createDataFrame([], schema).columns

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                data = unzipped(content)
                if data is not None:
                    for part in pd.read_csv(io.BytesIO(data), dtype=str, chunksize=100_000):
                        part = part.reindex(columns=names).astype(object)
                        yield part.where(part.notna(), None)

    text = ", ".join(f"{n} string" for n in names)
    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(go, text)
    target = spark.createDataFrame([], schema).schema
    return raw.select(*[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in target])


@reader("traffic")
def traffic(spark: SparkSession, path: str, year: int, month: int | None = None, carriers: tuple[str, ...] = ()) -> DataFrame:
    """A partitioned traffic table: year and month prune partitions, carriers filter on whichever carrier column is there."""
    rows = spark.read.parquet(path).filter(F.col("year") == year)
    rows = rows if month is None else rows.filter(F.col("month") == month)
    name = next((c for c in ("UNIQUE_CARRIER", "CARRIER") if c in rows.columns), None)
    return rows.filter(F.col(name).isin(*carriers)) if carriers and name else rows


@reader("ontime")
def on_time(spark: SparkSession, path: str, year: int, month: int | None = None) -> DataFrame:
    rows = traffic(spark, path, year, month)
    return rows.select(*[c for c in ON_TIME if c in rows.columns])


def save_partitioned(rows: DataFrame, path: str) -> bool:
    """Writes by year and month; nothing for no rows."""
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").partitionBy("year", "month").parquet(path)
    return True


def carrier_statistics(spark: SparkSession) -> DataFrame:
    """Declared and empty: no such feed is defined."""
    return spark.createDataFrame([], "carrier string, year int, departures long, passengers long")


END = "struct<iata:string,scheduled:string,actual:string,delay:double>"
FLIGHT = f"flight struct<iata:string>, airline struct<iata:string>, departure {END}, arrival {END}, flight_status string, aircraft struct<icao:string>"
FLIGHT_STATUS = {"scheduled": "scheduled", "active": "departed", "landed": "landed", "cancelled": "cancelled", "diverted": "diverted", "incident": "delayed"}


def instant(text: Column) -> Column:
    """An ISO time with Z or an offset as UTC; null if it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")).cast("timestamp_ntz")


@reader("flights")
def flights(spark: SparkSession, path: str) -> DataFrame:
    return parse_flights(spark.read.text(path), "value")


def parse_flights(rows: DataFrame, col: str) -> DataFrame:
    """Flights of JSON lines; those without number, ends or scheduled times are dropped."""
    return flight_rows(rows.select(F.from_json(col, FLIGHT).alias("x")).select("x.*"))


def flight_rows(x: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and the flight that each row's provider fields tell of."""
    at = lambda c: instant(F.col(c))
    out = x.select(
        *keep,
        F.col("flight.iata").alias("flight_number"), F.coalesce("airline.iata", F.substring("flight.iata", 1, 2)).alias("airline"), F.col("departure.iata").alias("origin"), F.col("arrival.iata").alias("destination"),
        at("departure.scheduled").alias("departure"), at("arrival.scheduled").alias("arrival"), at("departure.actual").alias("actual_departure"), at("arrival.actual").alias("actual_arrival"),
        F.greatest(F.lit(0), F.coalesce(F.col("departure.delay"), F.lit(0.0)).cast("int")).alias("delay_minutes"), dims.lookup(FLIGHT_STATUS, F.col("flight_status"), "scheduled").alias("status"), F.col("aircraft.icao").alias("aircraft"),
    )
    return out.dropna(subset=["flight_number", "origin", "destination", "departure", "arrival"])


def parse_answers(documents: DataFrame, col: str = "document", limit: int = 100) -> DataFrame:
    """(place, day, position, flight) of a flight feed's answers: the first `limit` entries of each, none of an answer that tells of an error or can't be read."""
    answer = F.from_json(col, f"error string, data array<struct<{FLIGHT.replace(' struct', ':struct').replace('flight_status string', 'flight_status:string')}>>")
    good = documents.select("place", "day", answer.alias("a")).filter("a.error IS NULL AND a.data IS NOT NULL")
    entries = good.select("place", "day", F.posexplode(F.slice("a.data", 1, limit)).alias("position", "f")).select("place", "day", "position", "f.*")
    return flight_rows(entries, "place", "day", "position")


def flights_by_route(rows: DataFrame, origin: str, destination: str, limit: int = 100) -> DataFrame:
    return rows.filter((F.col("origin") == origin) & (F.col("destination") == destination)).orderBy("departure", "flight_number").limit(limit)


def flight_status(rows: DataFrame, number: str) -> DataFrame:
    return rows.filter(F.col("flight_number") == number).orderBy("departure").limit(1)


METAR = "icaoId string, obsTime long, reportTime string, temp double, dewp double, wspd double, wdir string, visib string, wxString string, clouds array<struct<cover:string,base:int>>, fltCat string"


def conditions(weather: Column, visibility: Column) -> Column:
    v = F.coalesce(visibility, F.lit(10.0))
    return F.coalesce(F.nullif(weather, F.lit("")), F.when(v < 1, "fog").when(v < 3, "mist").otherwise("clear"))


def ceiling(clouds: Column) -> Column:
    """The base of the first broken or overcast layer."""
    return F.get(F.filter(clouds, lambda c: c["cover"].isin("BKN", "OVC")), 0)["base"]


@reader("metar")
def metar(spark: SparkSession, path: str) -> DataFrame:
    return parse_metar(spark.read.text(path), "value")


def parse_metar(rows: DataFrame, col: str) -> DataFrame:
    x = rows.select(F.from_json(col, METAR).alias("x")).select("x.*").filter("icaoId IS NOT NULL")
    visibility = F.expr("try_cast(regexp_replace(visib, '[^0-9.]', '') AS double)")
    seen = F.coalesce(F.timestamp_seconds("obsTime").cast("timestamp_ntz"), instant(F.col("reportTime")))
    return x.select(
        F.col("icaoId").alias("station"), seen.alias("observed_at"), F.col("temp").alias("temperature_c"), F.col("wspd").alias("wind_kt"), visibility.alias("visibility"), ceiling(F.col("clouds")).alias("ceiling_ft"),
        conditions(F.col("wxString"), visibility).alias("conditions"), F.coalesce("fltCat", F.lit("VFR")).alias("flight_category"),
    )


def for_stations(stations: DataFrame, observed: DataFrame) -> DataFrame:
    """Every requested station with its last observation, or nulls."""
    last = first_of(observed, ["station"], [F.desc("observed_at"), "conditions"])
    return stations.select("station").join(last, "station", "left")


TAF = "icaoId string, issueTime string, fcsts array<struct<timeFrom:long,timeTo:long,wspd:double,visib:string,wxString:string,clouds:array<struct<cover:string,base:int>>>>"


@reader("taf")
def taf(spark: SparkSession, path: str, periods: int = 24) -> DataFrame:
    return parse_taf(spark.read.text(path), "value", periods)


def parse_taf(rows: DataFrame, col: str, periods: int = 24) -> DataFrame:
    """Forecast periods of each station, the first `periods` of them; those without times are left out."""
    x = rows.select(F.from_json(col, TAF).alias("x")).select(F.col("x.icaoId").alias("station"), F.posexplode("x.fcsts").alias("pos", "f"))
    x = x.filter((F.col("pos") < periods) & F.col("f.timeFrom").isNotNull() & F.col("f.timeTo").isNotNull())
    visibility = F.expr("try_cast(regexp_replace(f.visib, '[^0-9.]', '') AS double)")
    at = lambda c: F.timestamp_seconds(F.col(c)).cast("timestamp_ntz")
    return x.select("station", "pos", at("f.timeFrom").alias("start"), at("f.timeTo").alias("end"), F.col("f.wspd").alias("wind_kt"), visibility.alias("visibility"), ceiling(F.col("f.clouds")).alias("ceiling_ft"), conditions(F.col("f.wxString"), visibility).alias("conditions"))


def aviation(observed: DataFrame, forecast: DataFrame) -> DataFrame:
    """Each station's latest observation and its forecast periods in order, from metar() and taf(); either side may lack.

    A station's periods are those that taf() keeps of each report, so its array stays small.
    """
    last = observed.groupBy("station").agg(F.max_by(F.struct(*[c for c in observed.columns if c != "station"]), "observed_at").alias("observation"))
    periods = forecast.groupBy("station").agg(F.array_sort(F.collect_set(F.struct(*[c for c in forecast.columns if c != "station"]))).alias("periods"))
    return last.join(periods, "station", "full")


HOURLY = "station string, hourly struct<time:array<string>,temperature_2m:array<double>,precipitation_probability:array<double>,windspeed_10m:array<double>,weathercode:array<int>>"


def parse_hourly(rows: DataFrame, col: str, hours: int = 168) -> DataFrame:
    """Columnar hourly arrays as rows of one hour each."""
    x = rows.select(F.from_json(col, HOURLY).alias("x"))
    h = "x.hourly"
    zipped = F.arrays_zip(*[F.col(f"{h}.{n}").alias(n) for n in ("time", "temperature_2m", "precipitation_probability", "windspeed_10m", "weathercode")])
    x = x.select(F.col("x.station").alias("station"), F.posexplode(zipped).alias("pos", "v")).filter(F.col("pos") < hours)
    start = F.try_to_timestamp("v.time").cast("timestamp_ntz")
    code = F.coalesce("v.weathercode", F.lit(0))
    return x.select(
        "station", start.alias("start"), (start + F.expr("INTERVAL 1 HOUR")).alias("end"), F.col("v.temperature_2m").alias("temperature_c"), (F.col("v.precipitation_probability") / 100).alias("precipitation"),
        F.col("v.windspeed_10m").cast("int").alias("wind"), dims.lookup(dims.WMO, code, "unknown").alias("conditions"), dims.flight_category(code).alias("flight_category"),
    ).filter("start IS NOT NULL")


DAILY = "station string, daily struct<time:array<string>,temperature_2m_max:array<double>,temperature_2m_min:array<double>,precipitation_probability_max:array<double>,windspeed_10m_max:array<double>,weathercode:array<int>>"


def parse_daily(rows: DataFrame, col: str) -> DataFrame:
    x = rows.select(F.from_json(col, DAILY).alias("x"))
    zipped = F.arrays_zip(*[F.col(f"x.daily.{n}").alias(n) for n in ("time", "temperature_2m_max", "temperature_2m_min", "precipitation_probability_max", "windspeed_10m_max", "weathercode")])
    x = x.select(F.col("x.station").alias("station"), F.explode(zipped).alias("v"))
    code = F.coalesce("v.weathercode", F.lit(0))
    return x.select(
        "station", F.to_date("v.time").alias("day"), ((F.col("v.temperature_2m_max") + F.col("v.temperature_2m_min")) / 2).alias("temperature_c"), (F.col("v.precipitation_probability_max") / 100).alias("precipitation"),
        F.col("v.windspeed_10m_max").cast("int").alias("wind"), dims.lookup(dims.WMO, code, "unknown").alias("conditions"), dims.flight_category(code).alias("flight_category"),
    )


EVENTS = "event_id string, category string, name string, start timestamp_ntz, end timestamp_ntz, latitude double, longitude double, attendance double"


@reader("events")
def events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENTS).json(path)


def events_near(rows: DataFrame, latitude: float, longitude: float, km: float) -> DataFrame:
    from stowage.functions.exprs import haversine_km

    return rows.filter(haversine_km(F.col("latitude"), F.col("longitude"), F.lit(latitude), F.lit(longitude)) <= km)


def parse_events(documents: DataFrame, col: str = "document") -> DataFrame:
    """Events of a feed's documents, one each; those without an id are left out."""
    return documents.select(F.from_json(col, EVENTS).alias("x")).select("x.*").filter("event_id IS NOT NULL")


def statuses(asked: DataFrame, flights: DataFrame) -> DataFrame:
    """The status, delay and departure of each asked flight number's first flight, or nulls; flights don't leave their partial minimum."""
    first = flights.groupBy(F.col("flight_number").alias("f_number")).agg(F.min(F.struct("departure", "status", "delay_minutes")).alias("f"))
    return asked.join(first, F.col("asked") == F.col("f_number"), "left").select("asked", "f.status", "f.delay_minutes", "f.departure")
