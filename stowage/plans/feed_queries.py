"""Queries over feeds: documents as providers send them, made by Spark from the test tables, kept in a feed's folders and read back through its data source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions.shared import new_folder
from stowage.plans import bindings as B
from stowage.plans import dims
from stowage.plans.registry import query, rounded
from stowage.sources import documents, feeds

#: Answers that tell of an error: those of hours divisible by this.
ERROR_HOURS = 7
UTC = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def events(spark, sf_dir) -> DataFrame:
    """event_id, ts, place (upper-cased event type), day, hour, user_id, value."""
    e = B.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return e.select("event_id", "ts", F.upper("event_type").alias("place"), F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "user_id", "value")


def stored(spark, rows: DataFrame, kind: str) -> str:
    """The path of a feed of these (place, day, document) rows, in the shared folder."""
    path = new_folder(spark, kind)
    documents.keep(rows, path)
    return path


def flight_documents(spark, sf_dir) -> DataFrame:
    """An answer for each place, day and hour, of up to all its flights in the order of their numbers; some are errors."""
    at = lambda c: F.date_format(c, UTC)
    late = F.col("ts") + F.expr("INTERVAL 90 MINUTES")
    e = events(spark, sf_dir).withColumn("f", F.struct(
        F.struct(F.concat(F.lit("FL"), F.col("event_id").cast("string")).alias("iata")).alias("flight"),
        F.struct(F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("A"), (F.col("user_id") % 10).cast("string"))).alias("iata")).alias("airline"),
        F.struct(F.lit("ATL").alias("iata"), at("ts").alias("scheduled"), F.when(F.col("user_id") % 4 == 0, at("ts")).alias("actual"), (F.col("value") - 20).alias("delay")).alias("departure"),
        F.struct(F.when(F.col("event_id") % 50 > 0, F.col("place")).alias("iata"), at(late).alias("scheduled"), F.lit(None).cast("string").alias("actual"), F.lit(None).cast("double").alias("delay")).alias("arrival"),
        F.element_at(F.array(*[F.lit(s) for s in ("scheduled", "active", "landed", "cancelled", "strange")]), (F.col("user_id") % 5 + 1).cast("int")).alias("flight_status"),
        F.struct(F.lit("B738").alias("icao")).alias("aircraft"),
    ))
    answers = e.groupBy("place", "day", "hour").agg(F.array_sort(F.collect_list(F.struct("event_id", "f"))).alias("fs"))  # the events of an hour
    data = F.to_json(F.struct(F.transform("fs", lambda x: x["f"]).alias("data")))
    return answers.select("place", "day", F.when(F.col("hour") % ERROR_HOURS == 0, F.lit('{"error": {"code": "rate_limit"}}')).otherwise(data).alias("document"))


def flight_feed_rows(spark, sf_dir) -> DataFrame:
    return documents.feed(spark, "flight_feed", stored(spark, flight_documents(spark, sf_dir), "flight_feed"))


FEED_FLIGHTS = f"""(SELECT event_id, upper(event_type) AS place, ts::DATE AS day, 'FL' || event_id AS flight_number, CASE WHEN user_id % 3 > 0 THEN 'A' || user_id % 10 ELSE 'FL' END AS airline, upper(event_type) AS destination,
ts AS departure, ts + INTERVAL 90 MINUTES AS arrival, CASE WHEN user_id % 4 = 0 THEN ts END AS actual_departure, greatest(0, trunc(value - 20))::INT AS delay_minutes,
['scheduled', 'departed', 'landed', 'cancelled', 'scheduled'][user_id % 5 + 1] AS status
FROM (SELECT *, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id) AS position FROM events WHERE hour(ts) % {ERROR_HOURS} <> 0) WHERE position <= 100 AND event_id % 50 > 0)"""
FLIGHT_COLUMNS = ["place", "day", "flight_number", "airline", "destination", "departure", "arrival", "actual_departure", "delay_minutes", "status"]


@query(f"SELECT {', '.join(FLIGHT_COLUMNS)} FROM {FEED_FLIGHTS}")
def flight_feed(spark, sf_dir):
    return feeds.parse_answers(flight_feed_rows(spark, sf_dir)).select(*FLIGHT_COLUMNS)


@query(f"SELECT {', '.join(FLIGHT_COLUMNS)} FROM {FEED_FLIGHTS} WHERE place = 'VIEW' AND day BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'")
def flight_feed_route(spark, sf_dir):
    """A route's flights of some days: only their folders become partitions."""
    rows = flight_feed_rows(spark, sf_dir).filter((F.col("place") == "VIEW") & F.col("day").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-09").cast("date")))
    return feeds.parse_answers(rows).select(*FLIGHT_COLUMNS)


@query(f"SELECT 'FL' || e.event_id AS asked, f.status, f.delay_minutes, f.departure FROM events e LEFT JOIN {FEED_FLIGHTS} f ON f.event_id = e.event_id")
def flight_status_lookup(spark, sf_dir):
    """The first flight of each asked number, or nulls."""
    flights = feeds.parse_answers(flight_feed_rows(spark, sf_dir))
    asked = events(spark, sf_dir).select(F.concat(F.lit("FL"), F.col("event_id").cast("string")).alias("asked"))
    return feeds.statuses(asked, flights)


# ---- weather ----
def metar_documents(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    layer = lambda cover, base: F.struct(F.lit(cover).alias("cover"), base.cast("int").alias("base"))
    clouds = F.when(F.col("user_id") % 3 == 0, F.array(layer("FEW", F.col("value") * 10), layer("OVC", F.col("value") * 100))).when(F.col("user_id") % 3 == 1, F.array(layer("SCT", F.col("value"))))
    doc = F.struct(
        F.substring("place", 1, 4).alias("icaoId"), F.when(F.col("user_id") % 2 == 0, F.unix_seconds(F.col("ts").cast("timestamp"))).alias("obsTime"), F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("reportTime"),
        F.col("value").alias("temp"), F.col("event_id").cast("double").alias("wspd"), F.when(F.col("value") < 90, F.concat((F.col("event_id") % 12).cast("string"), F.when(F.col("user_id") % 5 == 0, "+").otherwise(""))).alias("visib"),
        F.when(F.col("event_id") % 9 == 0, "-RA").alias("wxString"), clouds.alias("clouds"), F.when(F.col("user_id") % 7 == 0, "IFR").alias("fltCat"),
    )
    return e.select("place", "day", F.to_json(doc).alias("document"))


METAR_ROWS = """(SELECT event_id, substr(upper(event_type), 1, 4) AS station, CASE WHEN user_id % 2 = 0 THEN to_timestamp(epoch(ts)::BIGINT)::TIMESTAMP ELSE date_trunc('hour', ts) END AS observed_at, value AS temperature_c,
CASE WHEN value < 90 THEN (event_id % 12)::DOUBLE END AS visibility, CASE WHEN user_id % 3 = 0 THEN trunc(value * 100)::INT END AS ceiling_ft,
CASE WHEN event_id % 9 = 0 THEN '-RA' WHEN value < 90 AND event_id % 12 < 1 THEN 'fog' WHEN value < 90 AND event_id % 12 < 3 THEN 'mist' ELSE 'clear' END AS conditions, CASE WHEN user_id % 7 = 0 THEN 'IFR' ELSE 'VFR' END AS flight_category
FROM (SELECT *, date_trunc('second', ts) AS t FROM events))"""
METAR_COLUMNS = ["event_id", "station", "observed_at", "temperature_c", "visibility", "ceiling_ft", "conditions", "flight_category"]


def metar_rows(spark, sf_dir) -> DataFrame:
    rows = documents.feed(spark, "weather_feed", stored(spark, metar_documents(spark, sf_dir), "metar"))
    return feeds.parse_metar(rows, "document").withColumn("event_id", F.col("wind_kt").cast("long"))


@query(f"SELECT {', '.join(METAR_COLUMNS)} FROM {METAR_ROWS.replace('to_timestamp(epoch(ts)::BIGINT)::TIMESTAMP', 't')}")
def metar_feed(spark, sf_dir):
    return metar_rows(spark, sf_dir).select(*METAR_COLUMNS)


@query(f"""WITH s AS (SELECT DISTINCT upper(substr(n_name, 1, 4)) AS station FROM nation UNION SELECT DISTINCT station FROM {METAR_ROWS.replace('to_timestamp(epoch(ts)::BIGINT)::TIMESTAMP', 't')}),
m AS (SELECT * FROM {METAR_ROWS.replace('to_timestamp(epoch(ts)::BIGINT)::TIMESTAMP', 't')} QUALIFY row_number() OVER (PARTITION BY station ORDER BY observed_at DESC, conditions, event_id) = 1)
SELECT s.station, observed_at, conditions FROM s LEFT JOIN m USING (station)""")
def metar_of_stations(spark, sf_dir):
    """Every asked station with its last observation, or nulls."""
    seen = metar_rows(spark, sf_dir)
    stations = B.table(spark, sf_dir, "nation").select(F.upper(F.substring("n_name", 1, 4)).alias("station")).union(seen.select("station")).distinct()
    return feeds.for_stations(stations, seen).select("station", "observed_at", "conditions")


def daily_sums(spark, sf_dir) -> DataFrame:
    """Whole numbers of each place, day and hour: events, and the floor of the least and greatest value."""
    low, high = F.floor(F.min("value")).cast("int"), F.floor(F.max("value")).cast("int")
    return events(spark, sf_dir).groupBy("place", "day", "hour").agg(F.count(F.lit(1)).cast("int").alias("n"), low.alias("low"), high.alias("high"))


HOURS = "(SELECT upper(event_type) AS place, ts::DATE AS day, hour(ts)::INT AS hour, count(*)::INT AS n, floor(min(value))::INT AS low, floor(max(value))::INT AS high FROM events GROUP BY ALL)"


def taf_documents(spark, sf_dir) -> DataFrame:
    at = F.unix_seconds(F.col("day").cast("timestamp")) + F.col("hour") * 3600
    clouds = F.array(F.struct(F.lit("BKN").alias("cover"), (F.col("low") * 100).alias("base")))
    period = F.struct(F.when(F.col("n") > 1, at).alias("timeFrom"), (at + 3600).alias("timeTo"), F.col("high").cast("double").alias("wspd"), F.col("n").cast("string").alias("visib"), F.lit("").alias("wxString"), clouds.alias("clouds"))
    days = daily_sums(spark, sf_dir).groupBy("place", "day").agg(F.array_sort(F.collect_list(F.struct("hour", period.alias("p")))).alias("ps"))  # at most 24 hours
    doc = F.struct(F.col("place").alias("icaoId"), F.date_format("day", "yyyy-MM-dd'T00:00:00Z'").alias("issueTime"), F.transform("ps", lambda p: p["p"]).alias("fcsts"))
    return days.select("place", "day", F.to_json(doc).alias("document"))


@query(f"""SELECT place AS station, pos::INT AS pos, day + INTERVAL 1 HOUR * hour AS start, day + INTERVAL 1 HOUR * (hour + 1) AS "end", high::DOUBLE AS wind_kt, n::DOUBLE AS visibility, low * 100 AS ceiling_ft, CASE WHEN n < 1 THEN 'fog' WHEN n < 3 THEN 'mist' ELSE 'clear' END AS conditions
FROM (SELECT *, row_number() OVER (PARTITION BY place, day ORDER BY hour) - 1 AS pos FROM {HOURS}) WHERE pos < 12 AND n > 1""")
def taf_feed(spark, sf_dir):
    """The first 12 periods of each report; those without a time are left out."""
    rows = documents.feed(spark, "weather_feed", stored(spark, taf_documents(spark, sf_dir), "taf"))
    return feeds.parse_taf(rows, "document", 12)


def hourly_documents(spark, sf_dir) -> DataFrame:
    one = F.struct(F.date_format("day", "yyyy-MM-dd").alias("day"), "hour", "n", "low", "high")
    days = daily_sums(spark, sf_dir).groupBy("place", "day").agg(F.array_sort(F.collect_list(one)).alias("hs"))  # at most 24 hours
    part = lambda f: F.transform("hs", f)
    code = F.array(*[F.lit(c) for c in sorted(dims.WMO)])
    hourly = F.struct(
        part(lambda h: F.concat(h["day"], F.lit("T"), F.lpad(h["hour"].cast("string"), 2, "0"), F.lit(":00"))).alias("time"), part(lambda h: h["low"].cast("double")).alias("temperature_2m"), part(lambda h: h["n"] * 10.0).alias("precipitation_probability"),
        part(lambda h: h["high"] + 0.75).alias("windspeed_10m"), part(lambda h: F.when(h["n"] % 5 == 0, 12345).otherwise(F.element_at(code, h["high"] % len(dims.WMO) + 1))).alias("weathercode"),
    )
    return days.select("place", "day", F.to_json(F.struct(F.col("place").alias("station"), hourly.alias("hourly"))).alias("document"))


WMO_CODES, WMO_NAMES = sorted(dims.WMO), [dims.WMO[c] for c in sorted(dims.WMO)]
CODE = f"(CASE WHEN n % 5 = 0 THEN 12345 ELSE {WMO_CODES}[high % {len(WMO_CODES)} + 1] END)"
CONDITION = f"(CASE WHEN n % 5 = 0 THEN 'unknown' ELSE {WMO_NAMES}[high % {len(WMO_CODES)} + 1] END)"


@query(f"""SELECT place AS station, day + INTERVAL 1 HOUR * hour AS start, day + INTERVAL 1 HOUR * (hour + 1) AS "end", low::DOUBLE AS temperature_c, round(n * 10.0::DOUBLE / 100, 6) AS precipitation, high AS wind, {CONDITION} AS conditions FROM {HOURS}""")
def hourly_feed(spark, sf_dir):
    """Columnar arrays of a day's hours as rows."""
    rows = documents.feed(spark, "weather_feed", stored(spark, hourly_documents(spark, sf_dir), "hourly"))
    return rounded(feeds.parse_hourly(rows, "document").drop("flight_category"))


def daily_documents(spark, sf_dir) -> DataFrame:
    """A document for each place and week, with arrays of its days."""
    days = daily_sums(spark, sf_dir).groupBy("place", "day").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    weeks = days.groupBy("place", F.to_date(F.date_trunc("week", "day")).alias("week")).agg(F.array_sort(F.collect_list(F.struct("day", "n", "low", "high"))).alias("ds"))  # at most 7 days
    part = lambda f: F.transform("ds", f)
    daily = F.struct(part(lambda d: F.date_format(d["day"], "yyyy-MM-dd")).alias("time"), part(lambda d: d["high"].cast("double")).alias("temperature_2m_max"), part(lambda d: d["low"].cast("double")).alias("temperature_2m_min"), part(lambda d: (d["n"] % 100).cast("double")).alias("precipitation_probability_max"), part(lambda d: d["high"] + 0.5).alias("windspeed_10m_max"), part(lambda d: F.lit(0)).alias("weathercode"))
    return weeks.select("place", F.col("week").alias("day"), F.to_json(F.struct(F.col("place").alias("station"), daily.alias("daily"))).alias("document"))


@query(f"""SELECT place AS station, day, (max(high) + min(low)) / 2.0::DOUBLE AS temperature_c, round((sum(n) % 100) / 100.0::DOUBLE, 6) AS precipitation, max(high) AS wind, '{dims.WMO[0]}' AS conditions FROM {HOURS} GROUP BY place, day""")
def daily_feed(spark, sf_dir):
    rows = documents.feed(spark, "weather_feed", stored(spark, daily_documents(spark, sf_dir), "daily"))
    return rounded(feeds.parse_daily(rows, "document").drop("flight_category"))


@query(f"""WITH m AS (SELECT station, count(*) AS observations, max(observed_at) AS last_seen FROM {METAR_ROWS.replace('to_timestamp(epoch(ts)::BIGINT)::TIMESTAMP', 't').replace('substr(upper(event_type), 1, 4)', 'upper(event_type)')} GROUP BY 1),
t AS (SELECT place AS station, count(*) AS periods, min(day + INTERVAL 1 HOUR * hour) AS first_period FROM (SELECT *, row_number() OVER (PARTITION BY place, day ORDER BY hour) - 1 AS pos FROM {HOURS}) WHERE pos < 3 AND n > 1 AND place <> 'VIEW' GROUP BY 1)
SELECT coalesce(m.station, t.station) AS station, last_seen, coalesce(periods, 0) AS periods, first_period FROM m FULL JOIN t ON t.station = m.station WHERE m.station IS DISTINCT FROM 'ERROR'""")
def aviation_weather(spark, sf_dir):
    """Observation and forecast of each station in one plan; either may lack."""
    metar = metar_documents(spark, sf_dir).withColumn("document", F.to_json(F.from_json("document", feeds.METAR).withField("icaoId", F.col("place"))))
    seen = feeds.parse_metar(documents.feed(spark, "weather_feed", stored(spark, metar.filter("place <> 'ERROR'"), "metar")), "document")
    taf = feeds.parse_taf(documents.feed(spark, "weather_feed", stored(spark, taf_documents(spark, sf_dir).filter("place NOT IN ('VIEW', 'ERROR')"), "taf")), "document", 3)
    both = feeds.aviation(seen, taf)
    return both.select("station", F.col("observation.observed_at").alias("last_seen"), F.coalesce(F.size("periods"), F.lit(0)).cast("long").alias("periods"), F.array_min(F.transform("periods", lambda p: p["start"])).alias("first_period"))


# ---- events near a place ----
@query("""SELECT n_name AS city, event_id, round(km, 3) AS km FROM (SELECT event_id, n_name, 2 * 6371 * asin(sqrt(power(sin(radians(value - 30) / 2), 2) + cos(radians(30)) * cos(radians(value)) * power(sin(radians(event_id % 60 - n_nationkey) / 2), 2))) AS km FROM events, nation WHERE n_nationkey < 3) WHERE km <= 500""")
def events_near_cities(spark, sf_dir):
    """Events of a feed within 500 km of each of three cities."""
    from stowage.functions.exprs import haversine_km

    e = events(spark, sf_dir)
    doc = F.struct(F.col("event_id").cast("string").alias("event_id"), F.lit("sports").alias("category"), F.col("value").alias("latitude"), (F.col("event_id") % 60).cast("double").alias("longitude"))
    path = stored(spark, e.select("place", "day", F.to_json(doc).alias("document")), "events_feed")
    found = feeds.parse_events(documents.feed(spark, "events_feed", path), "document")
    out = None
    for key in range(3):
        near = feeds.events_near(found, 30.0, float(key), 500.0).select(F.lit(key).alias("n_nationkey"), F.col("event_id").cast("long").alias("event_id"), haversine_km(F.col("latitude"), F.col("longitude"), F.lit(30.0), F.lit(float(key))).alias("km"))
        out = near if out is None else out.unionByName(near)
    names = B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), F.col("n_name").alias("city"))
    return rounded(out.join(names, "n_nationkey").select("city", "event_id", "km"), 3)


# ---- traffic files ----
def traffic_path(spark, sf_dir) -> str:
    """Line items as an on-time table, kept by year and month."""
    path = new_folder(spark, "traffic")
    li = B.table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_shipdate").alias("FL_DATE"), F.when(F.col("l_returnflag") == "R", "DL").otherwise("XX").alias("UNIQUE_CARRIER"), F.col("l_orderkey").alias("OP_CARRIER_FL_NUM"), F.col("l_linenumber").alias("TAIL_NUM"), F.col("l_quantity").alias("DEP_DELAY"), F.lit(1).alias("not_kept"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"))
    feeds.save_partitioned(rows, path)
    return path


@query("SELECT year(l_shipdate)::INT AS year, month(l_shipdate)::INT AS month, count(*) AS flights, round(sum(l_quantity), 2) AS delay FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL")
def carrier_traffic(spark, sf_dir):
    """All years of a partitioned traffic table, for one carrier."""
    path = traffic_path(spark, sf_dir)
    years = [r[0] for r in spark.read.parquet(path).select("year").distinct().orderBy("year").limit(100).collect()]
    out = None
    for year in years:
        rows = feeds.traffic(spark, path, year, carriers=("DL", "DELTA"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy(F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month")).agg(F.count(F.lit(1)).alias("flights"), F.round(F.sum("DEP_DELAY"), 2).alias("delay"))


@query("SELECT l_shipdate::DATE AS FL_DATE, l_orderkey AS OP_CARRIER_FL_NUM, l_linenumber AS TAIL_NUM, l_quantity AS DEP_DELAY FROM lineitem WHERE year(l_shipdate) = 1995 AND month(l_shipdate) = 3")
def on_time_month(spark, sf_dir):
    """One month's partition, and of its columns those that the on-time table keeps."""
    return feeds.on_time(spark, traffic_path(spark, sf_dir), 1995, 3).withColumn("FL_DATE", F.to_date("FL_DATE"))
