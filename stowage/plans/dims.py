"""Fixed values that results depend on, and the small dimension tables made from them."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: code, icao, name, city, tier, latitude, longitude, time zone, departures and arrivals a day, dwell hours. Fixed values.
STATIONS = (
    ("ATL", "KATL", "Hartsfield-Jackson Atlanta International", "Atlanta", "hub", 33.6407, -84.4277, "America/New_York", 450, 6.0),
    ("DTW", "KDTW", "Detroit Metropolitan Wayne County", "Detroit", "hub", 42.2124, -83.3534, "America/Detroit", 200, 8.0),
    ("MSP", "KMSP", "Minneapolis-Saint Paul International", "Minneapolis", "hub", 44.8820, -93.2218, "America/Chicago", 180, 10.0),
    ("SLC", "KSLC", "Salt Lake City International", "Salt Lake City", "hub", 40.7884, -111.9778, "America/Denver", 150, 8.0),
    ("JFK", "KJFK", "John F. Kennedy International", "New York", "focus_city", 40.6413, -73.7781, "America/New_York", 120, 12.0),
    ("LAX", "KLAX", "Los Angeles International", "Los Angeles", "focus_city", 33.9416, -118.4085, "America/Los_Angeles", 100, 14.0),
    ("SEA", "KSEA", "Seattle-Tacoma International", "Seattle", "focus_city", 47.4502, -122.3088, "America/Los_Angeles", 80, 12.0),
    ("BOS", "KBOS", "Boston Logan International", "Boston", "focus_city", 42.3656, -71.0096, "America/New_York", 70, 14.0),
)
#: Further airports of the weather feeds: icao, latitude, longitude. Fixed values.
AIRPORTS = (
    ("KLGA", 40.7769, -73.8740), ("KDCA", 38.8512, -77.0402), ("KEWR", 40.6895, -74.1745), ("KORD", 41.9742, -87.9073), ("KSFO", 37.6213, -122.3790), ("KMIA", 25.7959, -80.2870),
    ("KDFW", 32.8998, -97.0403), ("KDEN", 39.8561, -104.6737), ("KPHX", 33.4373, -112.0078), ("EGLL", 51.4700, -0.4543), ("LFPG", 49.0097, 2.5479), ("EHAM", 52.3105, 4.7683),
)
#: icao, iata, name, widebody, lower-deck positions, compatible types, most cargo kg. Fixed values.
AIRCRAFT = (
    ("B738", "738", "Boeing 737-800", False, 0, [], 2000),
    ("A321", "321", "Airbus A321", False, 0, [], 2500),
    ("B763", "763", "Boeing 767-300", True, 8, ["AKE", "AKH", "PMC"], 15000),
    ("A333", "333", "Airbus A330-300", True, 10, ["AKE", "AKH", "PMC", "AKN"], 18000),
    ("A359", "359", "Airbus A350-900", True, 12, ["AKE", "AKH", "PMC", "AKN"], 20000),
    ("B77W", "77W", "Boeing 777-300ER", True, 14, ["AKE", "AKH", "PMC", "AKN"], 25000),
)
#: type, gross kg, tare kg, volume m3, height, width, length cm. Fixed values.
CONTAINERS = (("AKE", 1588, 83, 4.3, 163, 153, 156), ("AKH", 1588, 85, 4.3, 163, 153, 156), ("PMC", 6804, 120, 11.5, 163, 244, 318), ("AKN", 5035, 170, 9.9, 163, 244, 317))
CONTAINER_TYPES = ("AKE", "AKH", "DPE", "AKN", "AAP", "ALP", "PMC", "PAG", "PLA", "RKN", "HMA", "AKC")
STATUSES = ("serviceable", "in_use", "empty", "damaged", "out_of_service", "in_transit", "customs_hold")
#: Shares of the fleet by type. Fixed values.
TYPE_MIX = (("AKE", 0.50), ("AKH", 0.15), ("PMC", 0.20), ("AKN", 0.10), ("AAP", 0.05))
#: Kilometres between stations, either way. Fixed values.
DISTANCES = (
    ("ATL", "DTW", 1000), ("ATL", "MSP", 1500), ("ATL", "SLC", 2500), ("ATL", "JFK", 1200), ("ATL", "LAX", 3100), ("DTW", "MSP", 900), ("DTW", "SLC", 2200), ("DTW", "JFK", 800),
    ("MSP", "SLC", 1700), ("MSP", "SEA", 2500), ("SLC", "LAX", 1000), ("SLC", "SEA", 1100), ("JFK", "BOS", 300), ("JFK", "LAX", 4000), ("LAX", "SEA", 1500),
)
DEFAULT_DISTANCE = 1500
#: Units and weights by tier and kind of event. Fixed values.
SAFETY_STOCK = {"hub": 50, "focus_city": 30, "spoke": 10, "international": 20}
BASE_DEMAND = {"hub": 100.0, "focus_city": 40.0, "spoke": 10.0, "international": 25.0}
DAILY_DEMAND = {"hub": 150.0, "focus_city": 50.0, "spoke": 15.0, "international": 35.0}
EVENT_WEIGHTS = {"sports": 1.0, "concerts": 0.9, "conferences": 0.7, "festivals": 0.8, "community": 0.3, "expos": 0.6, "performing-arts": 0.5}
#: scenario -> (hours, base impact). Fixed values.
SCENARIOS = {
    "weather_snow": (18, 0.4), "weather_thunderstorm": (4, 0.5), "weather_fog": (6, 0.6), "weather_hurricane": (48, 0.1), "demand_spike": (72, 1.5), "demand_drop": (48, 0.7),
    "capacity_ground_stop": (3, 0.0), "capacity_reduced": (8, 0.5), "equipment_shortage": (24, 0.8), "equipment_excess": (24, 1.0), "event_sports": (48, 1.3), "event_convention": (96, 1.2), "event_concert": (24, 1.1),
}
#: Shares of the kinds of random disruptions, and weights of the tiers they strike. Fixed values.
SCENARIO_SHARES = {
    "weather_snow": 0.15, "weather_thunderstorm": 0.20, "weather_fog": 0.10, "weather_hurricane": 0.02, "demand_spike": 0.15, "demand_drop": 0.08,
    "capacity_ground_stop": 0.05, "capacity_reduced": 0.05, "equipment_shortage": 0.05, "equipment_excess": 0.05, "event_sports": 0.05, "event_convention": 0.03, "event_concert": 0.02,
}
SCENARIO_TIERS = {"hub": 5.0, "focus_city": 3.0, "spoke": 1.0, "international": 2.0}
#: Regional disruptions: stations, season, hour of start, hours, lag of a station in hours, severity and its least share, impact, flights and units an hour (times severity or not). Fixed values.
REGIONAL = {
    "winter_storm": {"kind": "weather_snow", "stations": ("JFK", "LGA", "BOS", "EWR"), "season": "winter", "hour": None, "hours": (8.0, 24.0), "lag": 4.0, "severity": 0.7, "least": 0.8, "impact": 0.3, "flights": 8, "units": 60, "by_severity": False, "text": "Heavy snowfall"},
    "thunderstorm": {"kind": "weather_thunderstorm", "stations": ("ATL",), "season": "summer", "hour": 15, "hours": (2.0, 6.0), "lag": 0.0, "severity": 0.6, "least": 1.0, "impact": 0.5, "flights": 15, "units": 100, "by_severity": False, "text": "Ground stops by thunderstorms"},
    "demand_spike": {"kind": "event_sports", "stations": ("ATL",), "season": None, "hour": None, "hours": (72.0, 72.0), "lag": 0.0, "severity": 0.5, "least": 1.0, "impact": 1.5, "flights": 0, "units": 10, "by_severity": True, "text": "Increased demand"},
}
#: WMO code -> condition. Fixed values.
WMO = {
    0: "clear", 1: "mainly_clear", 2: "partly_cloudy", 3: "overcast", 45: "fog", 48: "fog", 51: "drizzle", 53: "drizzle", 55: "drizzle", 61: "rain", 63: "rain", 65: "heavy_rain", 71: "snow", 73: "snow",
    75: "heavy_snow", 77: "snow_grains", 80: "rain_showers", 81: "rain_showers", 82: "heavy_rain_showers", 85: "snow_showers", 86: "heavy_snow_showers", 95: "thunderstorm", 96: "thunderstorm_hail", 99: "thunderstorm_hail",
}


def lookup(values: dict, key: Column, default=None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def tier_of(code: Column) -> Column:
    up = F.upper(code)
    hubs, focus = ([s[0] for s in STATIONS if s[4] == t] for t in ("hub", "focus_city"))
    return F.when(up.isin(hubs), "hub").when(up.isin(focus), "focus_city").when((F.length(up) == 3) & ~up.startswith("K"), "international").otherwise("spoke")


def flight_category(code: Column) -> Column:
    return F.when(code.isin(45, 48, 95, 96, 99), "IFR").when(code >= 51, "MVFR").otherwise("VFR")


def stations(spark: SparkSession) -> DataFrame:
    rows = [(*s[:4], "US", *s[4:8], s[8], s[8], s[9]) for s in STATIONS]
    return spark.createDataFrame(rows, "code string, icao string, name string, city string, country string, tier string, latitude double, longitude double, timezone string, departures int, arrivals int, dwell_hours double")


def airports(spark: SparkSession) -> DataFrame:
    """Coordinates of the stations and of the further airports, by icao code."""
    return spark.createDataFrame([(s[1], s[5], s[6]) for s in STATIONS] + list(AIRPORTS), "icao string, latitude double, longitude double")


def aircraft(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(AIRCRAFT), "icao string, iata string, name string, is_widebody boolean, positions int, types array<string>, max_cargo_kg int")


def containers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CONTAINERS), "uld_type string, gross_kg int, tare_kg int, volume_m3 double, height_cm int, width_cm int, length_cm int").withColumn("payload_kg", F.col("gross_kg") - F.col("tare_kg"))


def type_mix(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TYPE_MIX), "uld_type string, share double")


def distances(spark: SparkSession) -> DataFrame:
    """Both directions, and each station to itself."""
    rows = [(a, b, float(d)) for a, b, d in DISTANCES] + [(b, a, float(d)) for a, b, d in DISTANCES] + [(s[0], s[0], 0.0) for s in STATIONS]
    return spark.createDataFrame(rows, "origin string, destination string, km double")


def federal_holidays(first: date, last: date) -> list[date]:
    """Observed US federal holidays by rule, Saturday on the day before and Sunday on the day after."""
    def nth(year: int, month: int, weekday: int, n: int) -> date:
        start = date(year, month, 1)
        return start + timedelta(days=(weekday - start.weekday()) % 7 + 7 * (n - 1))

    out = set()
    for year in range(first.year - 1, last.year + 2):
        memorial = nth(year, 5, 0, 5) if nth(year, 5, 0, 5).month == 5 else nth(year, 5, 0, 4)
        fixed = [date(year, 1, 1), *([date(year, 6, 19)] if year >= 2021 else []), date(year, 7, 4), date(year, 11, 11), date(year, 12, 25)]
        out |= {d - timedelta(days=1) if d.weekday() == 5 else d + timedelta(days=1) if d.weekday() == 6 else d for d in fixed}
        out |= {*([nth(year, 1, 0, 3)] if year >= 1986 else []), nth(year, 2, 0, 3), memorial, nth(year, 9, 0, 1), nth(year, 10, 0, 2), nth(year, 11, 3, 4)}
    return sorted(d for d in out if first <= d <= last)
