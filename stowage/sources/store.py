"""Tables: reading, appending and rewriting. Plain Parquet has no row DELETE or UPDATE, so those write a new version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The persisted tables. A map column holds what the row store kept as JSON.
SCHEMAS = {
    "positions": "id long, uld_id string, uld_type string, station string, ts timestamp_ntz, position_source string, flight_number string, latitude double, longitude double, location_type string, confidence double, created_at timestamp_ntz",
    "inventory": "id long, station string, ts timestamp_ntz, inventory map<string,int>, available map<string,int>, in_use map<string,int>, damaged map<string,int>, total_count int, total_available int, availability_ratio double",
    "forecasts": "id long, station string, forecast_type string, forecast_time timestamp_ntz, generated_at timestamp_ntz, granularity string, q05 double, q25 double, q50 double, q75 double, q95 double, by_type string, confidence string, is_anomaly boolean, model_version string, created_at timestamp_ntz",
    "recommendations": "recommendation_id string, priority string, uld_type string, quantity int, origin_station string, destination_station string, transport_method string, required_by timestamp_ntz, status string, executed_at timestamp_ntz",
    "flights": "flight_number string, airline string, origin string, destination string, scheduled_departure timestamp_ntz, scheduled_arrival timestamp_ntz, actual_departure timestamp_ntz, actual_arrival timestamp_ntz, status string, delay_minutes int, aircraft_type string, booked_passengers int, ulds_assigned array<string>",
    "runs": "run_id string, generated_at timestamp_ntz, solver_status string, total_moves int, total_units int, total_cost double, solve_seconds double, moves string",
}


def create(spark: SparkSession, base: str) -> None:
    """An empty table for each schema that isn't there yet."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{base}/{name}")


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{base}/{name}")


def append(rows: DataFrame, base: str, name: str) -> None:
    """Adds rows; columns that are missing are null."""
    schema = rows.sparkSession.createDataFrame([], SCHEMAS[name]).schema
    have = set(rows.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    rows.select(*cols).write.mode("append").parquet(f"{base}/{name}")


def rewrite(table: DataFrame, target: str) -> DataFrame:
    """Writes a table's next version to a path of its own and returns it; readers of the old one aren't disturbed."""
    table.write.mode("errorifexists").parquet(target)
    return table.sparkSession.read.schema(table.schema).parquet(target)


def without(table: DataFrame, gone: Column) -> DataFrame:
    """The rows for which a delete predicate isn't true."""
    return table.filter(~F.coalesce(gone, F.lit(False)))


def retained(table: DataFrame, time: str, as_of: Column, days: int = 90) -> DataFrame:
    return table.filter(F.col(time) >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))


def with_status(recs: DataFrame, recommendation_id: str, status: str, executed_at: Column | None = None) -> DataFrame:
    hit = F.col("recommendation_id") == recommendation_id
    out = recs.withColumn("status", F.when(hit, status).otherwise(F.col("status")))
    return out if executed_at is None else out.withColumn("executed_at", F.when(hit, executed_at).otherwise(F.col("executed_at")))


def with_forecast_defaults(rows: DataFrame) -> DataFrame:
    have = set(rows.columns)
    filled = {"granularity": F.lit("hourly"), "confidence": F.lit("medium"), "is_anomaly": F.lit(False)}
    return rows.withColumns({n: F.coalesce(F.col(n), d) if n in have else d for n, d in filled.items()})


def page(table: DataFrame, key: str, limit: int = 100, offset: int = 0) -> DataFrame:
    return table.orderBy(key).offset(offset).limit(limit)


def between(table: DataFrame, where: dict[str, object], time: str, start: Column, end: Column) -> DataFrame:
    """Rows of these key values in a closed interval, in order of time."""
    out = table.filter(F.col(time).between(start, end))
    for name, value in where.items():
        out = out.filter(F.col(name) == value)
    return out.orderBy(time)


def pending(recs: DataFrame, station: str | None = None) -> DataFrame:
    """Pending recommendations of a station (from or to it), most urgent first."""
    from stowage.functions.exprs import priority_rank

    out = recs.filter(F.col("status") == "pending")
    out = out if station is None else out.filter((F.col("origin_station") == station) | (F.col("destination_station") == station))
    return out.orderBy(priority_rank(F.col("priority")), "required_by", "recommendation_id")


def valid_rows(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows with valid and the names of the rules that they break; a null counts as a break."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return rows.withColumn("broken", broken).withColumn("valid", F.size("broken") == 0)


#: Checks of the domain's rows.
def uld_rules() -> dict[str, Column]:
    return {"uld_id": F.length("uld_id") >= 8, "owner_airline": F.col("owner_airline").rlike("^[A-Z]{2}$"), "current_station": F.col("current_station").isNull() | F.col("current_station").rlike("^[A-Z]{3}$")}


def position_rules() -> dict[str, Column]:
    lat, lon = F.col("latitude"), F.col("longitude")
    return {"station": F.col("station").rlike("^[A-Z]{3}$"), "latitude": lat.isNull() | lat.between(-90, 90), "longitude": lon.isNull() | lon.between(-180, 180), "confidence": F.col("confidence").between(0, 1)}


READERS: dict[str, Callable[..., DataFrame]] = {}


def reader(kind: str):
    """Registers a source under a name; names don't regard case."""
    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        READERS[kind.lower()] = f
        return f

    return keep


def source(kind: str, *args, **options) -> DataFrame:
    if kind.lower() not in READERS:
        raise ValueError(f"unknown source: {kind}")
    return READERS[kind.lower()](*args, **options)
