"""The test tables as the engine's inputs: which column plays which part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.plans import dims

AS_OF = "2024-01-31 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("uld_id"), F.col("event_type").alias("station"), "ts", F.col("event_id").alias("id"), "value")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as assets: station the priority, type by customer, status by order status."""
    status = F.when(F.col("o_orderstatus") == "F", "serviceable").when(F.col("o_orderstatus") == "O", "in_use").otherwise("damaged")
    kind = F.element_at(F.array(*[F.lit(t) for t, _ in dims.TYPE_MIX]), (F.col("o_custkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("uld_id"), F.col("o_orderpriority").alias("station"), kind.alias("uld_type"), status.alias("status"))


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series: units shipped by return flag."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("k"), F.to_date("l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("y"))


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as flights from the customer's nation to the supplier's."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("departure"), "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("origin"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("destination"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", F.col("l_shipdate").alias("arrival"), F.col("l_quantity").alias("units"), F.col("l_extendedprice").alias("freight"))
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.col("l_orderkey").alias("flight_number"), "l_linenumber", "l_suppkey", "origin", "destination", "departure", "arrival", "units", "freight", "o_orderstatus")


def hourly_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals, departures and demand of 8 stations for every hour between the first and last event."""
    cents = F.round(F.col("value") * 100).cast("long")
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("station_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("forecast_time"), "event_type", cents.alias("v"))
    total = lambda *kinds: F.sum(F.when(F.col("event_type").isin(*kinds), F.col("v")).otherwise(0))
    sums = e.groupBy("station_id", "forecast_time").agg(total("click", "signup").alias("a"), total("view", "purchase").alias("d"), total("purchase").alias("q"))
    span = e.agg(F.min("forecast_time").alias("lo"), F.max("forecast_time").alias("hi"))
    hours = span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("forecast_time"))
    grid = hours.withColumn("station_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    rows = grid.join(sums, ["station_id", "forecast_time"], "left")
    part = lambda c: (F.coalesce(c, F.lit(0)) / 100.0).cast("double")
    return rows.select("station_id", "forecast_time", part("a").alias("arrivals"), part("d").alias("departures"), part("q").alias("demand"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The demand series against its value a week of rows before, with a band of a tenth: k, d, y, yhat, lower, upper."""
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("d")
    rows = demand(spark, sf_dir).withColumn("yhat", F.lag("y", 7).over(w)).filter("yhat IS NOT NULL")
    return rows.withColumns({"lower": F.col("yhat") * 0.5, "upper": F.col("yhat") * 1.5})


def station_imbalances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as stations: account balances of suppliers less customers, scaled; p from the sign and size."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n")).agg(F.count(F.lit(1)).alias("c"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n")).agg((F.count(F.lit(1)) * 15).alias("s"))
    both = c.join(s, "n", "full").select(F.col("n").cast("string").alias("station"), (F.coalesce("s", F.lit(0)) - F.coalesce("c", F.lit(0))).cast("double").alias("q50"))
    p = F.when(F.col("q50") < -20, 0.9).when(F.col("q50") < -10, 0.7).when(F.col("q50") < 0, 0.55).otherwise(0.1)
    return both.withColumn("p", p)
