"""Repositioning: costs, priorities, recommendations, station plans and the greedy allocation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions import exprs as X
from stowage.functions.bounds import small

GROUND, FLIGHT, HANDLING, SHORTAGE, DELAY_MINUTE, DELAY_MINUTES = 150.0, 50.0, 25.0, 500.0, 100.0, 30.0
KM_COST, MOVE_REVENUE, MOVE_CAP, CRUISE_KMH = 0.05, 250.0, 20, 800.0


def cost_benefit(quantity: Column, p: Column, method: Column) -> dict[str, Column]:
    """Costs and benefits of moving quantity units to a station short with probability p; roi is null at no cost."""
    transport = F.when(method == "ground", GROUND).otherwise(FLIGHT) * quantity
    avoided = quantity * p * SHORTAGE
    cost, benefit = transport + HANDLING * 2 * quantity, avoided * 1.5 + p * DELAY_MINUTES * DELAY_MINUTE
    return {"total_cost": cost, "total_benefit": benefit, "net_benefit": benefit - cost, "roi": F.try_divide(benefit - cost, cost)}


def prioritize(recs: DataFrame, max_moves: int = 10, min_roi: float = 0.0) -> DataFrame:
    """The best max_moves by priority, probability and net benefit among those of enough or no roi."""
    kept = recs.filter(F.col("roi").isNull() | (F.col("roi") >= min_roi))
    return kept.orderBy(X.priority_rank(F.col("priority")), F.desc("shortage_probability"), F.desc("net_benefit"), "rec_id").limit(max_moves)


def repositioning(imbalances: DataFrame) -> DataFrame:
    """For every short station the station with the largest surplus; surplus isn't used up.

    imbalances: station, q50, p. All short stations get the same best one but themselves, so the two largest surpluses
    are enough; they are two rows.
    """
    surplus = imbalances.filter((F.col("p") <= 0.5) & (F.col("q50") > 10)).select(F.col("station").alias("origin"), F.col("q50").alias("surplus"))
    best = surplus.orderBy(F.desc("surplus"), "origin").limit(1)
    short = imbalances.filter(F.col("p") > 0.5)
    rows = short.join(F.broadcast(best), F.col("origin") != F.col("station"))
    rows = rows.withColumn("quantity", F.least(F.abs(F.col("q50").cast("int")), F.col("surplus").cast("int"))).filter("quantity > 0")
    return rows.select("origin", F.col("station").alias("destination"), "quantity", F.col("p").alias("shortage_probability"), X.priority(F.col("p")).alias("priority"))


def allocation(flights: DataFrame, estimate: int = 8) -> DataFrame:
    """Flights with fewer units than the estimate: how many more, high priority above 4."""
    gap = estimate - F.col("allocated")
    return flights.filter(F.col("allocated") < estimate).withColumn("quantity", gap).withColumn("priority", F.when(gap > 4, "high").otherwise("medium"))


def station_plan(recs: DataFrame) -> DataFrame:
    """Per station: units and cost out, units and benefit in, from (origin, destination, quantity, cost, benefit)."""
    out = recs.groupBy(F.col("origin").alias("station")).agg(F.sum("quantity").alias("units_out"), F.sum("cost").alias("cost_out"), F.count(F.lit(1)).alias("moves_out"))
    into = recs.groupBy(F.col("destination").alias("station")).agg(F.sum("quantity").alias("units_in"), F.sum("benefit").alias("benefit_in"), F.count(F.lit(1)).alias("moves_in"))
    return out.join(into, "station", "full").na.fill(0)


def plan_flags(recs: DataFrame, allocations: DataFrame | None = None) -> DataFrame:
    """Per station: number of actions (moves out, moves in, allocations) and whether a move is critical.

    recs: origin, destination, priority. allocations: station.
    """
    ends = recs.select(F.explode(F.array("origin", "destination")).alias("station"), (F.col("priority") == "critical").alias("critical"))
    if allocations is not None:
        ends = ends.unionByName(allocations.select("station", F.lit(False).alias("critical")))
    return ends.groupBy("station").agg(F.count(F.lit(1)).alias("action_count"), F.coalesce(F.bool_or("critical"), F.lit(False)).alias("has_critical"))


def action_plan(stocks: DataFrame, recs: DataFrame, as_of: Column, allocations: DataFrame | None = None, valid_hours: int = 4) -> DataFrame:
    """Per station of stocks: moves, flags, validity, and for each type the stock left when demand is met.

    stocks: station, uld_type, demand, supply, one row a type. recs: origin, destination, quantity, cost, benefit, priority.
    A station's array of types is as long as the list of types.
    """
    units = [F.col(c).cast("int") for c in ("demand", "supply")]
    left = F.struct("uld_type", units[0].alias("demand"), units[1].alias("supply"), F.greatest(F.lit(0), units[1] - units[0]).alias("end_inventory"))
    types = stocks.groupBy("station").agg(F.array_sort(F.collect_list(left)).alias("types"))
    out = types.join(station_plan(recs), "station", "left").join(plan_flags(recs, allocations), "station", "left")
    out = out.na.fill(0).na.fill(False, ["has_critical"])
    return out.withColumns({"generated_at": as_of, "valid_until": as_of + F.make_dt_interval(hours=F.lit(valid_hours))})


def optimizer_totals(first: DataFrame, recs: DataFrame, status: str = "feasible", least: float = 0.3) -> DataFrame:
    """One row: cost of the shortages to be feared, of transport and of handling, their sum, units moved, status.

    first: imbalance_q05, shortage_probability of each station. recs: quantity, method. Both are summed before they meet.
    """
    feared = F.when(F.col("shortage_probability") > least, F.abs("imbalance_q05") * SHORTAGE * F.col("shortage_probability")).otherwise(0.0)
    zero = F.lit(0.0)
    shortage = first.agg(F.sum(feared).alias("shortage_cost"), zero.alias("transport_cost"), zero.alias("handling_cost"), F.lit(0).cast("long").alias("units_moved"))
    transport = F.when(F.col("method") == "ground", GROUND).otherwise(FLIGHT) * F.col("quantity")
    moves = recs.agg(zero.alias("shortage_cost"), F.sum(transport).alias("transport_cost"), F.sum(HANDLING * 2 * F.col("quantity")).alias("handling_cost"), F.sum("quantity").cast("long").alias("units_moved"))
    sums = shortage.unionByName(moves).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in shortage.columns])
    total = F.col("shortage_cost") + F.col("transport_cost") + F.col("handling_cost")
    return sums.withColumns({"total_system_cost": total, "solver_status": F.lit(status), "is_optimal": F.lit(status == "optimal")})


def summary(recs: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("priority") == p).alias(p) for p in ("critical", "high", "medium", "low")]
    return recs.agg(F.count(F.lit(1)).alias("recommendations"), *counts, F.sum("quantity").alias("quantity"), F.sum("total_cost").alias("cost"), F.sum("total_benefit").alias("benefit"), F.sum("net_benefit").alias("net"))


def deduplicate(recs: DataFrame) -> DataFrame:
    by = Window.partitionBy("origin", "destination", "uld_type").orderBy("rec_id")
    return recs.withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r")


def validate_moves(moves: DataFrame, capacities: DataFrame, least: int = 1, most: int = 20) -> DataFrame:
    """moves with ok and the first reason against."""
    rows = moves.join(capacities, ["origin", "destination"], "left")
    reason = F.when(F.col("quantity") < least, "below minimum").when(F.col("quantity") > most, "above maximum").when(F.col("quantity") > F.col("capacity"), "route capacity")
    return rows.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def nearest_surplus(imbalances: DataFrame, distances: DataFrame, default_km: float = 1500.0) -> DataFrame:
    """Every short station's nearest station with a surplus above 5. Stations are a bounded dimension, sent to all."""
    surplus = imbalances.filter("q50 > 5").select(F.col("station").alias("origin"), F.col("q50").cast("int").alias("surplus"))
    short = imbalances.filter("q50 < 0").select(F.col("station").alias("destination"), F.abs(F.col("q50").cast("int")).alias("shortage"))
    pairs = short.join(small(surplus), F.col("origin") != F.col("destination"))
    km = pairs.join(distances, ["origin", "destination"], "left").withColumn("km", F.coalesce("km", F.lit(default_km)))
    by = Window.partitionBy("destination").orderBy("km", "origin")
    return km.withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r")


def greedy_moves(networks: DataFrame, distances: DataFrame, max_moves: int = 3, rounds: int = 100, default_km: float = 1500.0) -> DataFrame:
    """Greedy allocation per network: largest shortage first, from the nearest surplus, at most MOVE_CAP units a move.

    networks: network, station, q50. Each step depends on the last, over the stations of one network: one small group a network,
    all networks in parallel. distances is a small table and goes to every group.
    """
    if distances.limit(100_001).count() > 100_000:
        raise ValueError("distances must be a small table")
    km = {(r["origin"], r["destination"]): r["km"] for r in distances.collect()}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        short = {r.station: abs(int(r.q50)) for r in pdf.itertuples() if r.q50 < 0}
        extra = {r.station: int(r.q50) for r in pdf.itertuples() if r.q50 > 5}
        most, moves = max_moves * len(short), []
        for _ in range(rounds):
            needy = [(-n, s) for s, n in short.items() if n > 0]
            if not needy or len(moves) >= most:
                break
            to = min(needy)[1]
            near = [(km.get((s, to), default_km), s) for s, n in extra.items() if n > 0 and s != to]
            if not near:
                break
            d, origin = min(near)
            n = min(short[to], extra[origin], MOVE_CAP)
            short[to] -= n
            extra[origin] -= n
            moves.append((pdf["network"].iloc[0], len(moves) + 1, origin, to, n, d))
        return pd.DataFrame(moves, columns=["network", "step", "origin", "destination", "quantity", "km"])

    return networks.groupBy("network").applyInPandas(solve, "network string, step int, origin string, destination string, quantity int, km double")


def move_economics(moves: DataFrame, imbalances: DataFrame) -> DataFrame:
    """Costs, revenue, hours and priority of moves by distance."""
    p = imbalances.select("network", F.col("station").alias("destination"), "p")
    rows = moves.join(p, ["network", "destination"], "left")
    level = F.when(F.col("p") > 0.8, "critical").when(F.col("p") > 0.5, "high").otherwise("medium")
    return rows.withColumns({
        "transport": KM_COST * F.col("quantity") * F.col("km"), "handling": HANDLING * 2 * F.col("quantity"), "avoided": F.col("quantity") * F.col("p") * SHORTAGE,
        "revenue": F.col("quantity") * F.col("p") * MOVE_REVENUE, "hours": F.col("km") / CRUISE_KMH, "priority": level,
    })


def ids(rows: DataFrame, prefix: str, day: str, order: list[str]) -> DataFrame:
    """Ids PREFIX-day-00001 by an explicit order within each day."""
    n = F.row_number().over(Window.partitionBy(day).orderBy(*order))
    return rows.withColumn("rec_id", F.format_string(f"{prefix}-%s-%05d", F.date_format(day, "yyyyMMdd"), n))




def station_actions(recs: DataFrame) -> DataFrame:
    """(station, actions, units, has_critical, leaving) over what leaves and what comes; a recommendation counts at both ends, and combines before its shuffle."""
    ends = F.explode(F.array(F.struct(F.col("origin").alias("station"), F.lit(True).alias("out")), F.struct(F.col("destination").alias("station"), F.lit(False).alias("out"))))
    rows = recs.select(ends.alias("e"), "quantity", (F.col("priority") == "critical").alias("critical")).select("e.*", "quantity", "critical")
    return rows.groupBy("station").agg(F.count(F.lit(1)).alias("actions"), F.sum("quantity").cast("long").alias("units"), F.bool_or("critical").alias("has_critical"), F.count_if("out").alias("leaving"))


COSTS_RESPONSE = "total_cost double, avoided_shortage_cost double, total_benefit double, net_benefit double, roi double"
RESPONSE = f"recommendation_id string, priority string, quantity int, origin_station string, destination_station string, transport_method string, shortage_probability double, cost_benefit struct<{COSTS_RESPONSE.replace(' double', ':double')}>"


def responses(recs: DataFrame) -> DataFrame:
    """(rec_id, response): each recommendation as a JSON object with its costs and benefits nested."""
    costs = F.struct("total_cost", (F.col("quantity") * F.col("shortage_probability") * SHORTAGE).alias("avoided_shortage_cost"), "total_benefit", "net_benefit", "roi")
    one = F.struct(
        F.col("rec_id").cast("string").alias("recommendation_id"), "priority", "quantity", F.col("origin").alias("origin_station"), F.col("destination").alias("destination_station"), F.col("method").alias("transport_method"), "shortage_probability", costs.alias("cost_benefit"),
    )
    return recs.select("rec_id", F.to_json(one).alias("response"))
