"""Registered queries that choose and list plans over given legs; each with SQL.  The views they run on are synthetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import planning, spatial
from ..sources import views as V
from .route_queries import NEAR_SQL, RADIUS, query

VEHICLE = planning.Vehicle(capacity=60.0, minimum=6.0, floor=9.0, per_m=0.0002)
COSTS = planning.Costs(overhead=300.0, stop=120.0, per_km=2.0)
SOFT = planning.Schedule(opens=9000.0, closes=11000.0, duration=2700.0, hard=False, miss=7200.0, per_s=0.5, while_charging=True)
HARD = planning.Schedule(opens=9000.0, closes=11000.0, duration=2700.0, hard=True, miss=7200.0, per_s=2.0, while_charging=False)

TRIPS_SQL = (
    "trips_v AS (SELECT o_orderkey AS trip, 20.0::DOUBLE + o_custkey % 40 AS energy, CAST(o_orderkey % 5 * 1000 AS DOUBLE) AS departs, CASE WHEN o_orderkey % 3 = 0 THEN CAST(9000 AS DOUBLE) END AS budget FROM orders)",
    "direct_v AS (SELECT o_orderkey AS trip, CAST(floor(o_totalprice) AS BIGINT) % 8000 + 1000 AS time_s, (CAST(floor(o_totalprice) AS BIGINT) % 8000 + 1000) * 25 AS length_m FROM orders WHERE o_orderkey % 29 <> 3)",
    """legs_v AS (SELECT l_orderkey AS trip, l_partkey AS site, l_suppkey % 3 <> 0 AS charges, l_partkey % 2 = 0 AS hosts, CAST(l_quantity AS BIGINT) * 90 + 500 AS time_in, CAST(l_quantity AS BIGINT) * 2200 + 9000 AS length_in,
         l_partkey % 71 * 80 + 400 AS time_out, l_partkey % 71 * 1900 + 8000 AS length_out FROM lineitem)""",
)


def _best_sql(s: planning.Schedule) -> str:
    seg = planning.charging_segments(VEHICLE.bands, VEHICLE.capacity)
    curve = lambda x: "CASE " + " ".join(f"WHEN {x} <= {b!r}::DOUBLE THEN {x} * {k!r}::DOUBLE + {c!r}::DOUBLE" for _, b, k, c in seg) + " END"
    earliest = "time_in + 300" if s.while_charging else "time_in + 300 + charging"
    starts = f"[{earliest}, greatest({earliest}, opens), greatest({earliest}, closes), greatest({earliest}, time_in + 300 + charging - {s.duration}::DOUBLE)]"
    listed = f"CASE WHEN hosts THEN {starts} ELSE [] END" if s.hard else f"CASE WHEN hosts THEN list_concat([CAST(NULL AS DOUBLE)], {starts}) ELSE [CAST(NULL AS DOUBLE)] END"
    straight = "" if s.hard else f"""SELECT trip, round(time_s + {s.miss}::DOUBLE + length_m * 2e0 / 1000, 7) AS cost, 0e0 AS charged, 0 AS stops, CAST(NULL AS BIGINT) AS site, CAST(NULL AS DOUBLE) AS start, CAST(time_s AS DOUBLE) AS clock
         FROM trips_v JOIN direct_v USING (trip) WHERE energy - length_m * 0.0002e0 >= 9 - 1e-8 AND coalesce(time_s <= budget + 1e-7, true) UNION ALL """
    return f"""SELECT trip, site, start, round(charged, 7) AS charged, round(clock, 6) AS clock, cost FROM (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY cost, charged, stops, site, start NULLS FIRST, clock) AS place FROM ({straight}
         SELECT trip, round(clock + 120 + penalty + (length_in + length_out) * 2e0 / 1000, 7) AS cost, needed AS charged, 1 AS stops, site, start, clock FROM (
           SELECT *, time_in + CASE WHEN start IS NULL THEN 300 + charging ELSE greatest(300 + charging, start - time_in + {s.duration}::DOUBLE) END + time_out AS clock, CASE WHEN start IS NULL THEN {s.miss}::DOUBLE ELSE off * {s.per_s}::DOUBLE END AS penalty FROM (
             SELECT *, greatest(opens - start, start - closes, 0) AS off FROM (SELECT *, unnest({listed}) AS start FROM (
               SELECT *, {curve('least(60e0, greatest(0e0, e_left + needed))')} - {curve('least(60e0, greatest(0e0, e_left))')} AS charging FROM (
                 SELECT *, greatest(0e0, length_out * 0.0002e0 + 9 - e_left) AS needed FROM (SELECT *, energy - length_in * 0.0002e0 AS e_left, {s.opens}::DOUBLE - departs AS opens, {s.closes}::DOUBLE - departs AS closes FROM trips_v JOIN legs_v USING (trip) WHERE trip IN (SELECT trip FROM direct_v) AND coalesce(time_in + time_out <= budget + 1e-7, true)))
               WHERE e_left >= 6 - 1e-8 AND e_left + needed <= 60 + 1e-8 AND (needed <= 1e-8 OR charges))))
           {"WHERE off <= 1e-8" if s.hard else ""}))) WHERE place = 1"""


def _best(spark, sf_dir, schedule):
    orders, lines = V.table(spark, sf_dir, "orders"), V.table(spark, sf_dir, "lineitem")
    trips = orders.selectExpr("o_orderkey AS trip", "20.0D + o_custkey % 40 AS energy", "CAST(o_orderkey % 5 * 1000 AS DOUBLE) AS departs", "CASE WHEN o_orderkey % 3 = 0 THEN 9000.0D END AS budget")
    time = "CAST(floor(o_totalprice) AS BIGINT) % 8000 + 1000"
    direct = orders.where("o_orderkey % 29 <> 3").selectExpr("o_orderkey AS trip", f"{time} AS time_s", f"({time}) * 25 AS length_m")
    legs = lines.selectExpr("l_orderkey AS trip", "l_partkey AS site", "l_suppkey % 3 <> 0 AS charges", "l_partkey % 2 = 0 AS hosts", "CAST(l_quantity AS BIGINT) * 90 + 500 AS time_in", "CAST(l_quantity AS BIGINT) * 2200 + 9000 AS length_in", "l_partkey % 71 * 80 + 400 AS time_out", "l_partkey % 71 * 1900 + 8000 AS length_out")
    found = planning.best_one_stop(trips, direct, legs, VEHICLE, COSTS, schedule)
    return found.select("trip", "site", "start", F.round("charged", 7).alias("charged"), F.round("clock", 6).alias("clock"), "cost")


@query(_best_sql(SOFT), *TRIPS_SQL)
def best_one_stop(spark, sf_dir):
    """Cheapest plan with at most one stop, an activity that may be missed or shifted, and charging at falling power."""
    return _best(spark, sf_dir, SOFT)


@query(_best_sql(HARD), *TRIPS_SQL)
def best_scheduled_stop(spark, sf_dir):
    """The same with an activity that has to start in its window, after charging."""
    return _best(spark, sf_dir, HARD)


TASK = planning.Task({1: 1200.0, 2: 2700.0}, near_m=1.9e6, most_time=2200, most_length=2600, together_m=900)
BASE = (9000.0, 30000.0, 26000.0)


@query(
    """SELECT first, second, time_s, length_m, time_s - 9e3 AS extra_time, length_m - 3e4 AS extra_length, stops, CASE WHEN concurrent > 0 THEN 27e2 ELSE 39e2 END AS dwell, risk, concurrent FROM (
         SELECT id AS first, CAST(-1 AS BIGINT) AS second, time_in + time_out AS time_s, length_in + length_out AS length_m, risk, 2 AS concurrent, 1 AS stops FROM stops_v WHERE mask = 3
         UNION ALL SELECT l.a, l.b, s.time_in + l.leg_s + e.time_out, s.length_in + l.leg_m + e.length_out, greatest(s.risk, e.risk), l.together, 2 FROM ways_v l JOIN stops_v s ON s.id = l.a JOIN stops_v e ON e.id = l.b WHERE (s.mask | e.mask) = 3 AND l.leg_s <= 2200 AND l.distance <= 2600) WHERE time_s <= 26000 AND length_m IS NOT NULL AND risk = 0""",
    V.POINTS_SQL, NEAR_SQL,
    "stops_v AS (SELECT id, CAST(id % 3 + 1 AS INTEGER) AS mask, CAST(CASE WHEN id % 7 = 0 THEN 2 WHEN id % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS risk, CASE WHEN id % 31 <> 4 THEN abs(x) END AS time_in, abs(x) * 3 AS length_in, abs(y) AS time_out, abs(y) * 2 AS length_out FROM points_v)",
    "both_v AS (SELECT a, b, d2, d2 // 900 AS distance_there, CASE WHEN (a + b) % 13 <> 0 THEN d2 // 800 + a % 5 END AS distance_back FROM near_v WHERE a < b AND d2 <= 1900000)",
    "ways_v AS (SELECT a, b, distance_there AS distance, d2 // 1000 + a % 7 AS leg_s, d2 // 1100 + b % 9 AS leg_m, coalesce(CAST(greatest(distance_there, distance_back) <= 900 AND distance_back IS NOT NULL AS INTEGER), 0) AS together FROM both_v UNION ALL SELECT b, a, distance_back, d2 // 1000 + b % 11, d2 // 1050, coalesce(CAST(greatest(distance_there, distance_back) <= 900 AND distance_back IS NOT NULL AS INTEGER), 0) FROM both_v)",
)
def paired_plans(spark, sf_dir):
    """Plans of one or two stops with their time, length, dwell, access risk and concurrency, those with any risk left out."""
    points = V.points(spark, sf_dir)
    stops = points.selectExpr("id", "CAST(id % 3 + 1 AS INT) AS mask", "CASE WHEN id % 7 = 0 THEN 2 WHEN id % 5 = 0 THEN 1 ELSE 0 END AS risk", "CASE WHEN id % 31 <> 4 THEN abs(x) END AS time_in", "abs(x) * 3 AS length_in", "abs(y) AS time_out", "abs(y) * 2 AS length_out")
    pairs = spatial.pairs_within(points, RADIUS).selectExpr(
        "a", "b", "d2 AS near_m", "d2 div 900 AS distance_there", "CASE WHEN (a + b) % 13 <> 0 THEN d2 div 800 + a % 5 END AS distance_back",
        "d2 div 1000 + a % 7 AS time_there", "d2 div 1000 + b % 11 AS time_back", "d2 div 1100 + b % 9 AS length_there", "d2 div 1050 AS length_back",
    )
    return planning.paired_plans(stops, pairs, BASE, TASK, access="conservative", dwell="concurrent")
