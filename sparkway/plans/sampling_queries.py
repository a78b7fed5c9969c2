"""Registered queries that sample trips and walks on the grid of streets; each with SQL.  The views they run on are synthetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import roads, sampling, tables
from ..sources import views as V
from .region_queries import STREET_BACK, STREET_TIMES, _side, keyed
from .route_queries import query

BANDS, PER_BAND, SNAP = ((200, 500), (500, 900), (900, 1400)), 5, 60
# Where attempts start and end: by what an order holds.
_AX, _AY, _BX, _BY = "o_custkey * 7919 + o_orderkey * 13", "o_custkey * 104729 + o_orderkey * 17", "o_custkey * 7919 + o_orderkey * 13 + o_orderkey * 31 % 1301 - 650", "o_custkey * 104729 + o_orderkey * 17 + o_orderkey * 37 % 1303 - 651"
TRIES_SQL = f"tries_v AS (SELECT o_orderkey AS attempt, ({_AX}) % (side * 100) AS ax, ({_AY}) % (side * 100) AS ay, ({_BX}) % (side * 100) AS bx, ({_BY}) % (side * 100) AS by_ FROM orders, side_v)"


def _spots(spark, sf_dir):
    side = _side(spark, sf_dir)
    return V.table(spark, sf_dir, "part").where(f"p_partkey < {side * side}").selectExpr("p_partkey AS id", f"p_partkey % {side} * 100 AS x", f"p_partkey div {side} * 100 AS y")


@query(
    """SELECT f.band, CAST(f.place AS INTEGER) AS place, f.attempt, f.origin, f.destination, f.length_m, t.dist AS time_s FROM first_v f JOIN times_v t ON t.origin = f.origin AND t.node = f.destination""",
    V.STREETS_SQL, TRIES_SQL,
    "spots_v AS (SELECT p_partkey AS id, p_partkey % side * 100 AS x, p_partkey // side * 100 AS y FROM part, side_v WHERE p_partkey < side * side)",
    "there_v AS (SELECT side * side // 2 + side // 3 AS node FROM side_v UNION SELECT e.target FROM there_v t JOIN streets_v e ON e.source = t.node)",
    "here_v AS (SELECT side * side // 2 + side // 3 AS node FROM side_v UNION SELECT e.source FROM here_v t JOIN streets_v e ON e.target = t.node)",
    f"ends_v AS (SELECT attempt, 0 AS side_of, ax AS x, ay AS y FROM tries_v UNION ALL SELECT attempt, 1, bx, by_ FROM tries_v)",
    f"snapped_v AS MATERIALIZED (SELECT attempt, side_of, arg_min(s.id, ((e.x - s.x) * (e.x - s.x) + (e.y - s.y) * (e.y - s.y), s.id)) AS node FROM ends_v e JOIN spots_v s ON s.x BETWEEN e.x - {SNAP} AND e.x + {SNAP} AND s.y BETWEEN e.y - {SNAP} AND e.y + {SNAP} WHERE (e.x - s.x) * (e.x - s.x) + (e.y - s.y) * (e.y - s.y) <= {SNAP * SNAP} GROUP BY attempt, side_of)",
    "trips_v AS MATERIALIZED (SELECT a.node AS origin, b.node AS destination, min(a.attempt) AS attempt FROM snapped_v a JOIN snapped_v b ON b.attempt = a.attempt AND b.side_of = 1 WHERE a.side_of = 0 AND a.node <> b.node AND a.node IN (SELECT node FROM there_v) AND a.node IN (SELECT node FROM here_v) AND b.node IN (SELECT node FROM there_v) AND b.node IN (SELECT node FROM here_v) GROUP BY a.node, b.node)",
    keyed("lengths_v", "origin, node", "SELECT DISTINCT origin, origin, CAST(0 AS BIGINT) FROM trips_v", "streets_v", "e.source = w.node", "e.target", "e.length_m", f"w.dist + e.length_m < {BANDS[-1][1]}"),
    f"first_v AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY attempt) AS place FROM (SELECT t.*, l.dist AS length_m, CASE {' '.join(f'WHEN l.dist >= {a} AND l.dist < {b} THEN {k}' for k, (a, b) in enumerate(BANDS))} END AS band FROM trips_v t JOIN lengths_v l ON l.origin = t.origin AND l.node = t.destination) WHERE band IS NOT NULL) WHERE place <= {PER_BAND})",
    "starts_v AS (SELECT DISTINCT origin FROM first_v)", STREET_TIMES,
)
def trip_instances(spark, sf_dir):
    """Trips between sampled points, snapped to the strong component, the first of each band of lengths."""
    side = _side(spark, sf_dir)
    span = side * 100
    tries = V.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS attempt", f"({_AX}) % {span} AS ax", f"({_AY}) % {span} AS ay", f"({_BX}) % {span} AS bx", f"({_BY}) % {span} AS by")
    edges, spots = V.streets(spark, sf_dir), _spots(spark, sf_dir)
    classes = roads.strong_classes(spots, edges)
    largest = classes.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("component", F.struct("n", -F.col("component")))).first()[0]
    return sampling.instances(tries, spots, edges, classes.where(F.col("component") == largest), BANDS, PER_BAND, SNAP)


# -- walks ------------------------------------------------------------------------------------------

RATIOS, WAYPOINTS = (110, 140, 200), 8
_ORDER = "(node * 7919 + origin * 31) % 10007"
TRIP_SQL = "starts_v AS (SELECT unnest([0, side - 1]) AS origin FROM side_v)"
BACK_SQL = STREET_BACK.replace("SELECT origin, origin, CAST(0 AS BIGINT) FROM starts_v", "SELECT side * side - 1 - origin, side * side - 1 - origin, CAST(0 AS BIGINT) FROM starts_v, side_v")
COST_SQL = (
    "costs_v AS MATERIALIZED (SELECT f.origin, b.destination, f.node, f.dist + b.dist AS through, d.dist AS direct FROM times_v f, side_v JOIN backs_v b ON b.node = f.node AND b.destination = side * side - 1 - f.origin JOIN times_v d ON d.origin = f.origin AND d.node = b.destination)",
    f"""kinds_v AS (SELECT origin, destination, node, {_ORDER} AS o, unnest(list_filter([CASE WHEN through * 100 >= direct * 100 AND through * 100 <= direct * 110 THEN 0 END, CASE WHEN through * 100 >= direct * 110 AND through * 100 <= direct * 140 THEN 1 END,
         CASE WHEN through * 100 >= direct * 140 AND through * 100 <= direct * 200 THEN 2 END, CASE WHEN through * 100 > direct * 200 THEN 3 END], lambda k: k IS NOT NULL)) AS kind FROM costs_v WHERE node <> origin AND node <> destination)""",
    f"""taken_v AS (SELECT origin, destination, node, o, min(kind) AS kind FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY origin, kind ORDER BY o, node) AS place FROM kinds_v) WHERE place = 1
         UNION ALL SELECT * FROM (SELECT origin, destination, node, {_ORDER} AS o, 4, row_number() OVER (PARTITION BY origin ORDER BY {_ORDER}, node) AS place FROM costs_v WHERE node <> origin AND node <> destination) WHERE place <= {WAYPOINTS}) GROUP BY origin, destination, node, o)""",
    f"points_v AS MATERIALIZED (SELECT origin, destination, node AS waypoint, kind FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY kind, o, node) AS turn FROM taken_v) WHERE turn <= {WAYPOINTS})",
    "ahead_v AS MATERIALIZED (SELECT t.origin, t.node, min(e.source) AS parent FROM times_v t JOIN streets_v e ON e.target = t.node JOIN times_v s ON s.origin = t.origin AND s.node = e.source AND s.dist + e.time_s = t.dist WHERE t.node <> t.origin GROUP BY t.origin, t.node)",
    "behind_v AS MATERIALIZED (SELECT t.destination, t.node, min(e.target) AS parent FROM backs_v t JOIN streets_v e ON e.source = t.node JOIN backs_v s ON s.destination = t.destination AND s.node = e.target AND s.dist + e.time_s = t.dist WHERE t.node <> t.destination GROUP BY t.destination, t.node)",
    "up_v AS (SELECT origin, destination, waypoint, CAST(0 AS BIGINT) AS step, waypoint AS node FROM points_v UNION ALL SELECT u.origin, u.destination, u.waypoint, u.step - 1, a.parent FROM up_v u JOIN ahead_v a ON a.origin = u.origin AND a.node = u.node)",
    "down_v AS (SELECT origin, destination, waypoint, CAST(0 AS BIGINT) AS step, waypoint AS node FROM points_v UNION ALL SELECT u.origin, u.destination, u.waypoint, u.step + 1, a.parent FROM down_v u JOIN behind_v a ON a.destination = u.destination AND a.node = u.node)",
    "walk_v AS MATERIALIZED (SELECT origin, destination, waypoint, step - min(step) OVER (PARTITION BY origin, waypoint) AS step, node FROM (SELECT * FROM up_v UNION ALL SELECT * FROM down_v WHERE step > 0))",
)


def _walked(spark, sf_dir):
    side = _side(spark, sf_dir)
    edges = V.streets(spark, sf_dir)
    trips = spark.createDataFrame([(o, side * side - 1 - o) for o in (0, side - 1)], "origin long, destination long")
    forward = roads.distances(edges, trips.select("origin"))
    backward = roads.distances(roads.reverse(edges), trips.select(F.col("destination").alias("origin")))
    costs = roads.through_of(trips, forward.withColumnRenamed("dist", "forward"), backward.select(F.col("origin").alias("destination"), "node", F.col("dist").alias("backward")))
    points = tables.stored(sampling.waypoints(costs, RATIOS, WAYPOINTS, F.expr(_ORDER)))
    ahead = roads.predecessors(edges, forward)
    behind = roads.predecessors(roads.reverse(edges), backward).withColumnRenamed("origin", "destination")
    return edges, costs, points, sampling.walks(points, ahead, behind)


@query(
    "SELECT p.origin, p.destination, p.waypoint, p.kind, count(*) - 1 AS steps, CAST(sum(w.node * (w.step + 1)) AS BIGINT) AS node_sum, CAST(min(c.through) AS BIGINT) AS cost FROM points_v p JOIN walk_v w USING (origin, destination, waypoint) JOIN costs_v c ON c.origin = p.origin AND c.node = p.waypoint GROUP BY p.origin, p.destination, p.waypoint, p.kind",
    V.STREETS_SQL, TRIP_SQL, STREET_TIMES, BACK_SQL, *COST_SQL,
)
def waypoint_walks(spark, sf_dir):
    """Walks through sampled waypoints, up to and beyond the largest envelope."""
    _, costs, points, walked = _walked(spark, sf_dir)
    steps = walked.groupBy("origin", "destination", "waypoint").agg((F.count(F.lit(1)) - 1).alias("steps"), F.sum(F.col("node") * (F.col("step") + 1)).alias("node_sum"))
    cost = costs.select("origin", "destination", F.col("node").alias("waypoint"), F.col("through").alias("cost"))
    trip = ["origin", "destination", "waypoint"]
    return points.join(steps, trip).join(cost, trip).select(*trip, "kind", "steps", "node_sum", "cost")


@query(
    f"""SELECT origin, destination, waypoint, ratio, fault, count(*) AS n FROM (
         SELECT DISTINCT w.origin, w.destination, w.waypoint, c.ratio, 'node' AS fault, w.node, 0 AS other FROM walk_v w JOIN within_v c USING (origin, waypoint) WHERE w.node % 23 = 4 AND c.ratio = 140
         UNION ALL SELECT DISTINCT w.origin, w.destination, w.waypoint, c.ratio, 'crossing', w.node, x.node FROM walk_v w JOIN walk_v x ON x.origin = w.origin AND x.waypoint = w.waypoint AND x.step = w.step + 1 JOIN within_v c ON c.origin = w.origin AND c.waypoint = w.waypoint WHERE w.node % 19 = 7 AND c.ratio = 200) GROUP BY ALL""",
    V.STREETS_SQL, TRIP_SQL, STREET_TIMES, BACK_SQL, *COST_SQL,
    f"within_v AS (SELECT p.origin, p.waypoint, r.ratio FROM points_v p JOIN costs_v c ON c.origin = p.origin AND c.node = p.waypoint, (VALUES {', '.join(f'({r})' for r in RATIOS)}) r(ratio) WHERE c.through * 100 <= c.direct * r.ratio)",
)
def walk_faults(spark, sf_dir):
    """V4: walks within a budget that an envelope doesn't hold; nodes and edges are taken out of two envelopes."""
    edges, costs, _, walked = _walked(spark, sf_dir)
    by_ratio = costs.withColumn("ratio", F.explode(F.array(*[F.lit(r) for r in RATIOS])))
    inside = by_ratio.where("through * 100 <= direct * ratio AND NOT (ratio = 140 AND node % 23 = 4)").select("origin", "destination", "ratio", "node")
    crossed = None
    for r in RATIOS:
        found = roads.envelope_edges(costs, edges, r).select("origin", "destination", F.lit(r).alias("ratio"), "source", "target")
        crossed = found if crossed is None else crossed.unionByName(found)
    budgets = by_ratio.groupBy("origin", "destination", "ratio").agg(F.first(F.expr("direct * ratio div 100")).alias("budget"))
    return sampling.walk_faults(walked, edges, inside, crossed.where("NOT (ratio = 200 AND source % 19 = 7)"), budgets)
