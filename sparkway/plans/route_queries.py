"""Registered queries of the route analytics, each with SQL where SQL can express it.

All of them run over whole tables; the views they run on are synthetic (see ``sources.views``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, policy
from ..operators import candidates, roads, spatial, stats, tables
from ..sources import views as V
from ..streaming import receipts as streaming
from . import ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ORIGINS = (0, 1, 2, 3)
RATIOS = (100, 110, 120, 150, 200)
RADIUS = 1500


def query(sql: str | None = None, *ctes: str):
    """Registers a function under its name, with SQL over the given views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (("WITH RECURSIVE " + ",\n".join(ctes) + "\n") if ctes else "") + sql
        return f

    return add


# Reachable (origin, node, dist) by walks; at 30 edges a node or more and weights up to 50 no node lies near the bound.
WALKS = """
walks AS (
  SELECT * FROM (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0)) s(origin, node, dist)
  UNION
  SELECT w.origin, CAST(e.target AS INTEGER), CAST(w.dist + e.time_s AS INTEGER) FROM walks w JOIN edges_v e ON w.node = e.source WHERE w.dist + e.time_s <= 60
), fwd AS (SELECT origin, node, min(dist) AS dist FROM walks GROUP BY origin, node)"""
BACK = """
backs AS (
  SELECT * FROM (VALUES (100, 100, 0), (101, 101, 0), (102, 102, 0), (103, 103, 0)) s(destination, node, dist)
  UNION
  SELECT w.destination, CAST(e.source AS INTEGER), CAST(w.dist + e.time_s AS INTEGER) FROM backs w JOIN edges_v e ON w.node = e.target WHERE w.dist + e.time_s <= 60
), bwd AS (SELECT destination, node, min(dist) AS dist FROM backs GROUP BY destination, node)"""
COSTS = """
costs AS (
  SELECT f.origin, b.destination, f.node, f.dist AS forward, b.dist AS backward, f.dist + b.dist AS through, d.dist AS direct
  FROM fwd f JOIN bwd b ON b.node = f.node AND b.destination = f.origin + 100 JOIN fwd d ON d.origin = f.origin AND d.node = b.destination)"""


def _origins(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(o,) for o in ORIGINS], "origin long")


def _trips(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(o, o + 100) for o in ORIGINS], "origin long, destination long")


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.through_costs(V.edges(spark, sf_dir), _trips(spark))


# -- roads and envelopes ------------------------------------------------------------------


@query("SELECT source, target, time_s, length_m FROM edges_v", V.EDGES_SQL)
def road_edges(spark, sf_dir):
    """Edge view: fastest, then shortest, of parallel edges."""
    return V.edges(spark, sf_dir)


@query("SELECT CAST(origin AS BIGINT) AS origin, CAST(node AS BIGINT) AS node, CAST(dist AS BIGINT) AS dist FROM fwd", V.EDGES_SQL, WALKS)
def fastest_times(spark, sf_dir):
    """Distances from several origins to all nodes."""
    return roads.distances(V.edges(spark, sf_dir), _origins(spark))


# Walks along edges that attain the distances, and the first path of each node
LEGS_SQL = """
tight AS (
  SELECT a.origin, e.source, e.target, e.time_s, e.length_m FROM edges_v e JOIN fwd a ON a.node = e.source JOIN fwd b ON b.origin = a.origin AND b.node = e.target WHERE a.dist + e.time_s = b.dist
), ways AS (
  SELECT CAST(origin AS BIGINT) AS origin, CAST(node AS BIGINT) AS node, [CAST(node AS BIGINT)] AS path, CAST(0 AS BIGINT) AS time_s, CAST(0 AS BIGINT) AS length_m FROM fwd WHERE origin = node
  UNION ALL
  SELECT w.origin, t.target, list_append(w.path, CAST(t.target AS BIGINT)), w.time_s + t.time_s, w.length_m + t.length_m FROM ways w JOIN tight t ON t.origin = w.origin AND t.source = w.node WHERE t.target <> w.origin
), legs AS (SELECT origin, node, path, time_s, length_m FROM (SELECT *, row_number() OVER (PARTITION BY origin, node ORDER BY path) AS place FROM ways) WHERE place = 1)"""


@query("SELECT origin, node, time_s, length_m, array_to_string(path, '>') AS path FROM legs", V.EDGES_SQL, WALKS, LEGS_SQL)
def selected_legs(spark, sf_dir):
    """Fastest legs with full tie keys and their paths."""
    return roads.selected_legs(V.edges(spark, sf_dir), _origins(spark)).withColumn("path", F.array_join("path", ">"))


@query("SELECT origin, node, CASE WHEN node % 10 = 3 THEN 'time' WHEN node % 10 = 4 AND len(path) > 1 THEN 'edge' END AS fault FROM legs WHERE node % 10 = 3 OR (node % 10 = 4 AND len(path) > 1)", V.EDGES_SQL, WALKS, LEGS_SQL)
def path_faults(spark, sf_dir):
    """Paths replayed edge by edge; some have a wrong time planted, some a step that is no edge."""
    legs = roads.selected_legs(V.edges(spark, sf_dir), _origins(spark))
    planted = legs.withColumn("time_s", F.col("time_s") + F.when(F.col("node") % 10 == 3, 1).otherwise(0))
    broken = F.concat(F.slice("path", 1, F.size("path") - 1), F.array(F.lit(-1).cast("long"), F.col("node")))
    planted = planted.withColumn("path", F.when((F.col("node") % 10 == 4) & (F.size("path") > 1), broken).otherwise(F.col("path")))
    return roads.path_faults(planted, V.edges(spark, sf_dir))


@query("SELECT CAST(origin AS BIGINT) AS origin, CAST(destination AS BIGINT) AS destination, CAST(min(direct) AS BIGINT) AS direct, " + ", ".join(f"count(*) FILTER (through * 100 <= direct * {r}) AS r{r}" for r in RATIOS) + " FROM costs GROUP BY origin, destination", V.EDGES_SQL, WALKS, BACK, COSTS)
def envelope_counts(spark, sf_dir):
    """Nodes inside nested detour envelopes."""
    return roads.envelope_counts(_costs(spark, sf_dir), list(RATIOS))


@query("SELECT CAST(u.origin AS BIGINT) AS origin, count(*) AS n_edges, CAST(sum(e.length_m) AS BIGINT) AS length_m FROM costs u JOIN edges_v e ON e.source = u.node JOIN costs v ON v.node = e.target AND v.origin = u.origin WHERE (u.forward + e.time_s + v.backward) * 100 <= u.direct * 150 GROUP BY u.origin", V.EDGES_SQL, WALKS, BACK, COSTS)
def envelope_edges(spark, sf_dir):
    """F10 for edges: u, the edge and v together within the budget."""
    found = roads.envelope_edges(_costs(spark, sf_dir), V.edges(spark, sf_dir), 150)
    return found.groupBy("origin").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("length_m").alias("length_m"))


@query("SELECT CAST(origin AS BIGINT) AS origin, CAST(node AS BIGINT) AS node, CAST(through AS BIGINT) AS through, CAST(through - direct AS BIGINT) AS detour, CAST(CASE WHEN through > 0 THEN forward * 1000 // through END AS BIGINT) AS progress FROM costs WHERE through * 100 <= direct * 120", V.EDGES_SQL, WALKS, BACK, COSTS)
def detour_features(spark, sf_dir):
    """eligible nodes with their detour and progress (per mille)."""
    found = _costs(spark, sf_dir).where("through * 100 <= direct * 120")
    return found.select("origin", "node", "through", (F.col("through") - F.col("direct")).alias("detour"), F.expr("CASE WHEN through > 0 THEN forward * 1000 div through END").alias("progress"))


LABELS_SQL = "labels AS (SELECT CAST(origin AS BIGINT) AS origin, CAST(node AS BIGINT) AS node, CAST(dist + CASE WHEN node % 50 = 7 AND node <> origin THEN 1 ELSE 0 END AS BIGINT) AS dist FROM fwd WHERE NOT (node % 50 = 9 AND node <> origin))"


@query(
    """SELECT origin, target AS node, CASE WHEN e IS NULL THEN 'open' ELSE 'long' END AS kind FROM seen WHERE e IS NULL OR d + time_s < e
       UNION ALL SELECT l.origin, l.node, 'loose' FROM labels l WHERE l.node <> l.origin AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.origin = l.origin AND s.target = l.node AND s.d + s.time_s = s.e)""",
    V.EDGES_SQL, WALKS, LABELS_SQL, "seen AS (SELECT a.origin, e.target, a.dist AS d, e.time_s, b.dist AS e FROM labels a JOIN edges_v e ON e.source = a.node LEFT JOIN labels b ON b.origin = a.origin AND b.node = e.target)",
)
def certificate_violations(spark, sf_dir):
    """Edge inequalities over labels with faults planted in them: some a second too long, some missing."""
    edges = V.edges(spark, sf_dir)
    labels = roads.distances(edges, _origins(spark)).where("NOT (node % 50 = 9 AND node <> origin)")
    faulty = labels.withColumn("dist", F.col("dist") + F.when((F.col("node") % 50 == 7) & (F.col("node") != F.col("origin")), 1).otherwise(0))
    return roads.certificate_violations(edges, faulty)


@query("SELECT CAST(f.origin AS BIGINT) AS origin, count(*) AS n FROM fwd f JOIN (SELECT origin, node FROM rev GROUP BY origin, node) r ON r.origin = f.origin AND r.node = f.node GROUP BY f.origin", V.EDGES_SQL, WALKS, "rev AS (SELECT * FROM (VALUES (0, 0), (1, 1), (2, 2), (3, 3)) s(origin, node) UNION SELECT r.origin, CAST(e.source AS INTEGER) FROM rev r JOIN edges_v e ON r.node = e.target)")
def strong_components(spark, sf_dir):
    """Size of the strong component of every origin."""
    edges = V.edges(spark, sf_dir)
    found = [roads.strong_component(edges, _origins(spark))]
    return found[0].groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


# -- policies -----------------------------------------------------------------------------

# Fixed values of the synthetic way view: what every tag goes round through, by event_id.
WAY_TAGS = {
    "road_class": [*policy.CLASS_SPEED, *policy.EXCLUDED_CLASSES[:4]],
    "maxspeed": ["50", "30 mph", "50;30", "50;none", "400;50", "walk", "SI:rural", " 70 KPH ", "none", None, "0", "120.5 km/h", "20;30 mph"],
    "oneway": ["yes", "no", "-1", "1", None, None, "alternating"],
    "oneway_motorcar": ["reverse", *[None] * 10],
    "oneway_motor_vehicle": ["false", *[None] * 16],
    "junction": ["roundabout", *[None] * 8],
    "motorcar": ["private", "yes", *[None] * 11],
    "motor_vehicle": ["official", *[None] * 22],
    "vehicle": ["delivery", " ", *[None] * 17],
    "access": ["destination", "permissive", " ", "customers", *[None] * 21],
    "conditional_access": ["no @ (22:00-06:00)", *[None] * 28],
    "conditional_oneway": ["yes @ (Mo-Fr)", *[None] * 30],
    "maxspeed_forward": ["20", *[None] * 9],
    "maxspeed_backward": [None, "25 mph", *[None] * 12],
}
_quoted = lambda v: "NULL" if v is None else f"'{v}'"
WAYS_SQL = "ways_v AS (SELECT event_id AS way_id, " + ", ".join(f"trim([{', '.join(map(_quoted, v))}][event_id % {len(v)} + 1]) AS {c}" for c, v in WAY_TAGS.items()) + " FROM events)"


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways whose tags follow from event_id."""
    pick = lambda v: F.element_at(F.array(*[F.lit(x).cast("string") for x in v]), (F.col("event_id") % len(v) + 1).cast("int"))
    return V.table(spark, sf_dir, "events").select(F.col("event_id").alias("way_id"), *[pick(v).alias(c) for c, v in WAY_TAGS.items()])


_SPEEDS = "CASE " + " ".join(f"WHEN road_class = '{c}' THEN {v}.0" for c, v in policy.CLASS_SPEED.items()) + " END"
_NAMED = "CASE " + " ".join(f"WHEN tag = '{c}' THEN {v}.0" for c, v in policy.SYMBOLIC_SPEED.items()) + " END"
_IN = lambda v: "(" + ", ".join(f"'{x}'" for x in v) + ")"


@query(
    f"""SELECT way_id, direction, excluded_reason, CAST(round(CASE WHEN direction <> 0 THEN greatest(1.0, least(140.0, {_SPEEDS}, posted)) END * 1000) AS BIGINT) AS speed_m_h, CAST(round(posted * 1000) AS BIGINT) AS posted_m_h
        FROM (SELECT *, CASE WHEN direction = 0 OR tag IS NULL THEN NULL WHEN tag IN {_IN(policy.SYMBOLIC_SPEED)} THEN {_NAMED}
                WHEN len(list_filter(string_split(tag, ';'), lambda p: NOT regexp_full_match(lower(trim(p)), '[0-9]+(\\.[0-9]+)?[ ]*(mph|km/h|kmh|kph)?'))) > 0 THEN NULL
                WHEN len(list_filter(list_transform(string_split(tag, ';'), lambda p: CAST(regexp_extract(p, '[0-9]+(\\.[0-9]+)?') AS DOUBLE) * CASE WHEN lower(p) LIKE '%mph%' THEN 1.609344 ELSE 1 END), lambda v: v <= 0 OR v > 300)) > 0 THEN NULL
                ELSE list_min(list_transform(string_split(tag, ';'), lambda p: CAST(regexp_extract(p, '[0-9]+(\\.[0-9]+)?') AS DOUBLE) * CASE WHEN lower(p) LIKE '%mph%' THEN 1.609344 ELSE 1 END)) END AS posted
          FROM (SELECT *, coalesce(CASE WHEN direction = -1 THEN maxspeed_backward ELSE maxspeed_forward END, maxspeed) AS tag
            FROM (SELECT *, unnest(CASE WHEN excluded_reason IS NOT NULL THEN [0] WHEN ow IN {_IN(policy.FORWARD)} THEN [1] WHEN ow IN {_IN(policy.BACKWARD)} THEN [-1] ELSE [1, -1] END) AS direction
              FROM (SELECT *, CASE WHEN ow NOT IN {_IN((*policy.FORWARD, *policy.BACKWARD, *policy.BOTH))} THEN 'unsupported_oneway' WHEN road_class IN {_IN(policy.EXCLUDED_CLASSES)} THEN 'highway_class' WHEN conditional_oneway IS NOT NULL THEN 'conditional_oneway' WHEN conditional_access IS NOT NULL THEN 'conditional_access'
                       WHEN coalesce(motorcar, motor_vehicle, nullif(vehicle, ''), nullif(access, '')) NOT IN {_IN(policy.ALLOWED_ACCESS)} THEN 'restricted_or_unknown_access' END AS excluded_reason
                FROM (SELECT *, coalesce(oneway_motorcar, oneway_motor_vehicle, oneway, CASE WHEN junction = 'roundabout' OR road_class = 'motorway' THEN 'yes' ELSE 'no' END) AS ow FROM ways_v)))))""",
    WAYS_SQL,
)
def road_admission(spark, sf_dir):
    """Every way by direction with posted and effective speed, or the reason why it is left out."""
    found = policy.admitted_ways(_ways(spark, sf_dir))
    milli = lambda c: F.round(F.col(c) * 1000).cast("long")
    return found.select("way_id", "direction", "excluded_reason", milli("speed").alias("speed_m_h"), milli("posted").alias("posted_m_h"))


@query(
    """SELECT site_id, anchor, array_to_string(list_sort(CASE WHEN len(c) = 2 THEN list_append(c, 'CS') ELSE c END), ',') AS actions FROM (
         SELECT site_id, anchor, CASE kind WHEN 'ECONOMY' THEN ['C'] WHEN 'LARGE' THEN ['C', 'S'] WHEN 'MEDIUM' THEN ['S'] WHEN 'SMALL' THEN ['S'] WHEN 'STANDARD' THEN ['C', 'S'] END AS c FROM sites_v) WHERE c IS NOT NULL""",
    V.SITES_SQL,
)
def site_actions(spark, sf_dir):
    """Legal actions of every site with a capability."""
    known = F.create_map(*[x for k, c in V.CAPABILITIES.items() for x in (F.lit(k), F.array(*map(F.lit, c)))])
    offered = V.sites(spark, sf_dir).withColumn("c", known[F.col("kind")]).where("c IS NOT NULL")
    return offered.select("site_id", "anchor", F.array_join(policy.actions(F.col("c")), ",").alias("actions"))


@query("SELECT o_orderkey AS trip, CAST(greatest(0, ceil((CAST(floor(o_totalprice) AS BIGINT) * 2 + 5000 - 40000) / 55000.0)) AS BIGINT) AS charges FROM orders")
def necessary_charges(spark, sf_dir):
    """Least number of charges of every trip."""
    n = policy.necessary_charges(F.floor("o_totalprice").cast("long"), F.lit(2), F.lit(5000), F.lit(40000), F.lit(55000.0))
    return V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trip"), n.alias("charges"))


@query(
    """SELECT id, CAST(round(2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin((radians(lat) - radians(52.0)) / 2), 2) + cos(radians(52.0)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(13.0)) / 2), 2))))) AS BIGINT) AS metres
       FROM (SELECT id, 52.0 + x / 100000.0 AS lat, 13.0 + y / 100000.0 AS lon FROM points_v)""",
    V.POINTS_SQL,
)
def great_circle(spark, sf_dir):
    """distance of every point from a fixed one, in whole metres."""
    p = V.points(spark, sf_dir).select("id", (F.lit(52.0) + F.col("x") / 100000.0).alias("lat"), (F.lit(13.0) + F.col("y") / 100000.0).alias("lon"))
    return p.select("id", F.round(geo.great_circle(F.lit(52.0), F.lit(13.0), F.col("lat"), F.col("lon"))).cast("long").alias("metres"))


@query(
    """SELECT id, CAST(round(t * 1000000) AS BIGINT) AS progress, CAST(round(sqrt(pow(x - (-20000 + u * 40000), 2) + pow(y - (-10000 + u * 20000), 2))) AS BIGINT) AS cross
       FROM (SELECT *, least(1.0, greatest(0.0, t)) AS u FROM (SELECT id, x, y, ((x + 20000) * 40000.0 + (y + 10000) * 20000.0) / 2000000000.0 AS t FROM points_v))""",
    V.POINTS_SQL,
)
def corridor(spark, sf_dir):
    """progress along a corridor and distance from it."""
    args = [F.col("x"), F.col("y"), *[F.lit(float(v)) for v in (-20000, -10000, 20000, 10000)]]
    return V.points(spark, sf_dir).select("id", F.round(geo.progress(*args) * 1000000).cast("long").alias("progress"), F.round(geo.cross_distance(*args)).cast("long").alias("cross"))


# -- spatial joins and regions ------------------------------------------------------------

NEAR_SQL = f"near_v AS (SELECT p.id AS a, q.id AS b, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) AS d2 FROM points_v p JOIN points_v q ON p.id <> q.id AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= {RADIUS * RADIUS})"


@query("SELECT a, b, d2 FROM near_v WHERE a < b", V.POINTS_SQL, NEAR_SQL)
def radius_pairs(spark, sf_dir):
    """Range self-join over grid cells."""
    return spatial.pairs_within(V.points(spark, sf_dir), RADIUS)


@query("SELECT p.id, count(n.b) AS n, min(n.d2) AS nearest FROM points_v p LEFT JOIN near_v n ON n.a = p.id GROUP BY p.id", V.POINTS_SQL, NEAR_SQL)
def support_counts(spark, sf_dir):
    """Range count join, zeros kept."""
    p = V.points(spark, sf_dir)
    return spatial.support(p, p, RADIUS)


@query("SELECT a, b, d2, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS place FROM near_v) WHERE place <= 3", V.POINTS_SQL, NEAR_SQL)
def nearest_neighbours(spark, sf_dir):
    """kNN join within a radius, ties by id."""
    p = V.points(spark, sf_dir)
    return spatial.nearest(p, p, 3, RADIUS)


REACH_SQL = "reach AS (SELECT id, id AS other FROM points_v UNION SELECT r.id, n.b FROM reach r JOIN near_v n ON n.a = r.other)"


@query("SELECT id, min(other) AS component FROM reach GROUP BY id", V.POINTS_SQL, NEAR_SQL, REACH_SQL)
def regions(spark, sf_dir):
    """Connected components of the radius graph."""
    return spatial.clusters(V.points(spark, sf_dir), RADIUS)


@query(
    """SELECT component, count(*) AS n, min(x) AS min_x, max(x) AS max_x, max(y) - min(y) AS spread_y, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(x * x) AS BIGINT) AS sum_xx, array_to_string(list_sort(list(id)), ',') AS members
       FROM points_v JOIN (SELECT id, min(other) AS component FROM reach GROUP BY id) USING (id) GROUP BY component""",
    V.POINTS_SQL,
    NEAR_SQL,
    REACH_SQL,
)
def region_statistics(spark, sf_dir):
    """D12, region metrics: count, ranges, spread, moments, sorted members."""
    p = V.points(spark, sf_dir)
    labelled = p.join(spatial.clusters(p, RADIUS), "id")
    return labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), (F.max("y") - F.min("y")).alias("spread_y"), F.sum("x").alias("sum_x"), F.sum(F.col("x") * F.col("x")).alias("sum_xx"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("members"))


@query(
    """SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS both_pairs, min(lp) AS left_pairs, min(rp) AS right_pairs,
              round((sum(n * (n - 1) // 2) - min(lp) * min(rp) / (sum(n) * (sum(n) - 1) / 2.0)) / ((min(lp) + min(rp)) / 2.0 - min(lp) * min(rp) / (sum(n) * (sum(n) - 1) / 2.0)), 9) AS adjusted_rand
       FROM (SELECT l, r, count(*) AS n FROM lab GROUP BY l, r),
            (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS lp FROM (SELECT count(*) AS n FROM lab GROUP BY l)), (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS rp FROM (SELECT count(*) AS n FROM lab GROUP BY r))""",
    "lab AS (SELECT l_suppkey % 12 AS l, (l_suppkey * 3 + l_linenumber // 5) % 12 AS r FROM lineitem)",
)
def partition_agreement(spark, sf_dir):
    """Adjusted Rand index of two labelings."""
    lines = V.table(spark, sf_dir, "lineitem")
    return stats.agreement(lines.select((F.col("l_suppkey") % 12).alias("left"), ((F.col("l_suppkey") * 3 + F.expr("l_linenumber div 5")) % 12).alias("right")))


# -- receipts -----------------------------------------------------------------------------

SLOTS_SQL = "slots AS (SELECT g.query_id, g.method, coalesce(r.status, 'missing') AS status, r.time_s FROM grid_v g LEFT JOIN receipts_v r USING (query_id, method))"


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.completed(V.grid(spark, sf_dir), V.receipts(spark, sf_dir), ["query_id", "method"], {"status": "missing"})


@query("SELECT method, status, count(*) AS n FROM slots GROUP BY method, status", V.RECEIPTS_SQL, V.GRID_SQL, SLOTS_SQL)
def receipt_counts(spark, sf_dir):
    """Grid completion: every slot counts, missing ones under their own status."""
    return stats.status_counts(_slots(spark, sf_dir))


@query(
    "SELECT method, count(*) AS n_full, count(*) FILTER (status <> 'missing') AS n_supported, "
    + ", ".join(f"count(*) FILTER (status IN ('attained_optimum', 'infeasible') AND time_s <= {t}) AS within_{t}" for t in (10, 30, 60, 120))
    + ", "
    + ", ".join(f"CAST(count(*) FILTER (status IN ('attained_optimum', 'infeasible') AND time_s <= {t}) * 1000000 // {n} AS BIGINT) AS {name}_ppm_{t}" for t in (10, 30, 60, 120) for name, n in (("full", "count(*)"), ("supported", "count(*) FILTER (status <> 'missing')")))
    + " FROM slots GROUP BY method",
    V.RECEIPTS_SQL,
    V.GRID_SQL,
    SLOTS_SQL,
)
def receipt_thresholds(spark, sf_dir):
    """Conditional counts at thresholds over full and supported denominators."""
    return stats.threshold_shares(_slots(spark, sf_dir), [10, 30, 60, 120], F.col("status").isin("attained_optimum", "infeasible"), F.col("status") != "missing")


@query(
    """SELECT method, count(*) AS total, count(*) FILTER (cut) AS n_censored,
              CAST((list_sort(list(v))[(count(*) + 1) // 2] + list_sort(list(v))[count(*) // 2 + 1]) * 500 AS BIGINT) AS low_500,
              CAST((list_sort(list(CASE WHEN cut THEN 1000000 ELSE v END))[(count(*) + 1) // 2] + list_sort(list(CASE WHEN cut THEN 1000000 ELSE v END))[count(*) // 2 + 1]) * 500 AS BIGINT) AS high_500,
              CAST(list_sort(list(v))[(count(*) * 250 + 999) // 1000] * 1000 AS BIGINT) AS low_250,
              CAST(list_sort(list(CASE WHEN cut THEN 1000000 ELSE v END))[(count(*) * 250 + 999) // 1000] * 1000 AS BIGINT) AS high_250,
              CAST(list_sort(list(v))[(count(*) * 950 + 999) // 1000] * 1000 AS BIGINT) AS low_950, CAST(NULL AS BIGINT) AS high_950
       FROM (SELECT method, time_s AS v, status = 'time_limit' AS cut FROM receipts_v) GROUP BY method""",
    V.RECEIPTS_SQL,
)
def censored_quantiles(spark, sf_dir):
    """Right-censored order statistics, in thousandths: bounds of median, lower quartile and 95th percentile."""
    return stats.censored_quantiles(V.receipts(spark, sf_dir), ["method"], "time_s", F.col("status") == "time_limit", [500, 250, 950])


@query("SELECT count(*) AS n, round(median(CAST(a.time_s AS DOUBLE) / b.time_s), 9) AS median_ratio FROM receipts_v a JOIN receipts_v b USING (query_id) WHERE a.method = 'strong' AND b.method = 'scale' AND a.status = 'attained_optimum' AND b.status = 'attained_optimum'", V.RECEIPTS_SQL)
def paired_ratio(spark, sf_dir):
    """Median of paired ratios over queries that both methods completed."""
    done = V.receipts(spark, sf_dir).where("status = 'attained_optimum'")
    by = lambda m: done.where(F.col("method") == m).select("query_id", F.col("time_s").alias(m))
    ratios = by("strong").join(by("scale"), "query_id").select(F.lit(0).alias("all"), (F.col("strong").cast("double") / F.col("scale")).alias("ratio"))
    return stats.linear_quantiles(ratios, ["all"], "ratio", [0.5]).select("n", F.round("q500", 9).alias("median_ratio"))


@query("SELECT method, count(*) FILTER (status = 'attained_optimum') AS attained_optimum, count(*) FILTER (status = 'infeasible') AS infeasible, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'time_limit') AS time_limit FROM slots GROUP BY method", V.RECEIPTS_SQL, V.GRID_SQL, SLOTS_SQL)
def receipt_pivot(spark, sf_dir):
    """Pivot of statuses by method."""
    statuses = ["attained_optimum", "infeasible", "missing", "time_limit"]
    return _slots(spark, sf_dir).groupBy("method").pivot("status", statuses).count().na.fill(0)


@query("SELECT a.query_id, a.status AS strong_status, b.status AS scale_status FROM receipts_v a JOIN (SELECT query_id, method, CASE WHEN query_id % 97 = 5 THEN 'worker_error' ELSE status END AS status FROM receipts_v) b USING (query_id) WHERE a.method = 'strong' AND b.method = 'scale' AND a.status <> b.status", V.RECEIPTS_SQL)
def method_disagreement(spark, sf_dir):
    """V5: queries on which the methods' statuses differ; some are planted."""
    r = V.receipts(spark, sf_dir)
    by = lambda m: r.where(F.col("method") == m).select("query_id", F.col("status").alias(f"{m}_status"))
    scale = by("scale").withColumn("scale_status", F.when(F.col("query_id") % 97 == 5, "worker_error").otherwise(F.col("scale_status")))
    return by("strong").join(scale, "query_id").where("strong_status <> scale_status")


@query("SELECT g.query_id, g.method FROM grid_v g ANTI JOIN receipts_v r ON g.query_id = r.query_id AND g.method = r.method", V.RECEIPTS_SQL, V.GRID_SQL)
def missing_receipts(spark, sf_dir):
    """V9: anti-join for slots without a receipt."""
    return V.grid(spark, sf_dir).join(V.receipts(spark, sf_dir), ["query_id", "method"], "left_anti")


# -- windows, sets, keys --------------------------------------------------------------------


@query("SELECT user_id, event_id, CAST(floor(value * 100) AS BIGINT) - lag(CAST(floor(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events")
def marginal_change(spark, sf_dir):
    """Difference from the row before in the same group."""
    v = F.floor(F.col("value") * 100).cast("long")
    return V.table(spark, sf_dir, "events").select("user_id", "event_id", (v - F.lag(v).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("delta"))


@query("SELECT cx, cy, id FROM (SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY x, id) AS place FROM (SELECT id, x, CAST(floor(x / 2000.0) AS BIGINT) AS cx, CAST(floor(y / 2000.0) AS BIGINT) AS cy FROM points_v)) WHERE place = 1", V.POINTS_SQL)
def first_per_cell(spark, sf_dir):
    """One point for each grid cell."""
    p = V.points(spark, sf_dir).select("id", "x", F.floor(F.col("x") / 2000.0).cast("long").alias("cx"), F.floor(F.col("y") / 2000.0).cast("long").alias("cy"))
    return tables.first_per(p, ["cx", "cy"], F.col("x"), F.col("id")).select("cx", "cy", "id")


@query("SELECT p_type, p_partkey, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) AS place FROM part) WHERE place <= 5")
def top_sites(spark, sf_dir):
    """The five largest sites of every type."""
    place = F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("p_size"), "p_partkey"))
    return V.table(spark, sf_dir, "part").select("p_type", "p_partkey", place.alias("place")).where("place <= 5")


@query("SELECT o_custkey AS key, CAST(row_number() OVER (ORDER BY o_custkey) - 1 AS BIGINT) AS id FROM (SELECT DISTINCT o_custkey FROM orders)")
def dense_ids(spark, sf_dir):
    """Dense 0-based ids in key order, without a global window."""
    return tables.dense_ids(V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), "key")


@query("SELECT e.source AS u, e.target AS v, s.id AS source_id, t.id AS target_id FROM edges_v e JOIN ids s ON s.node = e.source JOIN ids t ON t.node = e.target", V.EDGES_SQL, "ids AS (SELECT node, CAST(row_number() OVER (ORDER BY node) - 1 AS BIGINT) AS id FROM (SELECT source AS node FROM edges_v UNION SELECT target FROM edges_v))")
def encoded_edges(spark, sf_dir):
    """Three-way dictionary encoding: every edge with the ranks of its ends."""
    e = V.edges(spark, sf_dir)
    ids = tables.dense_ids(e.select(F.col("source").alias("node")).union(e.select("target")), "node")
    s, t = (ids.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id")) for c in ("source", "target"))
    return e.join(s, "source").join(t, "target").select(F.col("source").alias("u"), F.col("target").alias("v"), "source_id", "target_id")


@query("SELECT l_orderkey AS key, count(DISTINCT (l_suppkey, l_partkey)) AS versions, count(*) AS rows FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT (l_suppkey, l_partkey)) > 1")
def upsert_conflicts(spark, sf_dir):
    """Keys that an upsert would have to reject: their rows disagree."""
    return tables.conflicts(V.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "key"), "key", "l_suppkey", "l_partkey")


@query("SELECT a.k AS a, b.k AS b, len(list_intersect(a.p, b.p)) AS shared, len(list_distinct(list_concat(a.p, b.p))) AS either FROM s a JOIN s b ON b.k = a.k + 1", "s AS (SELECT l_suppkey AS k, list(DISTINCT l_partkey % 50) AS p FROM lineitem GROUP BY l_suppkey)")
def route_overlap(spark, sf_dir):
    """Set overlap of neighbouring routes (numerator and denominator of their Jaccard index)."""
    sets = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("a")).agg(F.collect_set(F.col("l_partkey") % 50).alias("p"))
    following = sets.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("p").alias("q"))
    return sets.join(following, "a").select("a", "b", F.size(F.array_intersect("p", "q")).cast("long").alias("shared"), F.size(F.array_union("p", "q")).cast("long").alias("either"))


# -- plans --------------------------------------------------------------------------------


@query(
    """SELECT first, second, cost FROM (
         SELECT id AS first, CAST(-1 AS BIGINT) AS second, cost FROM ss WHERE mask = 3
         UNION ALL SELECT a.id, b.id, a.cost + b.cost + n.d2 FROM near_v n JOIN ss a ON a.id = n.a JOIN ss b ON b.id = n.b WHERE (a.mask | b.mask) = 3 AND a.mask <> 3 AND b.mask <> 3) WHERE cost <= 2000000""",
    V.POINTS_SQL,
    NEAR_SQL,
    "ss AS (SELECT id, abs(x) + abs(y) AS cost, CAST(id % 3 + 1 AS INTEGER) AS mask FROM points_v)",
)
def candidate_plans(spark, sf_dir):
    """One- and two-stop plans within a budget."""
    p = V.points(spark, sf_dir)
    sites = p.select("id", (F.abs("x") + F.abs("y")).alias("cost"), (F.col("id") % 3 + 1).cast("int").alias("mask"))
    return candidates.generated(sites, spatial.pairs_within(p, RADIUS).withColumnRenamed("d2", "way"), 2_000_000)


SKY_SQL = "sky AS (SELECT * FROM plans_v p WHERE NOT EXISTS (SELECT 1 FROM plans_v q WHERE q.task = p.task AND q.a <= p.a AND q.b <= p.b AND q.c <= p.c AND q.d <= p.d AND (q.a < p.a OR q.b < p.b OR q.c < p.c OR q.d < p.d)))"
OBJECTIVES = ["a", "b", "c", "d"]


@query("SELECT task, a, b, c, d FROM sky", V.PLANS_SQL, SKY_SQL)
def plan_skyline(spark, sf_dir):
    """Plans that no plan of their task dominates."""
    return candidates.skyline(V.plans(spark, sf_dir), "task", OBJECTIVES)


COVER_TOLERANCE = (5, 50, 2, 1)


@query()
def plan_cover(spark, sf_dir):
    """Greedy cover of every skyline, with a tolerance for each objective."""
    return candidates.cover(candidates.skyline(V.plans(spark, sf_dir), "task", OBJECTIVES), "task", OBJECTIVES, COVER_TOLERANCE)


@query("SELECT f.task, f.u AS utility, f.best, c.best AS best_chosen, c.best - f.best AS regret FROM f LEFT JOIN c USING (task, u)", V.PLANS_SQL, "us AS (SELECT * FROM (VALUES (0, 1, 1, 1, 1), (1, 50, 1, 1, 1), (2, 1, 1, 10, 20)) t(u, wa, wb, wc, wd))", "f AS (SELECT task, u, min(a * wa + b * wb + c * wc + d * wd) AS best FROM plans_v, us GROUP BY task, u)", "c AS (SELECT task, u, min(a * wa + b * wb + c * wc + d * wd) AS best FROM plans_v, us WHERE a <= 10 GROUP BY task, u)")
def plan_regret(spark, sf_dir):
    """Regret of keeping only short plans, for three utilities."""
    flat = V.plans(spark, sf_dir)
    utilities = spark.createDataFrame([(0, 1, 1, 1, 1), (1, 50, 1, 1, 1), (2, 1, 1, 10, 20)], "utility int, w_a int, w_b int, w_c int, w_d int")
    return candidates.regret(flat, flat.where("a <= 10"), utilities, "task", OBJECTIVES)


LEDGER_SQL = """
st AS (SELECT trip, kind, amount, row_number() OVER (PARTITION BY trip ORDER BY seq) AS rn FROM trips_v),
run AS (
  SELECT DISTINCT trip, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS n, CAST(40 AS BIGINT) AS energy, CAST(0 AS BIGINT) AS time, CAST(0 AS BIGINT) AS charged, CAST(0 AS BIGINT) AS driven, false AS served, true AS ok FROM trips_v
  UNION ALL
  SELECT r.trip, s.rn, CASE WHEN r.ok AND NOT (s.kind = 'D' AND r.energy - s.amount < 5) THEN r.n + 1 ELSE r.n END,
    CASE WHEN r.ok AND s.kind = 'D' AND r.energy - s.amount >= 5 THEN r.energy - s.amount WHEN r.ok AND s.kind = 'C' AND r.energy < 60 THEN least(60, r.energy + s.amount) ELSE r.energy END,
    CASE WHEN r.ok AND s.kind = 'D' AND r.energy - s.amount >= 5 THEN r.time + s.amount WHEN r.ok AND s.kind = 'C' AND r.energy < 60 THEN r.time + 2 + least(60, r.energy + s.amount) - r.energy WHEN r.ok AND s.kind = 'S' AND NOT r.served AND r.time <= 398 THEN greatest(110, r.time + 12) ELSE r.time END,
    CASE WHEN r.ok AND s.kind = 'C' AND r.energy < 60 THEN r.charged + least(60, r.energy + s.amount) - r.energy ELSE r.charged END,
    CASE WHEN r.ok AND s.kind = 'D' AND r.energy - s.amount >= 5 THEN r.driven + s.amount ELSE r.driven END,
    r.served OR (r.ok AND s.kind = 'S' AND r.time <= 398), r.ok AND NOT (s.kind = 'D' AND r.energy - s.amount < 5)
  FROM run r JOIN st s ON s.trip = r.trip AND s.rn = r.rn + 1)"""


@query("SELECT trip, n AS steps_done, energy, time, charged, driven, served, ok AS feasible FROM (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY rn DESC) AS last FROM run) WHERE last = 1", V.TRIPS_SQL, LEDGER_SQL)
def trip_replay(spark, sf_dir):
    """Ordered replay of every trip's ledger."""
    return ledger.replay(V.trips(spark, sf_dir))


@query("SELECT trip FROM (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY rn DESC) AS last FROM run) WHERE last = 1 AND energy + CASE WHEN trip % 10 = 3 THEN 1 ELSE 0 END <> 40 + charged - driven", V.TRIPS_SQL, LEDGER_SQL)
def energy_violations(spark, sf_dir):
    """Ledgers that do not balance; a unit of energy is planted in every tenth."""
    replayed = ledger.replay(V.trips(spark, sf_dir))
    return ledger.energy_violations(replayed.withColumn("energy", F.col("energy") + F.when(F.col("trip") % 10 == 3, 1).otherwise(0))).select("trip")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_events(spark, sf_dir):
    """Tumbling daily counts, on the batch table (an addition)."""
    return streaming.windowed_counts(V.table(spark, sf_dir, "events"))
