"""Registered queries over road networks, site policies and audits; each with SQL.  The views they run on are synthetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy
from ..operators import candidates, roads, spatial, stats, tables
from ..sources import views as V
from .route_queries import LEGS_SQL, OBJECTIVES, WALKS, _origins, query

LINKS_SQL = "links_v AS (SELECT DISTINCT o_custkey AS source, o_custkey // 30 * 30 + least(29, o_custkey % 30 // 5 * 5 + o_orderkey % 7) AS target FROM orders)"


@query(
    "SELECT id, component FROM (SELECT n.id, coalesce(min(a.b), n.id) AS component FROM (SELECT source AS id FROM links_v UNION SELECT target FROM links_v) n LEFT JOIN (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a WHERE x.b < x.a) a ON a.a = n.id GROUP BY n.id)",
    LINKS_SQL, "reach AS (SELECT source AS a, target AS b FROM links_v UNION SELECT r.a, l.target FROM reach r JOIN links_v l ON l.source = r.b)",
)
def strong_classes(spark, sf_dir):
    """Strong components of a whole graph, one row for each node."""
    orders = V.table(spark, sf_dir, "orders")
    links = orders.selectExpr("o_custkey AS source", "o_custkey div 30 * 30 + least(29, o_custkey % 30 div 5 * 5 + o_orderkey % 7) AS target").distinct()
    nodes = links.select(F.col("source").alias("id")).unionByName(links.select(F.col("target").alias("id")))
    return roads.strong_classes(nodes, links)


NEAR_LIMIT = 12
PAIRS_SQL = "asked_v AS (SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(n_nationkey * 3 + 7 AS BIGINT) AS b FROM nation)"


@query(
    "SELECT q.a, q.b, t.dist AS there, u.dist AS back, CASE WHEN t.dist IS NULL OR u.dist IS NULL THEN CAST('infinity' AS DOUBLE) ELSE CAST(greatest(t.dist, u.dist) AS DOUBLE) END AS far FROM asked_v q LEFT JOIN near t ON t.origin = q.a AND t.node = q.b LEFT JOIN near u ON u.origin = q.b AND u.node = q.a",
    V.EDGES_SQL, PAIRS_SQL,
    f"near_walks AS (SELECT * FROM (SELECT a AS origin, a AS node, CAST(0 AS BIGINT) AS dist FROM asked_v UNION SELECT b, b, 0 FROM asked_v) UNION SELECT w.origin, e.target, w.dist + e.time_s FROM near_walks w JOIN edges_v e ON e.source = w.node WHERE w.dist + e.time_s <= {NEAR_LIMIT})",
    "near AS (SELECT origin, node, min(dist) AS dist FROM near_walks GROUP BY origin, node)",
)
def road_distance_of_pairs(spark, sf_dir):
    """Bounded road distance of pairs in both directions; infinite beyond the limit."""
    asked = V.table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS a", "CAST(n_nationkey * 3 + 7 AS BIGINT) AS b")
    return roads.road_distance_of_pairs(V.edges(spark, sf_dir), asked, NEAR_LIMIT)


@query(
    "SELECT o_orderkey AS request, l.time_s, l.length_m, l.time_s IS NOT NULL AS reachable FROM orders LEFT JOIN sites_v s ON s.site_id = o_orderkey % 150 AND s.site_id % 9 <> 4 LEFT JOIN legs l ON l.origin = o_custkey % 5 AND l.node = s.anchor",
    V.EDGES_SQL, WALKS, LEGS_SQL, V.SITES_SQL,
)
def legs_of_sites(spark, sf_dir):
    """Requested site pairs looked up in frozen legs between road anchors; what is missing stays unreachable."""
    edges, sites = V.edges(spark, sf_dir), V.sites(spark, sf_dir)
    legs = roads.selected_legs(edges, _origins(spark)).select(F.col("origin").alias("source"), F.col("node").alias("target"), "time_s", "length_m")
    # requests start at depots 0 to 4, which are sites of their own with negative ids; the fifth has no legs
    depots = spark.range(5).select((-F.col("id") - 1).alias("site"), F.col("id").alias("anchor"))
    # every ninth site has no road beside it
    aliases = depots.unionByName(sites.select(F.col("site_id").alias("site"), F.when(F.col("site_id") % 9 != 4, F.col("anchor")).alias("anchor")))
    asked = V.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS request", "-(o_custkey % 5) - 1 AS from_site", "o_orderkey % 150 AS to_site")
    return roads.legs_of_sites(legs, aliases, asked).select("request", "time_s", "length_m", "reachable")


ENVELOPES = (100, 150, 200)


@query(
    """SELECT DISTINCT CAST(origin AS BIGINT) AS origin, ratio, CAST(node AS BIGINT) AS node, fault FROM (
         SELECT origin, CASE ratio WHEN 100 THEN 150 ELSE 200 END AS ratio, node, 'nesting' AS fault FROM inside WHERE ratio < 200
         UNION ALL SELECT p.origin, r.ratio, p.node, 'baseline' FROM (SELECT origin, unnest(path) AS node FROM legs WHERE node = origin + 100) p, (VALUES (100), (150), (200)) r(ratio)) a
       WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.origin = a.origin AND i.ratio = a.ratio AND i.node = a.node)""",
    V.EDGES_SQL, WALKS, LEGS_SQL,
    """ends AS (SELECT node AS destination, node, CAST(0 AS BIGINT) AS dist FROM (VALUES (CAST(100 AS BIGINT)), (101), (102), (103)) s(node)
         UNION SELECT w.destination, e.source, w.dist + e.time_s FROM ends w JOIN edges_v e ON e.target = w.node WHERE w.dist + e.time_s <= 60)""",
    """inside AS (SELECT f.origin, r.ratio, f.node FROM fwd f JOIN (SELECT destination, node, min(dist) AS dist FROM ends GROUP BY ALL) b ON b.node = f.node AND b.destination = f.origin + 100 JOIN fwd d ON d.origin = f.origin AND d.node = f.origin + 100, (VALUES (100), (150), (200)) r(ratio)
         WHERE (f.dist + b.dist) * 100 <= d.dist * r.ratio AND NOT (r.ratio = 150 AND f.node % 4 = 1))""",
)
def envelope_faults(spark, sf_dir):
    """V3: nested envelopes that hold the fastest path; a quarter of the nodes is taken out of the middle one."""
    edges = V.edges(spark, sf_dir)
    trips = _origins(spark).withColumn("destination", F.col("origin") + 100)
    costs = roads.through_costs(edges, trips).withColumn("ratio", F.explode(F.array(*[F.lit(r) for r in ENVELOPES])))
    inside = costs.where("through * 100 <= direct * ratio AND NOT (ratio = 150 AND node % 4 = 1)").select("origin", "ratio", "node")
    paths = roads.selected_legs(edges, _origins(spark)).where("node = origin + 100").select("origin", "path")
    return roads.envelope_faults(inside, paths, list(ENVELOPES)).distinct()


# Fixed values of the synthetic charger view: what every tag goes round through, by event_id.
CHARGER_TAGS = {
    "amenity": ["charging_station", "charging_station", "parking", None, "charging_station"],
    "man_made": [None, "charge_point", None],
    "disused": [None, None, None, None, None, None, "yes"],
    "removed:amenity": [*[None] * 10, "charging_station"],
    "access": [None, "yes", "private", None, "no", "customers", *[None] * 7],
    "motorcar": [None, None, "no", *[None] * 14],
    "access:conditional": [*[None] * 18, "no @ (22:00-06:00)"],
    "charging_station:battery_swapping": [*[None] * 22, "only"],
    "capacity": ["2", "0", *[None] * 27],
    "charging": [*[None] * 30, "yes"],
}
_tag = lambda v: "NULL" if v is None else f"'{v}'"
CHARGERS_SQL = "chargers_v AS (SELECT event_id AS site, " + ", ".join(f'[{", ".join(map(_tag, v))}][event_id % {len(v)} + 1] AS "{c}"' for c, v in CHARGER_TAGS.items()) + " FROM events)"


@query(
    """SELECT site, signal, reasons, reasons = '' AS eligible FROM (
         SELECT site, coalesce(amenity = 'charging_station', false) OR coalesce(man_made = 'charge_point', false) OR stale OR coalesce(charging = 'yes', false) AS signal,
           array_to_string(list_filter([CASE WHEN amenity IS DISTINCT FROM 'charging_station' THEN 'not_a_station_tag' END, CASE WHEN stale THEN 'explicit_lifecycle_exclusion' END, CASE WHEN access IN ('private', 'no') THEN 'explicit_access_exclusion' END,
             CASE WHEN motorcar = 'no' THEN 'explicit_vehicle_exclusion' END, CASE WHEN "access:conditional" IS NOT NULL THEN 'conditional_access_not_modeled' END,
             CASE WHEN "charging_station:battery_swapping" = 'only' THEN 'battery_swapping_only_not_charging' END, CASE WHEN capacity = '0' THEN 'explicit_zero_vehicle_capacity' END], lambda x: x IS NOT NULL), ',') AS reasons
         FROM (SELECT *, coalesce("removed:amenity" = 'charging_station', false) OR (coalesce(disused = 'yes', false) AND (coalesce(amenity = 'charging_station', false) OR coalesce(man_made = 'charge_point', false))) AS stale FROM chargers_v))""",
    CHARGERS_SQL,
)
def charging_evidence(spark, sf_dir):
    """every reason against a charger, gathered; eligible without any."""
    pick = lambda v: F.element_at(F.array(*[F.lit(x).cast("string") for x in v]), (F.col("event_id") % len(v) + 1).cast("int"))
    tags = F.map_from_arrays(F.array(*[F.lit(c) for c in CHARGER_TAGS]), F.array(*[pick(v) for v in CHARGER_TAGS.values()]))
    found = V.table(spark, sf_dir, "events").select(F.col("event_id").alias("site"), policy.charging_evidence(tags).alias("e"))
    return found.select("site", "e.signal", F.array_join("e.reasons", ",").alias("reasons"), "e.eligible")


_ACTIONS_SQL = "actions_v AS (SELECT site_id, anchor, size, unnest(CASE split_part(kind, ' ', 1) " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in (*v, *(['CS'] if len(v) == 2 else [])))}]" for k, v in V.CAPABILITIES.items()) + " END) AS effect FROM sites_v)"


def _actions(spark, sf_dir):
    kind = F.split("kind", " ")[0]
    offered = F.coalesce(*[F.when(kind == k, F.array(*map(F.lit, v))) for k, v in V.CAPABILITIES.items()])
    return V.sites(spark, sf_dir).select("site_id", "anchor", "size", F.explode(policy.actions(offered)).alias("effect"))


@query("SELECT site_id, effect FROM actions_v WHERE effect = 'C' OR (size % 2 = 0 AND size % 3 <> 0)", V.SITES_SQL, _ACTIONS_SQL)
def next_actions(spark, sf_dir):
    """service only where a schedule exists (even sizes) and is pending (sizes not divisible by three)."""
    return policy.next_actions(_actions(spark, sf_dir), F.col("size") % 2 == 0, F.col("size") % 3 != 0).select("site_id", "effect")


RANK_SQL = "ranked AS (SELECT anchor, site_id, greatest(130, 90 + size + 2 + 30) + size * 7 % 41 + 3 AS ends, row_number() OVER (PARTITION BY anchor ORDER BY greatest(130, 90 + size + 2 + 30) + size * 7 % 41 + 3, site_id) AS place FROM (SELECT DISTINCT anchor, site_id, size FROM actions_v WHERE effect IN ('S', 'CS') AND size % 5 <> 0 AND 90 + size <= 135 - 2))"


@query("SELECT a.anchor, a.site_id, a.effect, a.effect <> 'CS' AS separated, coalesce(a.effect = 'C' OR a.site_id = r.site_id, false) AS activity_first FROM actions_v a LEFT JOIN (SELECT * FROM ranked WHERE place = 1) r ON r.anchor = a.anchor", V.SITES_SQL, _ACTIONS_SQL, RANK_SQL)
def activity_masks(spark, sf_dir):
    """Actions under two policies, 'separated' and 'activity first' at the site whose activity ends first."""
    actions = _actions(spark, sf_dir)
    there = F.when(F.col("size") % 5 != 0, F.col("size"))  # null: unreachable
    timed = actions.where("effect IN ('S', 'CS')").select("anchor", "site_id", there.alias("there"), (F.col("size") * 7 % 41).alias("onward")).distinct()
    chosen = policy.chosen_activity(timed, "anchor", "site_id", start=90, overhead=2, penalty=3, opens=100, closes=135, duration=30)
    return policy.activity_masks(actions, chosen, "anchor", "site_id").select("anchor", "site_id", "effect", "separated", "activity_first")


CLAIMS_SQL = "claims_v AS (SELECT *, CASE WHEN status = 'attained_optimum' AND query_id % 13 <> 0 THEN query_id END AS key, CASE WHEN status = 'attained_optimum' OR query_id % 17 = 0 THEN query_id + CASE WHEN query_id % 19 = 0 THEN 1 ELSE 0 END END AS feasible_key, query_id % 23 <> 0 AS replayed FROM receipts_v)"


@query("SELECT query_id, method, fault FROM (SELECT *, CASE WHEN status = 'time_limit' AND key IS NOT NULL THEN 'claim' WHEN (key IS NOT NULL OR feasible_key IS NOT NULL) AND NOT replayed THEN 'replay' WHEN status = 'attained_optimum' AND (key IS NULL OR key IS DISTINCT FROM feasible_key) THEN 'key' END AS fault FROM claims_v) WHERE fault IS NOT NULL", V.RECEIPTS_SQL, CLAIMS_SQL)
def claim_faults(spark, sf_dir):
    """V6: receipts that claim what they can't; missing keys, differing keys and missing replays are planted."""
    done = F.col("status") == "attained_optimum"
    claims = V.receipts(spark, sf_dir).withColumns({
        "key": F.when(done & (F.col("query_id") % 13 != 0), F.col("query_id")),
        "feasible_key": F.when(done | (F.col("query_id") % 17 == 0), F.col("query_id") + F.when(F.col("query_id") % 19 == 0, 1).otherwise(0)),
        "replayed": F.col("query_id") % 23 != 0,
    })
    return stats.claim_faults(claims, ["query_id", "method"])


@query("SELECT key, id, place FROM (SELECT p_brand || '-' || p_partkey AS key, CAST(row_number() OVER (ORDER BY p_brand || '-' || p_partkey) - 1 AS BIGINT) AS place, CAST(row_number() OVER (ORDER BY p_brand || '-' || p_partkey) - 1 + CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE 0 END AS BIGINT) AS id FROM part) WHERE id <> place")
def identity_faults(spark, sf_dir):
    """Ids that aren't the place of their key in sorted order; some are planted."""
    keys = V.table(spark, sf_dir, "part").select(F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("key"), "p_partkey")
    given = tables.dense_ids(keys, "key").join(keys, "key").select("key", (F.col("id") + F.when(F.col("p_partkey") % 17 == 0, 1).otherwise(0)).alias("id"))
    return tables.identity_faults(given)


_WEIGHTS = ((0, 1, 1, 1, 1), (1, 7, 1, 1, 1), (2, 1, 1, 3, 5))
_SCALES = (50, 1000, 100, 8)
_SCORE = " + ".join(f"{c} / {float(s)!r} * w{c} / (wa + wb + wc + wd)" for c, s in zip("abcd", _SCALES, strict=True))


@query(
    "SELECT f.task, f.u AS utility, round(f.best, 9) AS best, round(CASE WHEN c.best IS NULL THEN CAST('infinity' AS DOUBLE) ELSE greatest(0, c.best - f.best) END, 9) AS regret, round(CASE WHEN c.best IS NULL THEN CAST('infinity' AS DOUBLE) ELSE greatest(0, c.best - f.best) / (abs(f.best) + 0.001) END, 9) AS relative FROM f LEFT JOIN c USING (task, u)",
    V.PLANS_SQL, f"us AS (SELECT * FROM (VALUES {', '.join(map(str, _WEIGHTS))}) t(u, wa, wb, wc, wd))",
    f"f AS (SELECT task, u, min({_SCORE}) AS best FROM plans_v, us GROUP BY task, u)", f"c AS (SELECT task, u, min({_SCORE}) AS best FROM plans_v, us WHERE a <= 10 AND task % 5 <> 0 GROUP BY task, u)",
)
def relative_regret(spark, sf_dir):
    """Absolute and relative regret over normalised objectives and weights; infinite where nothing is chosen."""
    flat = V.plans(spark, sf_dir)
    found = candidates.relative_regret(flat, flat.where("a <= 10 AND task % 5 <> 0"), [w[1:] for w in _WEIGHTS], "task", OBJECTIVES, _SCALES, eta=0.001)
    return found.select("task", "utility", *[F.round(c, 9).alias(c) for c in ("best", "regret", "relative")])


_FAMILY = [(k, *w) for k, w in enumerate(candidates.weight_family(6, 4, 11))]
_SHARES = " + ".join(f"{c} / {float(s)!r}::DOUBLE * w{c}" for c, s in zip("abcd", _SCALES, strict=True))


@query(
    "SELECT f.task, f.u AS utility, round(f.best, 9) AS best, round(CASE WHEN c.best IS NULL THEN CAST('infinity' AS DOUBLE) ELSE greatest(0, c.best - f.best) END, 9) AS regret FROM f LEFT JOIN c USING (task, u)",
    V.PLANS_SQL, "us AS (SELECT * FROM (VALUES " + ", ".join(f"({w[0]}, {', '.join(f'{x!r}::DOUBLE' for x in w[1:])})" for w in _FAMILY) + ") t(u, wa, wb, wc, wd))",
    f"f AS (SELECT task, u, min({_SHARES}) AS best FROM plans_v, us GROUP BY task, u)", f"c AS (SELECT task, u, min({_SHARES}) AS best FROM plans_v, us WHERE a <= 10 GROUP BY task, u)",
)
def sampled_regret(spark, sf_dir):
    """Regret over weights drawn evenly from all that sum to one."""
    flat = V.plans(spark, sf_dir)
    found = candidates.relative_regret(flat, flat.where("a <= 10"), [w[1:] for w in _FAMILY], "task", OBJECTIVES, _SCALES, eta=0.001)
    return found.select("task", "utility", *[F.round(c, 9).alias(c) for c in ("best", "regret")])


@query("SELECT task, least(count(*), count(*) FILTER (a <= 10)) AS n, true AS held FROM plans_v GROUP BY task HAVING count(*) FILTER (a <= 10) > 0", V.PLANS_SQL)
def random_controls(spark, sf_dir):
    """As many plans of each task as were chosen, drawn at random; their number, and that all are plans of the task."""
    flat = V.plans(spark, sf_dir)
    drawn = candidates.random_control(flat, flat.where("a <= 10"), "task", OBJECTIVES, 5)
    known = flat.select("task", *OBJECTIVES, F.lit(1).alias("known"))
    return drawn.distinct().join(known, ["task", *OBJECTIVES], "left").groupBy("task").agg(F.count(F.lit(1)).alias("n"), (F.count("known") == F.count(F.lit(1))).alias("held"))


NEAR_M = 400_000.0
SPHERE_SQL = "globe_v AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 300 % 90 AS lat, embedding[2]::DOUBLE * 900 % 180 AS lon FROM embeddings)"
_HAVERSINE = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))))"


@query(
    f"SELECT a.id, count(n.id) AS n, CAST(round(min(n.m)) AS BIGINT) AS nearest_m, arg_min(n.id, (round(n.m), n.id)) AS nearest FROM globe_v a LEFT JOIN (SELECT a.id AS a, b.id, {_HAVERSINE} AS m FROM globe_v a, globe_v b WHERE a.id <> b.id) n ON n.a = a.id AND n.m <= {NEAR_M} GROUP BY a.id",
    SPHERE_SQL,
)
def sphere_support(spark, sf_dir):
    """How many points lie within a radius on the sphere, and the nearest of them by the exact metric."""
    at = lambda k, by, most: (F.element_at("embedding", k).cast("double") * by % most)
    globe = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), at(1, 300, 90).alias("lat"), at(2, 900, 180).alias("lon"))
    return spatial.sphere_support(globe, globe, NEAR_M).select("id", "n", "nearest_m", "nearest")
