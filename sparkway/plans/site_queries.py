"""Registered queries over tagged sites; each with SQL.  The views they run on are synthetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sites
from ..sources import views as V
from .route_queries import query

# Fixed values of the synthetic view: what a tag offers, and what every tag goes round through, by event_id.
TAXONOMY = (
    ("amenity", "charging_station", ("charge",)), ("amenity", "restaurant", ("meal",)), ("amenity", "cafe", ("meal",)), ("amenity", "parking", ("parking",)),
    ("tourism", "hotel", ("sleep",)), ("shop", "supermarket", ("groceries",)), ("highway", "services", ("services", "rest")), ("highway", "rest_area", ("rest",)),
)
CLOSED, LEAST_PARKING = ("private", "no"), 10
OBJECT_TAGS = {
    "amenity": ["charging_station", "parking", "parking", None, "restaurant", "cafe", "parking_space"],
    "tourism": [None, None, "hotel", "museum", None],
    "shop": [None, None, None, "supermarket", *[None] * 7, "clothes", None],
    "highway": [None, "services", None, None, "rest_area", None, None, None],
    "access": [None, None, "private", "yes", None, None, "no", None, None],
    "capacity": ["2", "10", "unknown", None, "40", " 3", "99999999999999999999999"],
}
_text = lambda v: "NULL" if v is None else f"'{v}'"
OBJECTS_SQL = "objects_v AS (SELECT event_id AS object, " + ", ".join(f"[{', '.join(map(_text, v))}][event_id % {len(v)} + 1] AS {c}" for c, v in OBJECT_TAGS.items()) + " FROM events)"


def _tags(spark, sf_dir):
    pick = lambda v: F.element_at(F.array(*[F.lit(x).cast("string") for x in v]), (F.col("event_id") % len(v) + 1).cast("int"))
    tags = F.map_from_arrays(F.array(*map(F.lit, OBJECT_TAGS)), F.array(*[pick(v) for v in OBJECT_TAGS.values()]))
    return V.table(spark, sf_dir, "events").select("event_id", tags.alias("tags"))


_FITS = [(f"{k} = '{v}'" + (f" AND NOT coalesce(regexp_full_match(capacity, '[0-9]+') AND CAST(CASE WHEN regexp_full_match(capacity, '[0-9]+') THEN capacity END AS HUGEINT) < {LEAST_PARKING}, false)" if (k, v) == ("amenity", "parking") else ""), k, v, o) for k, v, o in TAXONOMY]


@query(
    "SELECT object, array_to_string(list_sort(list_distinct(flatten(list_filter([" + ", ".join(f"CASE WHEN open AND {c} THEN {list(o)} END" for c, _, _, o in _FITS) + "], lambda x: x IS NOT NULL)))), ',') AS offers, "
    "nullif(array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN open AND {c} THEN '{k}={v}' END" for c, k, v, _ in _FITS) + "], lambda x: x IS NOT NULL)), ';'), '') AS subtypes FROM (SELECT *, coalesce(access, '') NOT IN ('private', 'no') AS open FROM objects_v)",
    OBJECTS_SQL,
)
def site_taxonomy(spark, sf_dir):
    """what tagged objects offer, with rules for access and small parking places."""
    found = sites.classified(F.col("tags"), TAXONOMY, CLOSED, LEAST_PARKING)
    return _tags(spark, sf_dir).select(F.col("event_id").alias("object"), found.alias("f")).select("object", F.array_join("f.offers", ",").alias("offers"), "f.subtypes")


# -- where objects are -------------------------------------------------------------------------------

_KIND = "CASE user_id % 3 WHEN 0 THEN 'point' WHEN 1 THEN 'line' ELSE 'polygon' END"
_SHAPE = "SELECT user_id AS object, " + _KIND + " AS kind, CAST(0 AS BIGINT) AS ring, event_id AS seq, round((1000 + event_id * 7919 % 4001) * cos(2 * pi() * n / m)) AS x, round((1000 + event_id * 7919 % 4001) * sin(2 * pi() * n / m)) AS y FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS m FROM events)"


def _shapes(spark, sf_dir):
    V.table(spark, sf_dir, "events").createOrReplaceTempView("_shape_events")
    return spark.sql(_SHAPE.replace("FROM events", "FROM _shape_events"))


@query(
    """SELECT object, kind, round(x, 6) AS x, round(y, 6) AS y, CASE kind WHEN 'point' THEN 1 WHEN 'line' THEN 2 ELSE 3 END AS priority FROM (
         SELECT object, kind, arg_min(x, seq) AS x, arg_min(y, seq) AS y FROM shapes_v WHERE kind = 'point' GROUP BY ALL
         UNION ALL SELECT object, kind, arg_min(x + (half - done + step) / step * (bx - x), done), arg_min(y + (half - done + step) / step * (b_y - y), done) FROM (SELECT *, max(done) OVER (PARTITION BY object) / 2 AS half FROM (SELECT *, sum(step) OVER (PARTITION BY object ORDER BY seq) AS done FROM (SELECT *, sqrt((bx - x) * (bx - x) + (b_y - y) * (b_y - y)) AS step FROM sides_v WHERE kind = 'line' AND bx IS NOT NULL) WHERE step > 0)) WHERE done >= half GROUP BY ALL
         UNION ALL SELECT object, kind, arg_min((c + until) / 2, (c - until, c)), min(height) FROM (SELECT *, lead(c) OVER w AS until, row_number() OVER w AS n FROM (SELECT s.object, s.kind, height, x + (height - y) / (cy - y) * (cx - x) AS c FROM sides_v s JOIN heights_v h USING (object) WHERE s.kind = 'polygon' AND (y <= height) <> (cy <= height)) WINDOW w AS (PARTITION BY object ORDER BY c)) WHERE n % 2 = 1 AND until > c GROUP BY object, kind)""",
    f"shapes_v AS ({_SHAPE})",
    "sides_v AS (SELECT *, lead(x) OVER w AS bx, lead(y) OVER w AS b_y, coalesce(lead(x) OVER w, first(x) OVER w) AS cx, coalesce(lead(y) OVER w, first(y) OVER w) AS cy FROM shapes_v WINDOW w AS (PARTITION BY object ORDER BY seq))",
    "heights_v AS (SELECT object, (max(y) FILTER (y <= mid) + min(y) FILTER (y > mid)) / 2 AS height FROM (SELECT *, (min(y) OVER (PARTITION BY object) + max(y) OVER (PARTITION BY object)) / 2 AS mid FROM shapes_v WHERE kind = 'polygon') GROUP BY object)",
)
def representative_points(spark, sf_dir):
    """one point for each object: itself, the middle of a line, or a place inside a polygon."""
    found = sites.representative_points(_shapes(spark, sf_dir))
    return found.select("object", "kind", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "priority")


@query(
    "SELECT object, amenity, kind, x, sources FROM (SELECT object, string_agg(source, ',' ORDER BY source) AS sources FROM given_v GROUP BY object) JOIN objects_v USING (object) LEFT JOIN (SELECT * FROM (SELECT object, kind, x, row_number() OVER (PARTITION BY object ORDER BY priority DESC, source) AS place FROM given_v WHERE priority IS NOT NULL) WHERE place = 1) USING (object)",
    OBJECTS_SQL,
    "given_v AS (SELECT event_id AS object, source, CASE (event_id + k) % 4 WHEN 1 THEN 'point' WHEN 2 THEN 'line' WHEN 3 THEN 'polygon' END AS kind, CASE (event_id + k) % 4 WHEN 0 THEN NULL ELSE (event_id + k) % 4 END AS priority, CAST(event_id * 10 + k AS DOUBLE) AS x FROM events, (VALUES (0, 'north'), (1, 'south'), (4, 'east')) s(k, source) WHERE (event_id + k) % 3 <> 2)",
)
def merged_sites(spark, sf_dir):
    """G22, SRC7: objects that several extracts hold, as one row with the best of their places."""
    sources = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("source")) for k, s in ((0, "north"), (1, "south"), (4, "east"))]))
    given = _tags(spark, sf_dir).withColumn("s", sources).where("(event_id + s.k) % 3 <> 2").withColumn("p", F.expr("CAST((event_id + s.k) % 4 AS INT)"))
    given = given.select(F.col("event_id").alias("object"), "s.source", "tags", F.coalesce(*[F.when(F.col("p") == p, F.lit(k)) for k, p in sites.PRIORITY.items()]).alias("kind"), F.when(F.col("p") > 0, F.col("p")).alias("priority"), F.expr("CAST(event_id * 10 + s.k AS DOUBLE)").alias("x"), F.lit(0.0).alias("y"))
    return sites.merged(given).select("object", F.col("tags")["amenity"].alias("amenity"), "kind", "x", F.array_join("sources", ",").alias("sources"))


@query(
    "SELECT o_orderkey AS osm, CASE WHEN o_orderkey % 11 = 3 THEN 'missing' WHEN o_orderkey % 13 = 5 THEN 'twice' ELSE 'moved' END AS fault FROM orders WHERE o_orderkey % 11 = 3 OR o_orderkey % 13 = 5 OR o_orderkey % 7 > 3",
)
def remap_faults(spark, sf_dir):
    """Nodes that another graph lacks, holds twice or has moved by more than the tolerance; all three are planted."""
    orders = V.table(spark, sf_dir, "orders")
    old = orders.selectExpr("o_custkey AS id", "o_orderkey AS osm", "CAST(o_custkey AS DOUBLE) AS x", "0.0D AS y")
    new = orders.where("o_orderkey % 11 <> 3").selectExpr("o_orderkey + 7 AS id", "o_orderkey AS osm", "CAST(o_custkey AS DOUBLE) + o_orderkey % 7 * 0.25D AS x", "0.0D AS y", "explode(sequence(0, IF(o_orderkey % 13 = 5, 1, 0))) AS copy")
    return sites.remap_faults(old, new.drop("copy"), 0.75)
