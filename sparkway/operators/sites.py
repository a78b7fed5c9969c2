"""Sites from tagged objects: what they offer, where they are, one row for each object, and their nodes on another graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import must_be_empty, repeated


def classified(tags: Column, taxonomy: Sequence[tuple[str, str, tuple[str, ...]]], closed: Sequence[str], least_parking: int) -> Column:
    """(offers, subtypes) of a map of tags: what its explicit tags offer, sorted, and which tags say so; null subtypes without any.

    ``taxonomy`` lists (key, value, what it offers).  Objects whose access is one of ``closed`` offer nothing.  Parking with an explicit
    number of places below ``least_parking`` doesn't count; a number that can't be read doesn't matter.
    """
    access = F.coalesce(tags["access"], F.lit(""))
    places = F.coalesce(tags["capacity"], F.lit(""))
    too_few = F.coalesce(F.when(places.rlike("^[0-9]+$"), places.try_cast("decimal(38,0)") < least_parking), F.lit(False))
    found = []
    for key, value, offers in taxonomy:
        fits = F.coalesce(tags[key] == value, F.lit(False))
        if (key, value) == ("amenity", "parking"):
            fits = fits & ~too_few
        found.append(F.when(fits & ~access.isin(*closed), F.struct(F.array(*map(F.lit, offers)).alias("offers"), F.lit(f"{key}={value}").alias("tag"))))
    kept = F.filter(F.array(*found), lambda f: f.isNotNull())
    offers = F.array_sort(F.array_distinct(F.flatten(F.transform(kept, lambda f: f["offers"]))))
    subtypes = F.nullif(F.array_join(F.array_sort(F.transform(kept, lambda f: f["tag"])), ";"), F.lit(""))
    return F.struct(offers.alias("offers"), subtypes.alias("subtypes"))


#: Kinds of geometry and how much each is trusted.
PRIORITY = {"point": 1, "line": 2, "polygon": 3}


def representative_points(shapes: DataFrame) -> DataFrame:
    """(object, kind, x, y, priority) of shapes (object, kind, ring, seq, x, y), planar: one point for each object and kind.

    A point is itself (of several the first), a line half its length from its start (over all its rings), a polygon the middle of its
    widest stretch along a height between its corners, so that it lies inside and in no hole (rings count even and odd).  An object
    without extent has no row; nor has an unknown kind.
    """
    keys = ["object", "kind"]
    at = shapes.select(*keys, "ring", "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    points = at.where("kind = 'point'").groupBy(*keys).agg(F.min(F.struct("ring", "seq", "x", "y")).alias("p")).select(*keys, "p.x", "p.y")

    by = Window.partitionBy(*keys, "ring").orderBy("seq")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    to = lambda c, closed: F.coalesce(F.lead(c).over(by), F.first(c).over(whole)) if closed else F.lead(c).over(by)
    steps = at.where("kind = 'line'").select("*", to("x", False).alias("bx"), to("y", False).alias("by")).where("bx IS NOT NULL")
    along = Window.partitionBy(*keys).orderBy("ring", "seq")
    steps = steps.withColumn("step", F.hypot(F.col("bx") - F.col("x"), F.col("by") - F.col("y"))).where("step > 0").withColumn("end", F.sum("step").over(along))
    half = steps.groupBy(*keys).agg((F.max("end") / 2).alias("half"))
    first = steps.join(half, keys).where(F.col("end") >= F.col("half")).groupBy(*keys).agg(F.min(F.struct("end", "x", "y", "bx", "by", "step", "half")).alias("s"))
    share = (F.col("s.half") - (F.col("s.end") - F.col("s.step"))) / F.col("s.step")
    middles = first.select(*keys, (F.col("s.x") + share * (F.col("s.bx") - F.col("s.x"))).alias("x"), (F.col("s.y") + share * (F.col("s.by") - F.col("s.y"))).alias("y"))

    sides = at.where("kind = 'polygon'").select("*", to("x", True).alias("bx"), to("y", True).alias("by"))
    centre = sides.groupBy(*keys).agg(((F.min("y") + F.max("y")) / 2).alias("mid"))
    beside = sides.join(centre, keys).groupBy(*keys).agg(F.max(F.when(F.col("y") <= F.col("mid"), F.col("y"))).alias("under"), F.min(F.when(F.col("y") > F.col("mid"), F.col("y"))).alias("over"))
    height = beside.where("over IS NOT NULL").select(*keys, ((F.col("under") + F.col("over")) / 2).alias("height"))
    crossed = sides.join(height, keys).where((F.col("y") <= F.col("height")) != (F.col("by") <= F.col("height")))
    crossed = crossed.select(*keys, "height", (F.col("x") + (F.col("height") - F.col("y")) / (F.col("by") - F.col("y")) * (F.col("bx") - F.col("x"))).alias("at"))
    order = Window.partitionBy(*keys).orderBy("at")
    stretches = crossed.select(*keys, "height", "at", F.lead("at").over(order).alias("until"), F.row_number().over(order).alias("n")).where("n % 2 = 1 AND until > at")
    widest = stretches.groupBy(*keys).agg(F.min(F.struct((F.col("at") - F.col("until")).alias("w"), "at", "until", "height")).alias("s"))
    inner = widest.select(*keys, ((F.col("s.at") + F.col("s.until")) / 2).alias("x"), F.col("s.height").alias("y"))
    priority = F.coalesce(*[F.when(F.col("kind") == k, F.lit(p)) for k, p in PRIORITY.items()])
    return points.unionByName(middles).unionByName(inner).withColumn("priority", priority)


def merge_conflicts(rows: DataFrame) -> DataFrame:
    """(object, versions) of objects whose rows (object, tags, ...) don't carry the same tags; tags are a map."""
    named = rows.select("object", F.to_json(F.array_sort(F.map_entries("tags"))).alias("tags"))
    return named.groupBy("object").agg(F.count_distinct(F.coalesce("tags", F.lit(""))).alias("versions")).where("versions > 1")


def merged(rows: DataFrame) -> DataFrame:
    """(object, tags, kind, x, y, sources): one row for each object of rows (object, source, tags, kind, priority, x, y).

    The highest priority gives the place; of equals the first source.  An object without any place has none.  Sources are all that hold the
    object, sorted.  Different tags for one object are an error.
    """
    must_be_empty(merge_conflicts(rows), "objects with conflicting tags")
    place = F.min(F.when(F.col("priority").isNotNull(), F.struct((-F.col("priority")).alias("p"), "source", "kind", "x", "y"))).alias("s")
    best = rows.groupBy("object").agg(F.first("tags").alias("tags"), place, F.array_sort(F.collect_set("source")).alias("sources"))
    return best.select("object", "tags", "s.kind", "s.x", "s.y", "sources")


def remap_faults(old: DataFrame, new: DataFrame, tolerance: float) -> DataFrame:
    """(osm, fault) of nodes (id, osm, x, y) of one graph that can't be found on another: 'missing', 'twice' or 'moved' further than the tolerance."""
    twice = repeated(new, "osm").select("osm", F.lit(True).alias("many"))
    once = new.groupBy("osm").agg(F.min(F.struct("id", "x", "y")).alias("n")).select("osm", F.col("n.x").alias("nx"), F.col("n.y").alias("ny"))
    held = old.join(once, "osm", "left").join(twice, "osm", "left")
    far = F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny")) > tolerance
    fault = F.when(F.col("nx").isNull(), "missing").when(F.col("many"), "twice").when(far, "moved")
    return held.select("osm", fault.alias("fault")).where("fault IS NOT NULL").distinct()


def remapped(old: DataFrame, new: DataFrame, tolerance: float) -> DataFrame:
    """(id, new_id): nodes of one graph on another, by their shared name (osm); refuses whatever ``remap_faults`` finds."""
    must_be_empty(remap_faults(old, new, tolerance), "nodes that the other graph doesn't hold")
    return old.select("id", "osm").join(new.select("osm", F.col("id").alias("new_id")), "osm").select("id", "new_id")
