"""Road networks in XML with exact times and lengths for each segment, as nodes, sites and directed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import must_be_empty, repeated

_TAGS = "tag array<struct<_k: string, _v: string>>"
#: Tags that carry the metrics and what a site offers.
TIME, LENGTH, OFFERS = "exact:time_s", "exact:length_m", "exact:capabilities"
CAPABILITIES = ("C", "S", "CS")


def _tag(name: str) -> Column:
    """The last value of a tag."""
    return F.try_element_at(F.transform(F.filter("tag", lambda t: t["_k"] == name), lambda t: t["_v"]), F.lit(-1))


def _rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    rows = spark.read.format("xml").options(rowTag=tag, mode="FAILFAST").schema(schema).load(path)
    return rows.withColumn("tag", F.coalesce("tag", F.array().cast("array<struct<_k: string, _v: string>>")))


def read_road_xml(spark: SparkSession, path: str, time_tag: str = TIME, length_tag: str = LENGTH, offers_tag: str = OFFERS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, sites, edges): nodes (node, lat, lon); charging sites (site, offers); edges (source, target, edge_id, time_s, length_m).

    Ways count that have a road class, aren't private and have two nodes at least.  Their time and length tags list a whole positive
    number for each segment; a way back takes the numbers of the same segment, and there is none on one-way roads.  Weights stay text.
    Errors: nodes without an id or with one twice, unknown capabilities, ways without metrics or with the wrong number of them, weights that aren't
    positive, nodes that don't exist, and a file without any edge.
    """
    points = _rows(spark, path, "node", f"_id string, _lat string, _lon string, {_TAGS}")
    nodes = points.select(F.col("_id").alias("node"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))
    must_be_empty(nodes.where("node IS NULL OR node = ''"), "nodes without an id")
    must_be_empty(repeated(nodes, "node"), "repeated nodes")
    offered = F.array_sort(F.array_distinct(F.split(F.coalesce(_tag(offers_tag), F.lit("C")), ",")))
    sites = points.where(_tag("amenity") == "charging_station").select(F.col("_id").alias("site"), offered.alias("offers"))
    must_be_empty(sites.where(F.size(F.array_except("offers", F.array(*map(F.lit, CAPABILITIES)))) > 0), "unknown capabilities")

    ways = _rows(spark, path, "way", f"_id string, nd array<struct<_ref: string>>, {_TAGS}")
    roads = ways.where((F.coalesce(_tag("highway"), F.lit("")) != "") & (F.coalesce(_tag("access"), F.lit("")) != "private") & (F.size("nd") >= 2))
    refs = F.transform("nd", lambda n: n["_ref"])
    measured = roads.select("_id", refs.alias("refs"), F.split(_tag(time_tag), ",").alias("times"), F.split(_tag(length_tag), ",").alias("lengths"), (F.coalesce(_tag("oneway"), F.lit("")) == "yes").alias("oneway"))
    must_be_empty(measured.where("times IS NULL OR lengths IS NULL").select("_id"), "ways without exact metrics")
    must_be_empty(measured.where("size(times) <> size(refs) - 1 OR size(lengths) <> size(refs) - 1").select("_id"), "metrics for another number of segments")
    step = F.posexplode(F.arrays_zip(F.slice("refs", 1, F.size("refs") - 1).alias("a"), F.slice("refs", 2, F.size("refs") - 1).alias("b"), "times", "lengths"))
    there = measured.select("_id", "oneway", step.alias("at", "s")).select("_id", "oneway", "at", F.col("s.a").alias("a"), F.col("s.b").alias("b"), F.col("s.times").alias("time_s"), F.col("s.lengths").alias("length_m"))
    must_be_empty(there.where(~(F.col("time_s").rlike("^[0-9]*[1-9][0-9]*$") & F.col("length_m").rlike("^[0-9]*[1-9][0-9]*$"))), "weights must be positive whole numbers")
    ends = there.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    must_be_empty(ends.join(nodes.select("node"), "node", "left_anti"), "ways over nodes that don't exist")
    directed = lambda rows, source, target: rows.select(F.col(source).alias("source"), F.col(target).alias("target"), F.concat(F.lit("way:"), "_id", F.lit(":"), source, F.lit(">"), target).alias("edge_id"), "time_s", "length_m")
    edges = directed(there, "a", "b").unionByName(directed(there.where("NOT oneway"), "b", "a"))
    if edges.isEmpty():
        raise ValueError("the file holds no road")
    return nodes, sites, edges
