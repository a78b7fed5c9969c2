"""Site taxonomy, representative points, merging and remapping by hand cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkway.operators import sites

TAXONOMY = [("amenity", "charging_station", ("charge",)), ("amenity", "cafe", ("meal",)), ("amenity", "parking", ("parking",)), ("tourism", "hotel", ("sleep",)), ("highway", "services", ("services", "rest"))]
CASES = [
    ({"amenity": "charging_station"}, ["charge"], "amenity=charging_station"),
    ({"highway": "services"}, ["rest", "services"], "highway=services"),
    ({"amenity": "parking"}, ["parking"], "amenity=parking"),
    ({"amenity": "parking", "capacity": "2"}, [], None),
    ({"amenity": "parking", "capacity": "5"}, ["parking"], "amenity=parking"),
    ({"amenity": "parking", "capacity": "unknown"}, ["parking"], "amenity=parking"),
    ({"amenity": "parking", "capacity": "9" * 60}, ["parking"], "amenity=parking"),
    ({"amenity": "parking_space"}, [], None),
    ({"amenity": "cafe", "access": "private"}, [], None),
    ({"tourism": "hotel", "amenity": "charging_station", "access": "yes"}, ["charge", "sleep"], "amenity=charging_station;tourism=hotel"),
    ({}, [], None),
]


def test_taxonomy(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(CASES)], "id long, tags map<string, string>")
    got = rows.select("id", sites.classified(F.col("tags"), TAXONOMY, ("private", "no"), 5).alias("f")).select("id", "f.*").orderBy("id").collect()
    assert [(r["offers"], r["subtypes"]) for r in got] == [(o, s) for _, o, s in CASES]


def shape(spark, *objects):
    rows = [(o, kind, ring, k, float(x), float(y)) for o, kind, rings in objects for ring, spots in enumerate(rings) for k, (x, y) in enumerate(spots)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "object long, kind string, ring long, seq long, x double, y double").repartition(3)


def test_representative_points(spark):
    shapes = shape(
        spark,
        (1, "point", [[(3, 4), (9, 9)]]),
        (2, "line", [[(0, 0), (10, 0), (10, 30)]]),
        (3, "line", [[(0, 0), (4, 0)], [(20, 0), (20, 12)]]),
        (4, "polygon", [[(0, 0), (10, 0), (10, 10), (0, 10)]]),
        (5, "polygon", [[(0, 0), (12, 0), (12, 12), (0, 12)], [(2, 2), (10, 2), (10, 9), (2, 9)]]),
        (6, "polygon", [[(0, 0), (30, 0), (30, 10), (25, 10), (25, 2), (5, 2), (5, 10), (0, 10)]]),
        (7, "polygon", [[(1, 1), (1, 1), (5, 1)]]),
        (8, "line", [[(1, 1), (1, 1)]]),
        (9, "area", [[(1, 1)]]),
        (1, "polygon", [[(0, 0), (2, 0), (0, 2)]]),
    )
    got = {(r["object"], r["kind"]): (r["x"], r["y"], r["priority"]) for r in sites.representative_points(shapes).collect()}
    assert got == {
        (1, "point"): (3, 4, 1), (2, "line"): (10, 10, 2), (3, "line"): (20, 4, 2), (4, "polygon"): (5, 5, 3),
        (5, "polygon"): (1, 5.5, 3), (6, "polygon"): (2.5, 6, 3), (1, "polygon"): (0.5, 1, 3),
    }


def test_merging(spark):
    schema = "object string, source string, tags map<string, string>, kind string, priority int, x double, y double"
    rows = [("way/1", "b", {"a": "1", "b": "2"}, "point", 1, 1.0, 1.0), ("way/1", "c", {"b": "2", "a": "1"}, "polygon", 3, 2.0, 2.0), ("way/1", "a", {"a": "1", "b": "2"}, "polygon", 3, 3.0, 3.0), ("node/1", "a", {"a": "9"}, None, None, None, None)]
    got = {r["object"]: (r["kind"], r["x"], r["sources"], r["tags"]) for r in sites.merged(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"way/1": ("polygon", 3.0, ["a", "b", "c"], {"a": "1", "b": "2"}), "node/1": (None, None, ["a"], {"a": "9"})}
    with pytest.raises(ValueError, match="conflicting"):
        sites.merged(spark.createDataFrame([*rows, ("node/1", "b", {"a": "8"}, None, None, None, None)], schema))


def test_remapping(spark):
    nodes = lambda *r: spark.createDataFrame(r, "id long, osm long, x double, y double")
    old = nodes((1, 100, 0.0, 0.0), (2, 200, 5.0, 5.0))
    good = nodes((7, 200, 5.0, 5.5), (8, 100, 0.0, 0.0), (9, 300, 1.0, 1.0))
    assert sorted(map(tuple, sites.remapped(old, good, 0.5).collect())) == [(1, 8), (2, 7)]
    bad = {"moved": nodes((7, 200, 5.0, 5.6), (8, 100, 0.0, 0.0)), "missing": nodes((8, 100, 0.0, 0.0)), "twice": good.union(nodes((6, 200, 5.0, 5.0)))}
    for fault, new in bad.items():
        assert [tuple(r) for r in sites.remap_faults(old, new, 0.5).collect()] == [(200, fault)]
        with pytest.raises(ValueError, match=fault):
            sites.remapped(old, new, 0.5)
