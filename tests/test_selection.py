"""Selections against plain versions, and policies by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkway import catalog
from sparkway.functions import policy
from sparkway.operators import selection
from sparkway.sources import files


def test_round_robin_against_a_plain_version(spark, data):
    got: dict = {}
    for r in catalog.QUERIES["selected_candidates"](spark, data).orderBy("domain", "place").collect():
        got.setdefault(r["domain"], []).append(r["site"])
    offers = {"ECONOMY": "C", "LARGE": "CS", "MEDIUM": "S", "SMALL": "S", "STANDARD": "CS"}
    anchors: dict = {}
    for r in spark.read.parquet(f"{data}/part.parquet").collect():
        effects = offers.get(r["p_type"].split(" ")[0])
        if effects:
            site = (0 if effects == "CS" else 1 if effects == "C" else 2, r["p_partkey"], effects, r["p_partkey"] * 31 % 4, r["p_size"])
            key = (r["p_brand"], r["p_partkey"] * 7 % 400)
            anchors[key] = min(anchors.get(key, site), site)
    want = {}
    for domain in {d for d, _ in anchors}:
        mine = [s for (d, _), s in anchors.items() if d == domain]
        pools = [sorted((s[4], s[1]) for s in mine if s[3] == stratum and effect in s[2]) for stratum in range(4) for effect in "CS"]
        chosen: list = []
        while any(pools):
            for pool in pools:
                while pool and pool[0][1] in chosen:
                    pool.pop(0)
                if pool:
                    chosen.append(pool.pop(0)[1])
        want[domain] = chosen[:24]
    assert got == want and got


@pytest.mark.parametrize(
    ("value", "speed"),
    [("50", 50.0), ("30 mph", 48.28032), ("50;30", 30.0), ("50;none", None), ("400;50", None), ("walk", 5.0), ("SI:rural", 90.0), (" 70 KPH ", 70.0), ("0", None), ("", None), (None, None), ("50;", None), ("120.5km/h", 120.5)],
)
def test_posted_speed(spark, value, speed):
    got = spark.createDataFrame([(value,)], "v string").select(policy.posted_speed(F.col("v")).alias("s")).first()["s"]
    assert got == (None if speed is None else pytest.approx(speed))


def test_admission_reasons(spark):
    columns = "way_id long, road_class string, motorcar string, motor_vehicle string, vehicle string, access string, oneway string, oneway_motorcar string, oneway_motor_vehicle string, junction string, conditional_access string, conditional_oneway string, maxspeed string, maxspeed_forward string, maxspeed_backward string"
    way = lambda i, c="residential", **tags: tuple({"way_id": i, "road_class": c, **tags}.get(x.split(" ")[0]) for x in columns.split(", "))
    rows = [way(1), way(2, "motorway"), way(3, access="destination"), way(4, oneway="alternating"), way(5, "busway"), way(6, conditional_access="no @ night"), way(7, conditional_oneway="yes @ day"), way(8, motorcar="yes", access="private", maxspeed_backward="10"), way(9, junction="roundabout"), way(10, oneway="-1", maxspeed_backward="walk")]
    got = [tuple(r)[:4] for r in policy.admitted_ways(spark.createDataFrame(rows, columns)).orderBy("way_id", "direction").collect()]
    assert got == [(1, -1, None, 30.0), (1, 1, None, 30.0), (2, 1, None, 110.0), (3, 0, "restricted_or_unknown_access", None), (4, 0, "unsupported_oneway", None), (5, 0, "highway_class", None), (6, 0, "conditional_access", None), (7, 0, "conditional_oneway", None), (8, -1, None, 10.0), (8, 1, None, 30.0), (9, 1, None, 30.0), (10, -1, None, 5.0)]
    with pytest.raises(Exception, match="unknown road class"):
        policy.admitted_ways(spark.createDataFrame([way(1, "corridor")], columns)).collect()


def test_lockstep_and_fallback(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "i int, v string"), spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "i int, v string")
    assert sorted(map(tuple, selection.lockstep(left, right, "i").collect())) == [(2, "differs"), (3, "missing"), (4, "extra")]
    rows, some = spark.createDataFrame([(1, 1, 1), (2, 2, 1), (3, 3, 3)], "id int, a int, b int"), spark.createDataFrame([(1, 1, 9), (5, 1, 7), (1, 1, 8)], "a int, b int, v int")
    found = selection.with_fallback(rows, some, [("a", ["a"]), ("b", ["b"]), ("all", [])], "v")
    assert sorted((r["id"], r["level"], r["v"]) for r in found.collect()) == [(1, "a", 8), (2, "b", 7), (3, "all", 7)]


def test_boundary_with_a_broken_line(spark, tmp_path):
    (tmp_path / "ok.poly").write_text("name\nring\n 1.0 2.0\n 1.0E1 2\nEND\n!hole\n 3 4\nEND\nEND\n")
    assert sorted((r["hole"], r["lon"], r["lat"]) for r in files.read_boundary(spark, str(tmp_path / "ok.poly")).collect()) == [(False, 1.0, 2.0), (False, 10.0, 2.0), (True, 3.0, 4.0)]
    (tmp_path / "bad.poly").write_text("name\nring\n 1.0 2.0\n 1 x\nEND\nEND\n")
    with pytest.raises(Exception, match="two numbers"):
        files.read_boundary(spark, str(tmp_path / "bad.poly"))


def test_domain_rows(spark):
    sites = spark.createDataFrame([("g", k, 100 - k, ["C"] if k % 2 else ["S"]) for k in range(6)] + [("h", 1, 7, ["C", "S"])], "grp string, place int, site long, effects array<string>")
    groups = spark.createDataFrame([("g",), ("h",)], "grp string")
    rows = lambda *more, **how: sorted((r["grp"], r["site"]) for r in selection.domain_rows(groups, sites, ["grp"], *more, **how).collect())
    assert rows(1, "schedule") == [("g", 100), ("h", 7)] and rows(1, "energy_only") == [("g", 99), ("h", 7)]
    assert rows(3, "energy_only", require_full=False) == [("g", 95), ("g", 97), ("g", 99), ("h", 7)]
    with pytest.raises(selection.DomainUnavailable) as short:
        rows(3, "schedule")
    assert (short.value.scenario, short.value.requested, short.value.short) == ("schedule", 3, [("h", 1)])
    with pytest.raises(selection.DomainUnavailable):
        selection.domain_rows(groups.union(spark.createDataFrame([("none",)], "grp string")), sites, ["grp"], 1, "schedule")
    with pytest.raises(ValueError, match="scenario"):
        rows(1, "other")


def test_closed_shelters(spark):
    tags = {"highway": "yes", "building": "yes", "amenity": "shelter"}
    rows = [(1, tags, [1, 2, 3, 1]), (2, tags, [1, 2, 3]), (3, {**tags, "building": "no"}, [1, 2, 1]), (4, tags, [1]), (5, tags, []), (6, {"highway": "yes"}, [1, 1])]
    frame = spark.createDataFrame(rows, "way_id long, tags map<string, string>, nodes array<long>")
    got = {r["way_id"]: r["c"] for r in frame.select("way_id", policy.shelter_contour(F.col("tags"), F.col("nodes")).alias("c")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}
    names = ["access", "vehicle", "motor_vehicle", "motorcar", "oneway", "oneway_motorcar", "oneway_motor_vehicle", "junction", "conditional_access", "conditional_oneway", "maxspeed", "maxspeed_forward", "maxspeed_backward"]
    ways = spark.createDataFrame([(1, "yes", True), (2, "primary", True), (3, "primary", None)], "way_id long, road_class string, contour boolean").select("*", *[F.lit(None).cast("string").alias(n) for n in names])
    found = {(r["way_id"], r["direction"], r["excluded_reason"]) for r in policy.admitted_ways(ways).collect()}
    assert found == {(1, 0, "closed_shelter_contour"), (2, 1, None), (2, -1, None), (3, 1, None), (3, -1, None)}
    with pytest.raises(Exception, match="unknown road class"):
        policy.admitted_ways(ways.withColumn("contour", F.lit(False))).collect()


def test_agreement_of_classes_whose_pairs_multiply_beyond_a_long(spark):
    from sparkway.operators import stats

    same = spark.range(200_000).selectExpr("id % 2 AS left", "1 - id % 2 AS right")
    row = stats.agreement(same).first()
    assert row["left_pairs"] * row["right_pairs"] > 1 << 63 and row["adjusted_rand"] == 1.0
