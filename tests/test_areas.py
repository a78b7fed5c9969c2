"""Geodesics against published lines, containment and clipping against plain geometry."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from sparkway.functions import geo
from sparkway.operators import areas
from sparkway.sources import files

# Published lengths in metres: quarter meridian and equator, half the globe, test lines of the literature.
LINES = [
    ((0, 0, 90, 0), 10001965.7293),
    ((0, 0, 0, 90), 10018754.1714),
    ((0, 0, 0, 180), 20003931.4586),
    ((40, 0, 41.79331020506, 137.84490004377), 10_000_000.0),
    ((-30, 0, 29.9, 179.8), 19989832.8276),
    ((0, 0, 0.5, 179.5), 19936288.5790),
    ((-(37 + 57 / 60 + 3.72030 / 3600), 144 + 25 / 60 + 29.52440 / 3600, -(37 + 39 / 60 + 10.15610 / 3600), 143 + 55 / 60 + 35.38390 / 3600), 54972.271),
    ((12, 34, 12, 34), 0.0),
]


@pytest.mark.parametrize(("line", "metres"), LINES)
def test_geodesic_lines(line, metres):
    swapped = (*line[2:], *line[:2])
    for a in (line, swapped, (-line[0], line[1], -line[2], line[3]), (line[0], line[1] + 360, line[2], line[3])):
        assert geo.geodesic_metres(*[np.array([float(v)]) for v in a])[0] == pytest.approx(metres, abs=1e-3)


def test_geodesic_both_ways_agree():
    rng = np.random.default_rng(5)
    lat, lon = np.arctan((1 - geo.WGS84_F) * np.tan(np.radians(rng.uniform(-89, 89, (2, 400))))), np.radians(rng.uniform(0, 175, 400))
    by_iteration, settled = geo._vincenty(*lat, lon)
    assert np.abs(by_iteration - geo._by_azimuth(*lat, lon))[settled].max() < 1e-3


def test_geodesic_column(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, 0.5, 179.5), (4, -0.3, 179.7)], "id long, lat double, lon double")
    from pyspark.sql import functions as F

    origin, destination = (F.lit(0.0), F.lit(0.0)), (F.lit(0.5), F.lit(179.5))
    got = {r["id"]: r["d"] for r in rows.select("id", geo.geodesic_detour(F.col("lat"), F.col("lon"), origin, destination).alias("d")).collect()}
    assert got[1] == pytest.approx(0, abs=1e-3) and got[2] is None and got[3] == pytest.approx(0, abs=1e-3) and got[4] > 10_000


def test_equal_area_of_a_published_point(spark):
    from pyspark.sql import functions as F

    east, north = geo.equal_area(F.lit(50.0), F.lit(5.0))
    row = spark.range(1).select(east.alias("e"), north.alias("n")).first()
    assert (row["e"], row["n"]) == (pytest.approx(3962799.45, abs=0.01), pytest.approx(2999718.85, abs=0.01))


def star(rng, n, least, most, cx=0.0, cy=0.0):
    spots = []
    for k in range(n):
        far = rng.uniform(least, most)
        spots.append((cx + far * math.cos(2 * math.pi * k / n), cy + far * math.sin(2 * math.pi * k / n)))
    return spots


def ring_rows(rings):
    return [(r, hole, k, float(x), float(y)) for r, (hole, spots) in enumerate(rings) for k, (x, y) in enumerate(spots)]


def in_ring(x, y, spots):
    odd = False
    for (x1, y1), (x2, y2) in zip(spots, [*spots[1:], spots[0]], strict=True):
        if (y1 <= y) != (y2 <= y) and x1 + (y - y1) / (y2 - y1) * (x2 - x1) > x:
            odd = not odd
    return odd


def in_area(x, y, rings):
    return any(in_ring(x, y, s) for hole, s in rings if not hole) and not any(in_ring(x, y, s) for hole, s in rings if hole)


def to_rings(x, y, rings):
    def far(a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = min(1, max(0, ((x - a[0]) * dx + (y - a[1]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(x - a[0] - t * dx, y - a[1] - t * dy)

    return min(far(a, b) for _, s in rings for a, b in zip(s, [*s[1:], s[0]], strict=True) if a != b)


RINGS = "ring long, hole boolean, seq long, x double, y double"


@pytest.mark.parametrize(("margin", "cell"), [(0.0, 1.0), (3.0, 5.0), (25.0, None)])
def test_boundary_risk(spark, margin, cell):
    rng = random.Random(margin)
    rings = [(False, star(rng, 40, 20, 60)), (True, star(rng, 9, 4, 12, 3, 2)), (False, star(rng, 5, 10, 20, 120, -10)), (False, [(200, 0), (200, 0), (200, 40), (240, 40), (240, 0), (200, 0)])]
    points = [(k, rng.uniform(-80, 260), rng.uniform(-80, 80)) for k in range(600)]
    got = areas.boundary_risk(spark.createDataFrame(points, "id long, x double, y double").repartition(3), spark.createDataFrame(ring_rows(rings), RINGS), margin, cell).collect()
    want = {}
    for k, x, y in points:
        held, near = in_area(x, y, rings), margin > 0 and to_rings(x, y, rings) <= margin
        want[k] = (held, near, not held or near)
    assert {r["id"]: (r["inside"], r["near"], r["risk"]) for r in got} == want and len(got) == len(points)


def test_boundary_of_a_file(spark, tmp_path):
    """A .poly file with a hole, projected; as in the surveyed fixtures: middle, hole, edge, outside."""
    from pyspark.sql import functions as F

    (tmp_path / "a.poly").write_text("area\n1\n14 46\n15 46\n15 47\n14 47\nEND\n!1\n14.4 46.4\n14.6 46.4\n14.6 46.6\n14.4 46.6\nEND\nEND\n")
    project = lambda rows: rows.select("*", *[c.alias(n) for c, n in zip(geo.equal_area(F.col("lat"), F.col("lon")), "xy", strict=True)])
    rings = project(files.read_boundary(spark, f"{tmp_path}/a.poly"))
    points = project(spark.createDataFrame([(0, 46.2, 14.2), (1, 46.5, 14.5), (2, 46.00001, 14.2), (3, 45.9, 14.2)], "id long, lat double, lon double"))
    got = areas.boundary_risk(points, rings, 1000).orderBy("id").collect()
    assert [r["risk"] for r in got] == [False, True, True, True]


def test_area_refuses(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    good = spark.createDataFrame(ring_rows([(False, [(0, 0), (1, 0), (0, 1)])]), RINGS)
    with pytest.raises(ValueError, match="margin"):
        areas.boundary_risk(points, good, float("nan"))
    with pytest.raises(ValueError, match="different points"):
        areas.boundary_risk(points, spark.createDataFrame([(0, False, 0, 0.0, 0.0), (0, False, 1, 1.0, 0.0)], RINGS), 1)
    with pytest.raises(ValueError, match="no hole"):
        areas.boundary_risk(points, good.selectExpr("ring", "true AS hole", "seq", "x", "y"), 1)


def test_clipping_of_random_lines(spark):
    rng = random.Random(3)
    rings = [(False, star(rng, 15, 30, 60)), (True, star(rng, 6, 5, 15))]
    ways = {w: [(rng.uniform(-70, 70), rng.uniform(-70, 70)) for _ in range(rng.randrange(1, 7))] for w in range(60)}
    rows = [(w, k, x, y, 100 * w + k, 1000.0) for w, s in ways.items() for k, (x, y) in enumerate(s)]
    frame = spark.createDataFrame(rows, "way long, seq long, x double, y double, node long, full_length double").repartition(3)
    got = {}
    for r in areas.clipped(frame, spark.createDataFrame(ring_rows(rings), RINGS), 9.0).collect():
        got.setdefault(r["way"], []).append(r)
    for w, spots in ways.items():
        steps = [math.hypot(b[0] - a[0], b[1] - a[1]) for a, b in zip(spots, spots[1:], strict=False)]
        whole, pieces = sum(steps), sorted(got.get(w, []), key=lambda r: r["from_m"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        for k in range(997 if whole else 0):  # places along the way are in a piece just where they are inside
            m = at = whole * (k + 0.5) / 997
            step = 0
            while at > steps[step]:
                at, step = at - steps[step], step + 1
            x, y = (a + (b - a) * at / steps[step] for a, b in zip(spots[step], spots[step + 1], strict=True))
            if to_rings(x, y, rings) > 1e-6:
                assert any(r["from_m"] <= m <= r["to_m"] for r in pieces) == in_area(x, y, rings)
        for r in pieces:
            assert r["length"] == pytest.approx(1000 * (r["to_m"] - r["from_m"]) / whole)
            assert (r["source"] == str(100 * w)) == (r["from_m"] <= 1e-6) and (r["target"] == str(100 * w + len(spots) - 1)) == (whole - r["to_m"] <= 1e-6)
            assert all(n.startswith(f"clip:{w}:") for n in (r["source"], r["target"]) if n not in (str(100 * w), str(100 * w + len(spots) - 1)))


def test_clipping_along_the_boundary(spark):
    square = spark.createDataFrame(ring_rows([(False, [(0, 0), (10, 0), (10, 10), (0, 10)])]), RINGS)
    ways = {1: [(-5, 5), (15, 5)], 2: [(5, 5), (6, 5), (6, 5), (7, 5)], 3: [(20, 0), (20, 9)], 4: [(5, 5), (5, 5)], 5: [(-5, 3), (5, 3), (5, 20), (8, 20), (8, 5)]}
    rows = [(w, k, float(x), float(y), f"n{k}", 8.0) for w, s in ways.items() for k, (x, y) in enumerate(s)]
    got = areas.clipped(spark.createDataFrame(rows, "way long, seq long, x double, y double, node string, full_length double"), square, 4.0).orderBy("way", "piece").collect()
    assert [(r["way"], r["piece"], r["from_m"], r["to_m"], r["length"]) for r in got] == [(1, 0, 5, 15, 4), (2, 0, 0, 2, 8), (5, 0, 5, 17, 8 * 12 / 45), (5, 1, 40, 45, 8 * 5 / 45)]
    assert [(r["source"][:4], r["target"][:4]) for r in got] == [("clip", "clip"), ("n0", "n3"), ("clip", "clip"), ("clip", "n4")]


def test_points_on_lines_fall_where_lines_to_their_right_put_them(spark):
    diamond = [(0, False, 0, 0.0, -6.0), (0, False, 1, 6.0, 0.0), (0, False, 2, 0.0, 6.0), (0, False, 3, -6.0, 0.0)]
    square = [(1, True, 0, -2.0, -2.0), (1, True, 1, 2.0, -2.0), (1, True, 2, 2.0, 2.0), (1, True, 3, -2.0, 2.0)]
    rings = spark.createDataFrame(diamond + square, "ring long, hole boolean, seq long, x double, y double")
    spots = [(k, float(k % 15 - 7), float(k // 15 - 7)) for k in range(225)]
    found = areas.boundary_risk(spark.createDataFrame(spots, "id long, x double, y double"), rings, 0.5, 2.0).collect()

    def odd(ring, x, y):
        ends = [(a[3], a[4], b[3], b[4]) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
        return sum((y1 <= y) != (y2 <= y) and x1 + (y - y1) / (y2 - y1) * (x2 - x1) > x for x1, y1, x2, y2 in ends) % 2 == 1

    assert {r["id"]: r["inside"] for r in found} == {k: odd(diamond, x, y) and not odd(square, x, y) for k, x, y in spots}


@pytest.mark.parametrize("sent", [400_000, 5])
def test_clipping_sends_no_cuts(spark, monkeypatch, sent):
    """A comb of many teeth: pieces in order with few of them at once, by lines that are sent and by cells; corners and ends that are met exactly."""
    monkeypatch.setattr(areas, "LINES_SENT", sent)
    monkeypatch.setattr(areas, "PIECES", 7)
    teeth = [p for k in range(30) for p in ((2 * k, 0), (2 * k + 1, 10))] + [(60, 0), (60, -5), (0, -5)]
    rings = [(0, False, k, float(x), float(y)) for k, (x, y) in enumerate(teeth)] + [(1, True, k, x, y) for k, (x, y) in enumerate([(3.0, -4.0), (9.0, -4.0), (9.0, -1.0), (3.0, -1.0)])]
    area = spark.createDataFrame(rings, "ring long, hole boolean, seq long, x double, y double")
    ways = {1: [(-5, 5), (70, 5), (70, -2), (-5, -2)], 2: [(0, 0), (60, 0)], 3: [(1, 10), (1, -3), (6, -3), (6, -4.5), (30, -4.5)], 4: [(5, 5), (5, 5)], 5: [(-9, 9), (-9, 8)]}
    rows = [(w, k, float(x), float(y), f"n{w}-{k}", 10.0) for w, spots in ways.items() for k, (x, y) in enumerate(spots)]
    found = {w: [] for w in ways}
    for r in areas.clipped(spark.createDataFrame(rows, "way long, seq long, x double, y double, node string, full_length double"), area, 4.0).orderBy("way", "piece").collect():
        assert r["piece"] == len(found[r["way"]]) and r["cut_source"] == r["source"].startswith("clip:") and r["cut_target"] == r["target"].startswith("clip:")
        found[r["way"]].append((round(r["from_m"], 6), round(r["to_m"], 6), r["source"] if not r["cut_source"] else "", r["target"] if not r["cut_target"] else ""))
    assert found[1] == [(round(5.5 + 2 * k, 6), round(6.5 + 2 * k, 6), "", "") for k in range(30)] + [(92.0, 143.0, "", ""), (149.0, 152.0, "", "")]
    assert [f[:2] for f in found[3]] == [(0.0, 15.0), (19.0, 43.5)] and found[3][0][2] == "n3-0" and found[3][-1][3] == "n3-4"
    assert not found[4] and not found[5]
    if sent > 5:
        plan = areas.clipped(spark.createDataFrame(rows, "way long, seq long, x double, y double, node string, full_length double"), area, 4.0)._jdf.queryExecution().toString()
        assert "cx" not in plan
