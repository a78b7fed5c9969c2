"""Road and plan operators against brute force on small inputs, and strict readers on faulty files."""

from __future__ import annotations

import heapq
import random
import time

import pytest

from sparkway.operators import candidates, roads
from sparkway.sources import files


def test_cover_against_brute_force(spark):
    rng = random.Random(3)
    plans = sorted({(g, rng.randrange(30), rng.randrange(30)) for g in range(3) for _ in range(60)})
    tolerance = (4, 2)
    expected = {}
    for g in range(3):
        mine, chosen = [p for p in plans if p[0] == g], []
        for rank, p in enumerate(mine):
            by = next((r for r, q in chosen if q[1] <= p[1] + tolerance[0] and q[2] <= p[2] + tolerance[1]), None)
            if by is None:
                chosen.append((rank, p))
            expected[p] = (rank, rank if by is None else by)
    covered = candidates.cover(spark.createDataFrame(plans, "g long, x long, y long"), "g", ["x", "y"], tolerance)
    assert {(r.g, r.x, r.y): (r["rank"], r.covered_by) for r in covered.collect()} == expected
    assert candidates.cover_faults(covered, "g", ["x", "y"], tolerance).isEmpty()
    tight = candidates.cover_faults(covered, "g", ["x", "y"], (0, 0)).count()
    at = {(p[0], v[0]): p for p, v in expected.items()}
    assert tight == sum(any(q > x for q, x in zip(at[p[0], v[1]][1:], p[1:], strict=True)) for p, v in expected.items()) > 0


def test_strong_classes_of_cycles_chains_and_lone_nodes(spark):
    arcs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (8, 8), (9, 1)]
    found = roads.strong_classes(spark.range(1, 10), spark.createDataFrame(arcs, "source long, target long"))
    assert {r.id: r.component for r in found.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 9}


def _shuffled(spark, work):
    """What the work gives, and how many rows it shuffled."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def records():
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}

    before = set(records())
    found = work()
    time.sleep(1)
    return found, sum(n for k, n in records().items() if k not in before)


def test_legs_ask_for_labels_of_few_edges_and_make_the_edges_once(spark):
    rng = random.Random(5)
    arcs = {(a, b): (rng.randrange(1, 51), rng.randrange(9)) for a in range(100) for b in range(100) if a != b}
    edges = spark.createDataFrame([(*k, *v) for k, v in arcs.items()], "source long, target long, time_s long, length_m long")
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    sources = spark.createDataFrame([(o,) for o in range(4)], "origin long")
    name = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, "-1")
    try:
        found, rows = _shuffled(spark, lambda: roads.selected_legs(edges.mapInArrow(counted, edges.schema), sources).collect())
    finally:
        spark.conf.unset(name)
    for o in range(4):
        best, heap = {}, [(0, (o,), 0)]
        while heap:
            time_s, path, length = heapq.heappop(heap)
            if path[-1] not in best:
                best[path[-1]] = (time_s, length, list(path))
                for b in range(100):
                    if b not in best and b != path[-1]:
                        t, m = arcs[path[-1], b]
                        heapq.heappush(heap, (time_s + t, (*path, b), length + m))
        assert {r.node: (r.time_s, r.length_m, r.path) for r in found if r.origin == o} == best
    assert made.value == len(arcs) and rows < 3 * len(arcs)


def test_legs_of_many_requests_are_looked_up_once_a_pair(spark):
    legs = spark.createDataFrame([(0, 7, 5, 50), (0, 8, 6, 60), (1, 7, 9, 90)], "source long, target long, time_s long, length_m long")
    # more sites than are sent to all tasks, one of them twice, and one without an anchor
    aliases = spark.range(20_000).selectExpr("id AS site", "CASE WHEN id <> 9 THEN id END AS anchor").unionByName(spark.createDataFrame([(8, 7)], "site long, anchor long"))
    asked = spark.range(30_000).selectExpr("id AS request", "IF(id % 5 = 4, null, id % 5) AS from_site", "id % 4 + 6 AS to_site")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        found, rows = _shuffled(spark, lambda: roads.legs_of_sites(legs, aliases, asked).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    leg, anchors = {(0, 7): (5, 50), (0, 8): (6, 60), (1, 7): (9, 90)}, lambda site: (8, 7) if site == 8 else (site,)
    right = [(r, *leg.get((a, b), (None, None))) for r in range(30_000) for a in [None if r % 5 == 4 else r % 5] for b in anchors(r % 4 + 6)]
    some = lambda rows: sorted((r, t or 0, m or 0) for r, t, m in rows)
    assert some((r.request, r.time_s, r.length_m) for r in found) == some(right)
    assert all(r.reachable == (r.time_s is not None) for r in found)
    assert rows < 50_000


def test_skyline_with_copies_and_shares(spark):
    rng = random.Random(9)
    plans = [(rng.randrange(2), rng.randrange(12), rng.randrange(12), rng.randrange(12) / 2) for _ in range(500)] + [(0, 0, 11, 0.5)] * 30
    frame = spark.createDataFrame(plans, "g long, x long, y long, z double").repartition(3)
    beats = lambda q, p: q[0] == p[0] and q != p and all(a <= b for a, b in zip(q, p, strict=True))
    want = sorted(p for p in plans if not any(beats(q, p) for q in plans))
    for share_rows in (20_000, 7):
        assert sorted(map(tuple, candidates.skyline(frame, "g", ["x", "y", "z"], share_rows).collect())) == want
    assert candidates.skyline(frame.limit(0), "g", ["x", "y", "z"]).count() == 0


def test_random_control(spark):
    plans = [(k % 3, k, k % 2) for k in range(90)] + [(0, 1000, 0)] * 20
    frame = spark.createDataFrame(plans, "g long, x long, y long")
    chosen = spark.createDataFrame([(0,)] * 25 + [(1,)] * 400 + [(7,)], "g long")
    draw = lambda seed, parts: sorted(map(tuple, candidates.random_control(frame.repartition(parts), chosen, "g", ["x", "y"], seed).collect()))
    one = draw(1, 1)
    assert one == draw(1, 5) != draw(2, 1)
    assert [sum(p[0] == g for p in one) for g in range(3)] == [25, 30, 0]
    assert all(one.count(p) <= plans.count(p) for p in one)


def test_weight_family():
    family = candidates.weight_family(4000, 3, 1)
    assert family == candidates.weight_family(4000, 3, 1) != candidates.weight_family(4000, 3, 2)
    assert all(abs(sum(w) - 1) < 1e-12 and min(w) > 0 for w in family)
    # evenly over the triangle: a third is the mean, and half of a coordinate is exceeded by a quarter
    assert all(abs(sum(w[c] for w in family) / 4000 - 1 / 3) < 0.02 and abs(sum(w[c] > 0.5 for w in family) / 4000 - 0.25) < 0.03 for c in range(3))


PRETTY = '{\n  "rows": [\n    {\n      "id": 1,\n      "at": {\n        "x": 2\n      }\n    },\n    {\n      "id": 3,\n      "at": null\n    }\n  ]\n}\n'


def test_pretty_array(spark, tmp_path):
    (tmp_path / "a.json").write_text(PRETTY)
    rows = files.read_pretty_array(spark, str(tmp_path / "a.json"), "rows", "id long, at struct<x: long>")
    assert [(r.id, r["at"] and r["at"].x) for r in rows.orderBy("id").collect()] == [(1, 2), (3, None)]


@pytest.mark.parametrize(("old", "new"), [("  ]\n}\n", ""), ("    {\n", "   {\n"), ('"id": 3', '"id": 3,\n      "id": 4'), ('"id": 3', '"other": 3'), ('"rows"', '"more"')])
def test_pretty_array_refuses(spark, tmp_path, old, new):
    (tmp_path / "a.json").write_text(PRETTY.replace(old, new))
    with pytest.raises(Exception, match="indented array|twice|outside|MALFORMED|Malformed"):
        files.read_pretty_array(spark, str(tmp_path / "a.json"), "rows", "id long, at struct<x: long>").collect()


@pytest.mark.parametrize("line", ['{"id": 1, "id": 2}', '{"id": 1, "v": NaN}'])
def test_strict_json_refuses(spark, tmp_path, line):
    (tmp_path / "a.json").write_text(line + "\n")
    with pytest.raises(Exception, match="twice|Malformed|MALFORMED|FAILFAST|NaN"):
        files.read_strict_json(spark, str(tmp_path / "a.json"), "id long, v double").collect()
