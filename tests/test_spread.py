"""Distances that spread block by block, against plain relaxation."""

from __future__ import annotations

import heapq
import random
import time

import pytest
from pyspark.sql import functions as F

from sparkway.operators import roads


def plain(arcs, start, limit=1 << 60):
    """{(origin, node): dist} of start labels (origin, node, dist)."""
    out: dict = {}
    for a, b, w in arcs:
        out.setdefault(a, []).append((b, w))
    best = {}
    for origin in {s[0] for s in start}:
        heap = [(d, n) for o, n, d in start if o == origin]
        heapq.heapify(heap)
        while heap:
            d, n = heapq.heappop(heap)
            if (origin, n) in best:
                continue
            best[origin, n] = d
            for m, w in out.get(n, []):
                if d + w <= limit and (origin, m) not in best:
                    heapq.heappush(heap, (d + w, m))
    return best


def spread_of(spark, arcs, start, **more):
    edges = spark.createDataFrame(arcs, "source long, target long, time_s long")
    rows = roads.spread(edges, spark.createDataFrame(start, "origin long, node long, dist long"), **more).collect()
    found = {(r["origin"], r["node"]): r["dist"] for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize(("block", "origins"), [(100_000, 16), (23, 2), (150, 1)])
def test_spread(spark, monkeypatch, block, origins):
    monkeypatch.setattr(roads, "BLOCK_EDGES", block)
    monkeypatch.setattr(roads, "ORIGINS", origins)
    monkeypatch.setattr(roads, "CELLS", 150)
    rng = random.Random(block)
    # a hub with a third of all edges, parallel edges, edges of no weight, a part that nothing reaches
    arcs = [(rng.randrange(60), rng.randrange(60), rng.randrange(0, 30)) for _ in range(120)] + [(7, n, rng.randrange(1, 90)) for n in range(60)] + [(90, 91, 1), (91, 5, 2)]
    start = [(1, 3, 0), (1, 40, 5), (2, 7, 0), (5, 5, 1), (6, 77, 0)]
    assert spread_of(spark, arcs, start) == plain(arcs, start)
    assert spread_of(spark, arcs, start, limit=25) == plain(arcs, start, 25)


def test_spread_of_nothing(spark):
    assert spread_of(spark, [], [(1, 2, 3)]) == {(1, 2): 3}
    assert spread_of(spark, [(1, 2, 3)], []) == {}


def test_long_chain(spark, monkeypatch):
    monkeypatch.setattr(roads, "BLOCK_EDGES", 700)
    began = time.monotonic()
    arcs = [(k, k + 1, 1) for k in range(2000)]
    assert spread_of(spark, arcs, [(0, 0, 0)]) == {(0, k): k for k in range(2001)}
    assert time.monotonic() - began < 60


def test_a_loop_of_joins_keeps_its_true_size_and_sends_little(spark):
    from sparkway.operators.tables import small_broadcasts, stored

    rows = spark.range(50).withColumnRenamed("id", "a")
    for _ in range(5):
        rows = stored(rows.join(rows, "a"))
    assert rows.count() == 50 and len(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 7
    name = "spark.sql.autoBroadcastJoinThreshold"
    for given, kept in (("10485760b", str(1 << 20)), ("256k", "256k"), ("-1", "-1")):
        spark.conf.set(name, given)
        small_broadcasts(spark)
        assert spark.conf.get(name) == kept
    spark.conf.unset(name)


def test_a_way_through_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(roads, "BLOCK_EDGES", 100)
    began = time.monotonic()
    arcs = [(k, k + 1, 1) for k in range(2400)]
    assert spread_of(spark, arcs, [(0, 0, 0)]) == {(0, k): k for k in range(2401)}
    assert time.monotonic() - began < 90


@pytest.mark.parametrize("block", [40, 1_000_000])
def test_strong_classes_by_rounds_and_by_one_block(spark, monkeypatch, block):
    monkeypatch.setattr(roads, "BLOCK_EDGES", block)
    rng = random.Random(3)
    arcs = [(rng.randrange(30), rng.randrange(30), 1) for _ in range(45)] + [(k, k + 1, 1) for k in range(100, 106)] + [(106, 103, 1)]
    nodes = sorted({n for a, b, _ in arcs for n in (a, b)} | {500})
    reach = {n: {m for _, m in plain(arcs, [(0, n, 0)])} for n in nodes}
    right = {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}
    found = roads.strong_classes(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(arcs, "source long, target long, time_s long")).collect()
    assert {r["id"]: r["component"] for r in found} == right and len(found) == len(right)


@pytest.mark.parametrize("limit", [None, 9])
def test_many_edges_a_node_take_the_useful_ones(spark, monkeypatch, limit):
    monkeypatch.setattr(roads, "BLOCK_EDGES", 300)
    rng = random.Random(8)
    # dense in the middle; nodes that only heavy edges reach, and one beyond them
    arcs = [(rng.randrange(40), rng.randrange(40), rng.randrange(1, 50)) for _ in range(3000)] + [(n, 50, 70 + n) for n in range(40) if n not in (3, 7, 9)] + [(50, 51, 1), (52, 3, 1)]
    # one origin has no light edge
    arcs = [(a, b, w + 8 if a == 3 else w) for a, b, w in arcs]
    start = [(1, 3, 0), (2, 7, 4), (2, 9, -2)]
    packed = []
    inner = roads._packed
    monkeypatch.setattr(roads, "_packed", lambda hop, blocks: packed.append(hop.count()) or inner(hop, blocks))
    more = {} if limit is None else {"limit": limit}
    assert spread_of(spark, arcs, start, **more) == plain(arcs, start, **more)
    assert len(packed) == (2 if limit is None else 1) and packed[-1] < len(arcs) * 0.6


def test_twenty_origins_with_a_limit_spread_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(roads, "_relaxed", None)
    rng = random.Random(9)
    arcs = [(rng.randrange(50), rng.randrange(50), rng.randrange(1, 20)) for _ in range(900)]
    start = [(o, o, 0) for o in range(20)]
    assert spread_of(spark, arcs, start, limit=8) == plain(arcs, start, 8)


def test_a_session_without_a_threshold_of_its_own_sends_little(spark):
    from sparkway.operators.tables import SENT_BYTES, small_broadcasts, stored

    name = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.unset(name)
    try:
        small_broadcasts(spark)
        assert spark.conf.get(name) == str(SENT_BYTES)
        # labels as a round leaves them: 400,000 rows are less than a megabyte of file
        labels = stored(spark.range(0, 400_000, numPartitions=2).selectExpr("id div 100000 AS origin", "id % 100000 AS node", "id % 7 AS dist"))
        plan = labels.join(labels.select("node", F.col("dist").alias("other")), "node")._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" not in plan
    finally:
        spark.conf.unset(name)
