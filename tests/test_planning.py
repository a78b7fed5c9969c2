"""Piecewise functions and plans with one stop against plain search."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkway.operators import planning


def test_piecewise(spark):
    segments = planning.charging_segments(((0.5, 100.0), (0.8, 60.0), (1.0, 30.0)), 60.0)
    rows = spark.createDataFrame([(float(x),) for x in (-1, 0, 15, 30, 48, 54, 60, 61)], "x double")
    got = [r["v"] for r in rows.select("x", planning.piecewise(F.col("x"), segments).alias("v")).orderBy("x").collect()]
    want = [None, 0, 540, 1080, 1080 + 1080, 2160 + 720, 2160 + 1440, None]
    assert [v if v is None else pytest.approx(v) for v in want] == got
    with pytest.raises(ValueError, match="meet"):
        planning.piecewise(F.col("x"), [(0, 1, 1, 0), (1, 2, 1, 5)])
    with pytest.raises(ValueError, match="length"):
        planning.piecewise(F.col("x"), [(1, 1, 1, 0)])
    for bands in (((0.5, 10.0),), ((0.5, 10.0), (0.5, 5.0), (1.0, 1.0)), ((1.0, 0.0),)):
        with pytest.raises(ValueError, match="bands"):
            planning.charging_segments(bands, 60.0)


@pytest.mark.parametrize(("hard", "while_charging"), [(None, None), (False, True), (False, False), (True, True)])
def test_no_other_start_is_cheaper(spark, hard, while_charging):
    """Every start on a fine grid, tried one by one, costs at least as much as the plan found."""
    rng = random.Random(f"{hard}{while_charging}")
    vehicle, costs = planning.Vehicle(60.0, 6.0, 9.0, 0.0002), planning.Costs(300.0, 120.0, 2.0)
    schedule = None if hard is None else planning.Schedule(4000.0, 4600.0, 1500.0, hard, 2500.0, 0.5, while_charging)
    trips = [(t, rng.uniform(10, 50), float(rng.randrange(0, 900)), rng.choice([None, 5000.0])) for t in range(25)]
    direct = {t: (rng.randrange(1000, 6000), rng.randrange(40_000, 250_000)) for t in range(24)}
    legs = [(t, s, rng.random() < 0.7, rng.random() < 0.6, rng.randrange(500, 4000), rng.randrange(1000, 150_000), rng.randrange(500, 4000), rng.randrange(1000, 150_000)) for t in range(25) for s in range(rng.randrange(5))]
    segments = planning.charging_segments(vehicle.bands, 60.0)
    curve = lambda e: next(k * e + c for a, b, k, c in segments if a <= e <= b)
    best = {}
    for t, energy, departs, budget in trips:
        if t not in direct:
            continue
        time, length = direct[t]
        if energy - length * 0.0002 >= 9 and (budget is None or time <= budget) and not hard:
            best[t] = time + (schedule.miss if schedule else 0) + length * 0.002
        for _, s, charges, hosts, t_in, l_in, t_out, l_out in (leg for leg in legs if leg[0] == t):
            left = energy - l_in * 0.0002
            needed = max(0, l_out * 0.0002 + 9 - left)
            if left < 6 or left + needed > 60 or (needed > 0 and not charges) or (budget is not None and t_in + t_out > budget):
                continue
            charging = curve(left + needed) - curve(left)
            options = [] if hard else [(t_in + 300 + charging + t_out, schedule.miss if schedule else 0)]
            if schedule and hosts:
                first = t_in + 300 + (0 if while_charging else charging)
                for start in [first + 5 * k for k in range(2500)]:
                    off = max(4000 - departs - start, start - 4600 + departs, 0)
                    if not (hard and off > 0):
                        options.append((t_in + max(300 + charging, start - t_in + 1500) + t_out, off * 0.5))
            for clock, penalty in options:
                best[t] = min(best.get(t, 1e18), clock + penalty + 120 + (l_in + l_out) * 0.002)
    frames = (
        spark.createDataFrame(trips, "trip long, energy double, departs double, budget double"),
        spark.createDataFrame([(t, *v) for t, v in direct.items()], "trip long, time_s long, length_m long"),
        spark.createDataFrame(legs, "trip long, site long, charges boolean, hosts boolean, time_in long, length_in long, time_out long, length_out long"),
    )
    found = {r["trip"]: r["cost"] for r in planning.best_one_stop(*frames, vehicle, costs, schedule).collect()}
    assert set(found) == set(best) and len(found) > 5
    assert all(best[t] - 8 <= found[t] <= best[t] + 1e-6 for t in best)


def test_plans_refuse_unknown_views(spark):
    with pytest.raises(ValueError, match="conservative"):
        planning.paired_plans(spark.range(1), spark.range(1), (1, 1, 1), planning.Task({1: 1.0}, 1, 1, 1, 1), access="some")
