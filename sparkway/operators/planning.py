"""Plans over given legs: the best way with at most one stop, and pairs of stops with dwell, concurrency, access and length."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Energies and windows are held with this much room.
ROOM = 1e-8


def piecewise(x: Column, segments: Sequence[tuple[float, float, float, float]]) -> Column:
    """slope * x + intercept of the segment (low, high, slope, intercept) that holds x; null outside all of them.

    Segments follow on each other and agree where they meet, else it is an error.
    """
    if not segments or any(a >= b for a, b, _, _ in segments):
        raise ValueError("segments must have a length")
    for (_, high, slope, intercept), (low, _, other, start) in zip(segments, segments[1:], strict=False):
        if high != low or abs(slope * high + intercept - other * high - start) > 1e-9 * max(1.0, abs(start)):
            raise ValueError(f"segments don't meet at {high}")
    return F.coalesce(*[F.when((x >= a) & (x <= b), x * float(s) + float(c)) for a, b, s, c in segments], F.lit(None).cast("double"))


def charging_segments(bands: Sequence[tuple[float, float]], capacity: float) -> list[tuple[float, float, float, float]]:
    """Seconds from empty as segments of energy, from bands (upper share of the capacity, kW) that rise to one."""
    low, seconds, out = 0.0, 0.0, []
    for upper, power in bands:
        if not low < upper * capacity <= capacity or power <= 0:
            raise ValueError("bands must rise to one and have power")
        slope = 3600 / power
        out.append((low, upper * capacity, slope, seconds - slope * low))
        seconds += slope * (upper * capacity - low)
        low = upper * capacity
    if not out or out[-1][1] != capacity:
        raise ValueError("bands must cover the capacity")
    return out


@dataclass(frozen=True)
class Vehicle:
    """Energies in kWh; ``floor`` is what has to be left at the end."""

    capacity: float
    minimum: float
    floor: float
    per_m: float
    bands: tuple[tuple[float, float], ...] = ((0.5, 100.0), (0.8, 60.0), (1.0, 30.0))


@dataclass(frozen=True)
class Schedule:
    """An activity to begin in a window; seconds."""

    opens: float
    closes: float
    duration: float
    hard: bool
    miss: float
    per_s: float
    while_charging: bool


@dataclass(frozen=True)
class Costs:
    """What a stop takes and costs, and what a kilometre costs, in seconds."""

    overhead: float
    stop: float
    per_km: float


def best_one_stop(trips: DataFrame, direct: DataFrame, legs: DataFrame, vehicle: Vehicle, costs: Costs, schedule: Schedule | None = None) -> DataFrame:
    """(trip, site, start, charged, clock, cost): the cheapest plan of each trip with at most one stop; site and start are null without.

    ``trips`` has trip, energy, departs and budget (of driving time, null: none); ``direct`` trip, time_s, length_m; ``legs`` trip, site,
    charges, hosts, and time and length in and out (time_in, length_in, time_out, length_out), missing legs being no rows.  Trips without a plan
    have no row.

    A stop charges what the rest of the way takes.  The cost is piecewise linear in when the activity starts, so it is least at one of four
    places: the earliest start, both ends of the window, and where the activity ends with the charging.  These are
    compared, and the plans of a trip with them; equal costs (to 1e-7) go to less energy, no stop, and the smaller site.
    """
    drive = lambda metres: F.col(metres) * vehicle.per_m
    miss = 0.0 if schedule is None else schedule.miss
    hard = schedule is not None and schedule.hard
    within = lambda driven: F.coalesce(driven <= F.col("budget") + 1e-7, F.lit(True))
    plan = lambda cost, charged, stops, site, start, clock: F.struct(F.round(cost, 7).alias("key"), charged.alias("charged"), F.lit(stops).alias("stops"), site.cast("long").alias("site"), start.cast("double").alias("start"), clock.alias("clock"))

    none = F.lit(None)
    straight = trips.join(direct, "trip").where((F.col("energy") - drive("length_m") >= vehicle.floor - ROOM) & within(F.col("time_s")) & F.lit(not hard))
    straight = straight.select("trip", plan(F.col("time_s") + miss + F.col("length_m") * costs.per_km / 1000, F.lit(0.0), 0, none, none, F.col("time_s").cast("double")).alias("plan"))

    at = trips.join(legs, "trip").join(direct.select("trip"), "trip", "left_semi").where(within(F.col("time_in") + F.col("time_out")))
    at = at.withColumn("left", F.col("energy") - drive("length_in"))
    at = at.withColumn("needed", F.greatest(F.lit(0.0), drive("length_out") + vehicle.floor - F.col("left")))
    at = at.where((F.col("left") >= vehicle.minimum - ROOM) & (F.col("left") + F.col("needed") <= vehicle.capacity + ROOM) & ((F.col("needed") <= ROOM) | F.col("charges")))
    segments = charging_segments(vehicle.bands, vehicle.capacity)
    spent = lambda e: piecewise(F.least(F.lit(vehicle.capacity), F.greatest(F.lit(0.0), e)), segments)
    at = at.withColumn("charging", spent(F.col("left") + F.col("needed")) - spent(F.col("left")))
    ready = F.col("time_in") + costs.overhead
    idle = F.array(F.lit(None).cast("double"))
    if schedule is None:
        starts = idle
    else:
        opens, closes = F.lit(schedule.opens) - F.col("departs"), F.lit(schedule.closes) - F.col("departs")
        earliest = ready if schedule.while_charging else ready + F.col("charging")
        places = F.array_distinct(F.array(*[F.greatest(earliest, t).cast("double") for t in (earliest, opens, closes, ready + F.col("charging") - schedule.duration)]))
        starts = F.when(F.col("hosts"), places if hard else F.concat(idle, places)).when(F.lit(not hard), idle)
    tried = at.withColumn("start", F.explode(starts))
    if schedule is None:
        off, stay = F.lit(0.0), costs.overhead + F.col("charging")
        penalty = F.lit(0.0)
    else:
        off = F.greatest(opens - F.col("start"), F.col("start") - closes, F.lit(0.0))
        tried = tried.where(F.col("start").isNull() | (off <= ROOM)) if hard else tried
        stay = F.when(F.col("start").isNull(), costs.overhead + F.col("charging")).otherwise(F.greatest(costs.overhead + F.col("charging"), F.col("start") - F.col("time_in") + schedule.duration))
        penalty = F.when(F.col("start").isNull(), miss).otherwise(off * schedule.per_s)
    clock = F.col("time_in") + stay + F.col("time_out")
    cost = clock + costs.stop + penalty + (F.col("length_in") + F.col("length_out")) * costs.per_km / 1000
    stopped = tried.select("trip", plan(cost, F.col("needed"), 1, F.col("site"), F.col("start"), clock).alias("plan"))
    best = straight.unionByName(stopped).groupBy("trip").agg(F.min("plan").alias("p"))
    return best.select("trip", "p.site", "p.start", "p.charged", "p.clock", F.col("p.key").alias("cost"))


@dataclass(frozen=True)
class Task:
    """What a plan has to offer (bit -> seconds of the activity), and when two stops count as one place."""

    durations: dict[int, float]
    near_m: float
    most_time: float
    most_length: float
    together_m: float
    both_ways: bool = True

    @property
    def mask(self) -> int:
        return sum(self.durations)


def paired_plans(sites: DataFrame, pairs: DataFrame, trip: tuple[float, float, float], task: Task, access: str = "all", dwell: str = "none") -> DataFrame:
    """(first, second, time_s, length_m, extra_time, extra_length, stops, dwell, risk, concurrent): plans of one or two stops within a budget.

    ``sites`` has id, mask, risk and the times and lengths from the origin (time_in, length_in) and to the destination (time_out, length_out), null where there is no way.
    ``pairs`` has a < b, near_m, and each way distance, time and length of the fastest leg (there and back: distance_there, time_there, length_there, ...), null too.
    ``trip`` is the direct time and length and the budget of time.

    One stop offers all; of two each offers something and both all.  Pairs count within ``near_m``, legs up to ``most_time`` and ``most_length``
    of distance.  concurrent: 2 for one stop that takes several activities, 1 for stops at most ``together_m`` apart (both ways, or one), else 0.  risk is the larger
    of the stops'; access 'conservative' takes plans without risk only.  dwell 'concurrent' adds the activities, or takes the longest where
    they are concurrent; 'none' leaves it out.  second is -1 for one stop.
    """
    if access not in ("all", "conservative") or dwell not in ("none", "concurrent"):
        raise ValueError("access is 'all' or 'conservative', dwell 'none' or 'concurrent'")
    mask, several = task.mask, len(task.durations) > 1
    base_time, base_length, budget = trip
    offers = F.col("mask").bitwiseAND(mask)
    single = sites.where(offers == mask).select(
        F.col("id").alias("first"), F.lit(-1).cast("long").alias("second"), (F.col("time_in") + F.col("time_out")).alias("time_s"), (F.col("length_in") + F.col("length_out")).alias("length_m"),
        "risk", F.lit(2 if several else 0).alias("concurrent"), F.lit(1).alias("stops"),
    )
    plans = single
    if several:
        ways = [("a", "b", "there"), ("b", "a", "back")]
        apart = [F.coalesce(F.col(f"distance_{w}").cast("double"), F.lit(float("inf"))) for w in ("there", "back")]
        proxy = F.greatest(*apart) if task.both_ways else F.least(*apart)
        near = pairs.where(F.col("near_m") <= task.near_m).withColumn("together", (proxy <= task.together_m).cast("int"))
        legs = [near.select(F.col(i).alias("first"), F.col(j).alias("second"), F.col(f"distance_{w}").alias("distance"), F.col(f"time_{w}").alias("leg_s"), F.col(f"length_{w}").alias("leg_m"), "together") for i, j, w in ways]
        legs = legs[0].unionByName(legs[1]).where((F.col("leg_s") <= task.most_time) & (F.col("distance") <= task.most_length))
        start = sites.select(F.col("id").alias("first"), offers.alias("m1"), F.col("risk").alias("r1"), "time_in", "length_in").where("m1 <> 0")
        end = sites.select(F.col("id").alias("second"), offers.alias("m2"), F.col("risk").alias("r2"), "time_out", "length_out").where("m2 <> 0")
        both = legs.join(start, "first").join(end, "second").where(F.col("m1").bitwiseOR(F.col("m2")) == mask)
        double = both.select(
            "first", "second", (F.col("time_in") + F.col("leg_s") + F.col("time_out")).alias("time_s"), (F.col("length_in") + F.col("leg_m") + F.col("length_out")).alias("length_m"),
            F.greatest("r1", "r2").alias("risk"), F.col("together").alias("concurrent"), F.lit(2).alias("stops"),
        )
        plans = single.unionByName(double)
    plans = plans.where((F.col("time_s") <= budget) & F.col("length_m").isNotNull())
    if access == "conservative":
        plans = plans.where("risk = 0")
    total, longest = float(sum(task.durations.values())), float(max(task.durations.values()))
    stay = F.lit(0.0) if dwell == "none" else F.when(F.col("concurrent") > 0, longest).otherwise(total)
    return plans.select("first", "second", "time_s", "length_m", (F.col("time_s") - base_time).alias("extra_time"), (F.col("length_m") - base_length).alias("extra_length"), "stops", stay.alias("dwell"), "risk", "concurrent")
