"""Seeded samples of trips and of walks between their ends, and the audit of envelopes against walks.

Choices follow from an order by hash, never from where a row lies, so that every partitioning gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import roads, spatial
from .tables import checkpointed, stored

#: Trips measured at first, for each that is wanted.
TRIPS = 20


def drawn(key: Column, seed: int, what: str) -> Column:
    """A number from 0 up to 1 that depends on the key, the seed and what it is for."""
    return F.pmod(F.xxhash64(F.lit(what), F.lit(seed).cast("long"), key), F.lit(1 << 40)) / float(1 << 40)


def draws(attempts: DataFrame, places: DataFrame, jitter: float, seed: int) -> DataFrame:
    """(attempt, ax, ay, bx, by): for every attempt two different places (place 0 to n - 1, x, y) and a point near each, evenly over a disc."""
    n = places.count()
    if n < 2:
        raise ValueError("two places at least")
    first = F.floor(drawn(F.col("attempt"), seed, "first") * n).cast("long")
    other = F.floor(drawn(F.col("attempt"), seed, "second") * (n - 1)).cast("long")
    chosen = attempts.select("attempt", first.alias("a"), (F.when(other >= first, other + 1).otherwise(other)).alias("b"))

    def near(side: str) -> list[Column]:
        far, turn = F.sqrt(drawn(F.col("attempt"), seed, f"far {side}")) * jitter, drawn(F.col("attempt"), seed, f"turn {side}") * 6.283185307179586
        return [F.floor(F.col(f"_{side}x") + far * F.cos(turn)).cast("long").alias(f"{side}x"), F.floor(F.col(f"_{side}y") + far * F.sin(turn)).cast("long").alias(f"{side}y")]

    at = lambda side: places.select(F.col("place").alias(side), F.col("x").alias(f"_{side}x"), F.col("y").alias(f"_{side}y"))
    return chosen.join(at("a"), "a").join(at("b"), "b").select("attempt", *near("a"), *near("b"))


def instances(tries: DataFrame, nodes: DataFrame, edges: DataFrame, allowed: DataFrame, bands: Sequence[tuple[int, int]], per_band: int, snap: int) -> DataFrame:
    """(band, place, attempt, origin, destination, length_m, time_s): the first ``per_band`` trips of each band, in order of attempt.

    ``tries`` (attempt, ax, ay, bx, by) are points to start and end at, in whole metres; each takes the nearest of ``nodes`` (id, x, y) within
    ``snap``, of equals the smaller id.  Both have to be ``allowed`` (id) and different; a trip that was found before is passed over.  Bands are
    half-open ranges of the shortest length, apart from each other; time_s is that of the fastest way.  A band that can't be filled is an error.
    """
    if per_band < 1 or snap < 1 or any(a >= b for a, b in bands):
        raise ValueError("bands, their number of trips and the snap distance must be positive")
    end = lambda side, sign: tries.select((-2 * F.col("attempt") - sign).alias("id"), F.col(f"{side}x").alias("x"), F.col(f"{side}y").alias("y"))
    spots = end("a", 1).unionByName(end("b", 2))
    snapped = spatial.nearest(spots, nodes.select("id", "x", "y"), 1, snap).join(allowed.select(F.col("id").alias("b")), "b", "left_semi")
    attempt, side = F.expr("(-a - 1) div 2"), F.expr("(-a - 1) % 2")
    both = snapped.groupBy(attempt.alias("attempt")).agg(F.max(F.when(side == 0, F.col("b"))).alias("origin"), F.max(F.when(side == 1, F.col("b"))).alias("destination"))
    trips = both.where("origin <> destination").groupBy("origin", "destination").agg(F.min("attempt").alias("attempt"))
    trips = stored(trips)
    n, taken = trips.count(), TRIPS * per_band * len(bands)
    band = F.coalesce(*[F.when((F.col("length_m") >= a) & (F.col("length_m") < b), F.lit(k)) for k, (a, b) in enumerate(bands)])
    place = F.row_number().over(Window.partitionBy("band").orderBy("attempt"))
    while True:
        # later trips change nothing once the earlier ones fill every band
        early = trips if taken >= n else stored(trips.orderBy("attempt").limit(taken))
        reach = roads.distances(edges, early.select("origin").distinct(), "length_m", limit=max(b for _, b in bands))
        lengths = early.join(reach.select("origin", F.col("node").alias("destination"), F.col("dist").alias("length_m")), ["origin", "destination"])
        first = stored(lengths.withColumn("band", band).where("band IS NOT NULL").withColumn("place", place).where(F.col("place") <= per_band))
        filled = {r["band"]: r["n"] for r in first.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each band
        if taken >= n or all(filled.get(k, 0) == per_band for k in range(len(bands))):
            break
        taken *= 8
    short = [b for k, b in enumerate(bands) if filled.get(k, 0) < per_band]
    if short:
        raise ValueError(f"too few trips in bands {short}: {filled}")
    times = roads.distances(edges, first.select("origin").distinct()).select("origin", F.col("node").alias("destination"), F.col("dist").alias("time_s"))
    return first.join(times, ["origin", "destination"]).select("band", "place", "attempt", "origin", "destination", "length_m", "time_s")


def waypoints(costs: DataFrame, ratios: Sequence[int], count: int, order: Column) -> DataFrame:
    """(origin, destination, waypoint, kind): nodes through which a trip is sampled, chosen in the given order and then by id.

    ``costs`` are those of ``roads.through_costs``.  kind k takes the first node whose way over it lies from the ratio before (100 percent at first) to ratios[k]
    of the direct way; the next kind the first one beyond the last ratio; the last kind fills up to ``count`` with the
    first nodes of all.  A node is taken once, under its first kind; of more than ``count`` the first kinds stay.
    """
    if count < 1 or not ratios or ratios[0] < 100 or any(a >= b for a, b in zip(ratios, ratios[1:], strict=False)):
        raise ValueError("ratios rise from 100 percent, and one waypoint is the least")
    between = costs.where("node <> origin AND node <> destination").withColumn("order", order)
    low = [100, *ratios]
    inside = [(F.col("through") * 100 >= F.col("direct") * a) & (F.col("through") * 100 <= F.col("direct") * b) for a, b in zip(low, low[1:], strict=False)]
    kinds = [*inside, F.col("through") * 100 > F.col("direct") * ratios[-1]]
    trip = ["origin", "destination"]
    firsts = [F.min(F.when(kind, F.struct("order", "node"))).alias(f"k{k}") for k, kind in enumerate(kinds)]
    best = between.groupBy(*trip).agg(*firsts)
    named = best.select(*trip, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"k{k}.node").alias("waypoint")) for k in range(len(kinds))])).alias("w")).select(*trip, "w.kind", "w.waypoint").where("waypoint IS NOT NULL")
    # the window keeps no more than ``count`` rows of a trip in each task before it shuffles
    place = F.row_number().over(Window.partitionBy(*trip).orderBy("order", "node"))
    rest = between.withColumn("place", place).where(F.col("place") <= count).select(*trip, F.lit(len(kinds)).alias("kind"), F.col("node").alias("waypoint"))
    once = named.unionByName(rest).groupBy(*trip, "waypoint").agg(F.min("kind").alias("kind"))
    ranked = once.join(between.select(*trip, F.col("node").alias("waypoint"), "order"), [*trip, "waypoint"])
    turn = F.row_number().over(Window.partitionBy(*trip).orderBy("kind", "order", "waypoint"))
    return ranked.withColumn("turn", turn).where(F.col("turn") <= count).select(*trip, "waypoint", "kind")


def chains(trees: DataFrame, ends: DataFrame) -> DataFrame:
    """(root, node, step, at): the nodes ``at`` from each of ``ends`` (root, node) up its tree (root, node, parent), step 0 being the node itself.

    Rounds double what is known of a chain, so they grow with the logarithm of its length.
    """
    jump = checkpointed(trees.where("parent IS NOT NULL").select("root", "node", F.col("parent").alias("to")))
    found = checkpointed(ends.select("root", "node").distinct().withColumns({"step": F.lit(0).cast("long"), "at": F.col("node")}))
    length = 1
    while not jump.isEmpty():
        on = jump.select("root", F.col("node").alias("at"), "to")
        further = found.join(on, ["root", "at"]).select("root", "node", (F.col("step") + length).alias("step"), F.col("to").alias("at"))
        after = stored(found.unionByName(further))
        twice = jump.select("root", F.col("node").alias("to"), F.col("to").alias("over"))
        jump = stored(jump.join(twice, ["root", "to"]).select("root", "node", F.col("over").alias("to")))
        found, length = after, length * 2
    return found


def walks(points: DataFrame, ahead: DataFrame, behind: DataFrame) -> DataFrame:
    """(origin, destination, waypoint, step, node): the fastest way from the origin to each waypoint and on to the destination.

    ``ahead`` (origin, node, parent) and ``behind`` (destination, node, parent) are trees from the origins and, along reversed edges,
    from the destinations.
    """
    up = chains(ahead.withColumnRenamed("origin", "root"), points.select(F.col("origin").alias("root"), F.col("waypoint").alias("node")))
    down = chains(behind.withColumnRenamed("destination", "root"), points.select(F.col("destination").alias("root"), F.col("waypoint").alias("node")))
    named = lambda rows, end: rows.select(F.col("root").alias(end), F.col("node").alias("waypoint"), "step", F.col("at").alias("node"))
    first = points.join(named(up, "origin"), ["origin", "waypoint"]).select("origin", "destination", "waypoint", (-F.col("step")).alias("step"), "node")
    last = points.join(named(down, "destination").where("step > 0"), ["destination", "waypoint"]).select("origin", "destination", "waypoint", "step", "node")
    whole = first.unionByName(last)
    start = whole.groupBy("origin", "destination", "waypoint").agg(F.min("step").alias("_start"))
    return whole.join(start, ["origin", "destination", "waypoint"]).select("origin", "destination", "waypoint", (F.col("step") - F.col("_start")).alias("step"), "node")


def walk_faults(walked: DataFrame, edges: DataFrame, inside: DataFrame, crossed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(origin, destination, waypoint, ratio, fault, n): walks that ends, edges or envelopes don't bear out, with the number of places.

    ``inside`` (origin, destination, ratio, node) and ``crossed`` (origin, destination, ratio, source, target) are envelopes and
    ``budgets`` (origin, destination, ratio, budget) theirs.  fault: 'end' and 'edge' for any walk (ratio is null), 'node' and 'crossing' for what an envelope lacks
    of a walk within its budget.
    """
    walk = ["origin", "destination", "waypoint"]
    joined = walked.withColumnsRenamed({"step": "_step", "node": "target"}).withColumn("step", F.col("_step") - 1)
    steps = walked.withColumnRenamed("node", "source").join(joined, [*walk, "step"]).join(edges.groupBy("source", "target").agg(F.min("time_s").alias("time_s")), ["source", "target"], "left")
    steps = checkpointed(steps.select(*walk, "step", "source", "target", "time_s"))
    ends = walked.groupBy(*walk).agg(F.min_by("node", "step").alias("a"), F.max_by("node", "step").alias("b"), F.bool_or(F.col("node") == F.col("waypoint")).alias("over"))
    nothing = F.lit(None).cast("int").alias("ratio")
    found = [ends.where("a <> origin OR b <> destination OR NOT over").select(*walk, nothing, F.lit("end").alias("fault"))]
    found.append(steps.where("time_s IS NULL").select(*walk, nothing, F.lit("edge").alias("fault")))
    cost = steps.groupBy(*walk).agg(F.sum("time_s").alias("cost"), F.count_if(F.col("time_s").isNull()).alias("gaps")).where("gaps = 0")
    within = cost.join(budgets, ["origin", "destination"]).where("cost <= budget").select(*walk, "ratio")
    missing = lambda rows, held, keys, name: rows.join(within, walk).join(held, ["origin", "destination", "ratio", *keys], "left_anti").select(*walk, "ratio", F.lit(name).alias("fault"))
    found.append(missing(walked.select(*walk, "node").distinct(), inside, ["node"], "node"))
    found.append(missing(steps.select(*walk, "source", "target").distinct(), crossed, ["source", "target"], "crossing"))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy(*walk, "ratio", "fault").agg(F.count(F.lit(1)).alias("n"))
