"""Road and site policies as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Drivable road classes with their free-flow speed in km/h.
CLASS_SPEED = {
    "motorway": 110, "motorway_link": 50, "trunk": 90, "trunk_link": 45, "primary": 70, "primary_link": 40, "secondary": 60, "secondary_link": 35,
    "tertiary": 50, "tertiary_link": 30, "unclassified": 40, "residential": 30, "living_street": 10, "service": 15, "road": 20,
}
# Classes that are known and never driven on.
EXCLUDED_CLASSES = ("busway", "bus_guideway", "escape", "rest_area", "services", "via_ferrata", "bus_stop", "emergency_bay", "ladder", "street_lamp")
# Posted speeds by name, in km/h.
SYMBOLIC_SPEED = {"SI:urban": 50, "SI:rural": 90, "SI:motorway": 130, "SI:trunk": 110, "walk": 5}
# Access tags from the most to the least specific, values that allow driving, one-way values by direction.
ACCESS_TAGS = ("motorcar", "motor_vehicle", "vehicle", "access")
ALLOWED_ACCESS = ("yes", "permissive", "designated", "official")
FORWARD, BACKWARD, BOTH = ("yes", "true", "1"), ("-1", "reverse"), ("no", "false", "0")
MPH = 1.609344
LEAST_SPEED, MOST_SPEED = 1.0, 140.0


def tag(value: Column) -> Column:
    """A tag without white space around it; an empty one is none."""
    return F.nullif(F.trim(value), F.lit(""))


def known_class(road_class: Column) -> Column:
    """The class itself; one that has neither a speed nor an exclusion is an error, not a drop."""
    wrong = F.raise_error(F.concat(F.lit("unknown road class: "), F.coalesce(road_class, F.lit("null")))).cast("string")
    return F.when(road_class.isin(*CLASS_SPEED, *EXCLUDED_CLASSES), road_class).otherwise(wrong)


def effective_oneway(ranked: list[Column], junction: Column, road_class: Column) -> Column:
    """The most specific one-way tag; without one, roundabouts and motorways are one-way."""
    untagged = F.when((junction == "roundabout") | (road_class == "motorway"), "yes").otherwise("no")
    return F.coalesce(*ranked, untagged)


def directions(oneway: Column) -> Column:
    """[1], [-1] or [1, -1]; none for a value that isn't known."""
    one, back, both, none = (F.array(*map(F.lit, d)).cast("array<int>") for d in ((1,), (-1,), (1, -1), ()))
    return F.when(oneway.isin(*FORWARD), one).when(oneway.isin(*BACKWARD), back).when(oneway.isin(*BOTH), both).otherwise(none)


def excluded_reason(road_class: Column, access: Column, conditional_access: Column, conditional_oneway: Column, oneway: Column) -> Column:
    """Why a way isn't driven on, null if it is; of several reasons the last rule that applies."""
    return (
        F.when(F.size(directions(oneway)) == 0, "unsupported_oneway")
        .when(road_class.isin(*EXCLUDED_CLASSES), "highway_class")
        .when(conditional_oneway.isNotNull(), "conditional_oneway")
        .when(conditional_access.isNotNull(), "conditional_access")
        .when(access.isNotNull() & ~access.isin(*ALLOWED_ACCESS), "restricted_or_unknown_access")
    )


def posted_speed(value: Column) -> Column:
    """km/h: a name, or the least of a ;-separated list.  One part that isn't a speed over 0 and up to 300 makes the whole value none."""
    value = tag(value)
    named = F.coalesce(*[F.when(value == name, float(v)) for name, v in SYMBOLIC_SPEED.items()])
    pattern = r"(?i)^([0-9]+(?:\.[0-9]+)?)\s*(mph|km/h|kmh|kph)?$"
    number = lambda s: F.nullif(F.regexp_extract(F.trim(s), pattern, 1), F.lit("")).cast("double")
    speed = lambda s: number(s) * F.when(F.lower(F.regexp_extract(F.trim(s), pattern, 2)) == "mph", MPH).otherwise(1.0)
    parts = F.transform(F.split(value, ";"), speed)
    usable = F.forall(parts, lambda v: v.isNotNull() & (v > 0) & (v <= 300))
    return F.coalesce(named, F.when(usable, F.array_min(parts)))


def effective_speed(road_class: Column, posted: Column, low: float = LEAST_SPEED, high: float = MOST_SPEED) -> Column:
    """The smaller of class and posted speed, kept between two bounds."""
    by_class = F.coalesce(*[F.when(road_class == c, float(v)) for c, v in CLASS_SPEED.items()])
    return F.greatest(F.lit(low), F.least(F.lit(high), by_class, posted))


def shelter_contour(tags: Column, nodes: Column) -> Column:
    """Whether a way with road class 'yes' is in fact the outline of a shelter: a closed ring of nodes that is building and shelter."""
    at = lambda key, value: F.coalesce(F.try_element_at(tags, F.lit(key)) == value, F.lit(False))
    closed = (F.size(nodes) >= 2) & (F.try_element_at(nodes, F.lit(1)) == F.try_element_at(nodes, F.lit(-1)))
    return at("highway", "yes") & at("building", "yes") & at("amenity", "shelter") & F.coalesce(closed, F.lit(False))


def admitted_ways(ways: DataFrame) -> DataFrame:
    """(way_id, direction, excluded_reason, speed, posted): a row for each direction that is driven, one with direction 0 for a way that isn't.

    ways: way_id, road_class, access tags, oneway, oneway_motorcar, oneway_motor_vehicle, junction, conditional_access,
    conditional_oneway, maxspeed, maxspeed_forward, maxspeed_backward; contour (boolean) where it is known, see ``shelter_contour``.
    Road class 'yes' is left out where contour says so, and an error elsewhere.
    """
    kept = ("way_id", "road_class", "contour")
    text = ways.select(*[c for c in kept if c in ways.columns], *[tag(F.col(c)).alias(c) for c in ways.columns if c not in kept])
    contour = F.coalesce((F.col("road_class") == "yes") & F.col("contour"), F.lit(False)) if "contour" in ways.columns else F.lit(False)
    road_class = F.when(contour, F.col("road_class")).otherwise(known_class(F.col("road_class")))
    oneway = effective_oneway([F.col("oneway_motorcar"), F.col("oneway_motor_vehicle"), F.col("oneway")], F.col("junction"), F.col("road_class"))
    judged = text.withColumns({"road_class": road_class, "oneway_used": oneway})
    reason = excluded_reason(F.col("road_class"), F.coalesce(*map(F.col, ACCESS_TAGS)), F.col("conditional_access"), F.col("conditional_oneway"), F.col("oneway_used"))
    judged = judged.withColumn("excluded_reason", F.when(contour, "closed_shelter_contour").otherwise(reason))
    ways_of = F.when(F.col("excluded_reason").isNotNull(), F.array(F.lit(0))).otherwise(directions(F.col("oneway_used")))
    dealt = judged.withColumn("direction", F.explode(ways_of))
    by_direction = F.coalesce(F.when(F.col("direction") == -1, F.col("maxspeed_backward")).otherwise(F.col("maxspeed_forward")), F.col("maxspeed"))
    driven = F.col("direction") != 0
    posted = dealt.withColumn("posted", F.when(driven, posted_speed(by_direction)))
    return posted.select("way_id", "direction", "excluded_reason", F.when(driven, effective_speed(F.col("road_class"), F.col("posted"))).alias("speed"), "posted")


def travel_time(length_m: Column, speed_kmh: Column) -> Column:
    return length_m * 3.6 / speed_kmh


def actions(capabilities: Column) -> Column:
    """C and S as offered, and CS where a site offers both."""
    both = F.array_contains(capabilities, "C") & F.array_contains(capabilities, "S")
    return F.array_sort(F.when(both, F.array_union(capabilities, F.array(F.lit("CS")))).otherwise(capabilities))


def necessary_charges(distance_m: Column, consumption: Column, reserve: Column, initial: Column, usable: Column) -> Column:
    """How often a trip must charge at least: max(0, ceil((c d + reserve - initial) / usable))."""
    return F.greatest(F.lit(0).cast("long"), F.ceil((consumption * distance_m + reserve - initial) / usable).cast("long"))


# Prefixes that say a charger is no longer or not yet there.
LIFECYCLE = ("disused", "abandoned", "demolished", "removed", "proposed", "construction")


def charging_evidence(tags: Column) -> Column:
    """struct(signal, station, point, lifecycle, reasons, eligible) of a map of tags; reasons are gathered, none is needed to be eligible."""
    at = lambda key: F.try_element_at(tags, F.lit(key))
    is_ = lambda key, *values: F.coalesce(at(key).isin(*values), F.lit(False))
    listed = lambda *found: F.filter(F.array(*found), lambda x: x.isNotNull())
    station, point = is_("amenity", "charging_station"), is_("man_made", "charge_point")
    gone = lambda p: is_(f"{p}:amenity", "charging_station") | is_(f"{p}:man_made", "charge_point") | ((station | point) & is_(p, "yes"))
    lifecycle = listed(*[F.when(gone(p), p) for p in LIFECYCLE])
    reasons = listed(
        F.when(~station, "not_a_station_tag"),
        F.when(F.size(lifecycle) > 0, "explicit_lifecycle_exclusion"),
        F.when(is_("access", "private", "no"), "explicit_access_exclusion"),
        F.when(is_("motorcar", "no") | is_("motor_vehicle", "no") | is_("vehicle", "no"), "explicit_vehicle_exclusion"),
        F.when(F.coalesce(at("access:conditional"), F.lit("")) != "", "conditional_access_not_modeled"),
        F.when(is_("charging_station:battery_swapping", "only"), "battery_swapping_only_not_charging"),
        F.when(is_("capacity", "0"), "explicit_zero_vehicle_capacity"),
    )
    signal = station | point | (F.size(lifecycle) > 0) | is_("charging", "yes")
    return F.struct(signal.alias("signal"), station.alias("station"), point.alias("point"), lifecycle.alias("lifecycle"), reasons.alias("reasons"), (F.size(reasons) == 0).alias("eligible"))


def next_actions(actions: DataFrame, scheduled: Column, pending: Column) -> DataFrame:
    """Actions that are legal next: effects with service (S, CS) only where a schedule exists and is pending."""
    return actions.where((F.col("effect") == "C") | (F.coalesce(scheduled, F.lit(False)) & F.coalesce(pending, F.lit(False))))


def chosen_activity(timed: DataFrame, group: str, site: str, *, start: int, overhead: int, penalty: int, opens: int, closes: int, duration: int) -> DataFrame:
    """(group, site) whose activity lets the trip end first, ties to the smaller site; times there and onward, null if unreachable.

    Sites reached after closes - overhead are left out; a group without a site has no row.
    """
    in_time = timed.where(F.col("there").isNotNull() & F.col("onward").isNotNull() & (F.lit(start) + F.col("there") <= closes - overhead))
    ends = F.greatest(F.lit(opens + duration), F.lit(start + overhead + duration) + F.col("there")) + F.col("onward") + penalty
    return in_time.groupBy(group).agg(F.min(F.struct(ends.alias("ends"), F.col(site))).alias("m")).select(group, F.col(f"m.{site}").alias("chosen"))


def activity_masks(actions: DataFrame, chosen: DataFrame, group: str, site: str) -> DataFrame:
    """actions with 'separated' (no CS) and 'activity_first' (C anywhere, service at the chosen site alone)."""
    held = actions.join(chosen, group, "left")
    first = F.coalesce((F.col("effect") == "C") | (F.col(site) == F.col("chosen")), F.lit(False))
    return held.withColumns({"separated": F.col("effect") != "CS", "activity_first": first}).drop("chosen")
