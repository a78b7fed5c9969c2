"""Receipt and region statistics: fixed denominators, censored quantiles, agreement of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import checkpointed


def status_counts(slots: DataFrame) -> DataFrame:
    return slots.groupBy("method", "status").agg(F.count(F.lit(1)).alias("n"))


def threshold_shares(slots: DataFrame, thresholds: list[int], finished: Column, supported: Column) -> DataFrame:
    """Slots finished within each threshold, with both denominators and shares in parts per million (null: none)."""
    within = [F.sum(F.when(finished & (F.col("time_s") <= t), 1).otherwise(0)).alias(f"within_{t}") for t in thresholds]
    made = slots.groupBy("method").agg(F.count(F.lit(1)).alias("n_full"), F.sum(F.when(supported, 1).otherwise(0)).alias("n_supported"), *within)
    share = lambda t, n: F.when(F.col(n) > 0, F.expr(f"(within_{t} * 1000000) div {n}")).alias(f"{n[2:]}_ppm_{t}")
    return made.select("*", *[share(t, n) for t in thresholds for n in ("n_full", "n_supported")])


def running_counts(counted: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``counted`` (with a count n) with one more column: the rows of the same keys up to and with this one, in ``order``.

    Rows are dealt by ranges of keys and order, summed inside each range, and offset by what earlier ranges hold: one row
    for each range and key.  So a key with very many values is spread over tasks.
    """
    dealt = checkpointed(counted.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = dealt.groupBy(*keys, "_range").agg(F.sum("n").alias("_held"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offset = held.select(*keys, "_range", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_before"))
    ranked = dealt.withColumn(name, F.sum("n").over(inside)).join(offset, [*keys, "_range"])
    return ranked.withColumn(name, F.col(name) + F.col("_before")).drop("_before", "_range")


def linear_quantiles(rows: DataFrame, keys: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """(keys, n, q<per mille>): exact quantiles, linear between the two order statistics around (n - 1) q.

    Nulls don't count; keys without a value have no row.  Keys are not null.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_counts(counted, keys, ["v"], "upto").join(counted.groupBy(*keys).agg(F.sum("n").alias("total")), keys)
    at = lambda rank: F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("v")))
    out = []
    for q in quantiles:
        place = (F.col("total") - 1) * F.lit(q)
        low, high = at(F.floor(place)), at(F.ceil(place))
        out.append((low + (high - low) * F.first(place - F.floor(place))).alias(f"q{round(q * 1000)}"))
    return ranked.groupBy(*keys).agg(F.first("total").alias("n"), *out)


def distribution(rows: DataFrame, keys: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """Counts of all, finite and infinite values, quantiles and largest of the finite ones, and whether the worst is infinite.

    Infinite values stay in the counts and never enter a quantile; nulls and NaN are no values.
    """
    v = F.col(value).cast("double")
    some = rows.where(v.isNotNull() & ~F.isnan(v))
    finite = F.abs(v) < float("inf")
    counts = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("evaluations"), F.count(F.when(finite, 1)).alias("finite_evaluations"), F.count(F.when(~finite, 1)).alias("infinite_evaluations"), F.max(F.when(finite, v)).alias("worst_finite"), (F.max(v) == float("inf")).alias("worst_is_infinite"))
    return counts.join(linear_quantiles(some.where(finite), keys, value, quantiles).drop("n"), keys, "left")


def weighted_mean(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Sum of weight x value over sum of weights; null where the weights sum to zero."""
    total = F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
    return rows.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.nullif(total, F.lit(0))).alias("weighted_mean"))


def with_group_sums(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with the sum and number of values of their group (their mean is the quotient); groups are aggregated before they meet their rows."""
    return rows.join(rows.groupBy(*keys).agg(F.sum(value).alias("group_sum"), F.count(value).alias("group_n")), keys)


def censored_quantiles(rows: DataFrame, keys: list[str], value: str, censored: Column, per_mille: list[int]) -> DataFrame:
    """Bounds of order statistics when some values are only known to be at least ``value``.

    The lower bound takes censored values as they are, the upper bound as unbounded (null).  The median
    averages the middle pair; other quantiles q take rank ceil(q n).  Counts of distinct values are
    aggregated first and then ranked by ranges, so no group of values meets in one task.
    """
    counted = checkpointed(rows.groupBy(*keys, F.col(value).cast("long").alias("v"), censored.alias("cut")).agg(F.count(F.lit(1)).alias("n")))
    totals = counted.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("cut"), F.col("n")).otherwise(0)).alias("n_censored"))
    low_first = running_counts(counted, keys, ["v", "cut"], "low_end")
    known_first = running_counts(counted, keys, ["cut", "v"], "high_end").drop("n")
    ranked = low_first.join(known_first, [*keys, "v", "cut"]).join(totals, keys)
    at = lambda end, rank, v: F.min(F.when((F.col(end) >= rank) & (F.col(end) - F.col("n") < rank), v))
    upper = F.when(~F.col("cut"), F.col("v"))
    out = []
    for q in per_mille:
        if q == 500:
            first, second = F.expr("(total + 1) div 2"), F.expr("total div 2 + 1")
            low = (at("low_end", first, F.col("v")) + at("low_end", second, F.col("v"))) * 500
            high = (at("high_end", first, upper) + at("high_end", second, upper)) * 500
        else:
            rank = F.expr(f"(total * {q} + 999) div 1000")
            low, high = at("low_end", rank, F.col("v")) * 1000, at("high_end", rank, upper) * 1000
        out += [low.cast("long").alias(f"low_{q}"), high.cast("long").alias(f"high_{q}")]
    return ranked.groupBy(*keys).agg(F.first("total").alias("total"), F.first("n_censored").alias("n_censored"), *out)


def agreement(labels: DataFrame) -> DataFrame:
    """Adjusted Rand index of two labelings (columns left, right), with its pair counts; null if undefined."""
    pairs = lambda n: F.sum(F.expr(f"{n} * ({n} - 1) div 2"))
    cells = labels.groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"))
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(pairs("n").alias(f"{c}_pairs"))
    one = cells.agg(pairs("n").alias("both_pairs"), F.sum("n").alias("rows"))
    row = one.crossJoin(side("left")).crossJoin(side("right"))  # three tables of one row
    every = F.expr("rows * (rows - 1) / 2")
    # the product of two counts of pairs exceeds a long from some 100,000 rows on
    expected = F.col("left_pairs").cast("double") * F.col("right_pairs").cast("double") / every
    index = (F.col("both_pairs") - expected) / ((F.col("left_pairs") + F.col("right_pairs")) / 2 - expected)
    return row.select("rows", "both_pairs", "left_pairs", "right_pairs", F.round(index, 9).alias("adjusted_rand"))


def stability(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row on how regions (id, region) changed: common, new and removed members, adjusted Rand index of the common ones, mean best overlap, splits and merges.

    overlap: of each old region's common members with the whole of a new region, the best; null without common members, as is the index.
    new_regions hold no common member; an old region is split, and a new one merged, if it meets more than one of the other side.
    """
    cells = checkpointed(before.select("id", F.col("region").alias("left")).join(after.select("id", F.col("region").alias("right")), "id").groupBy("left", "right").agg(F.count(F.lit(1)).alias("n")))
    pairs = lambda n: F.coalesce(F.sum(F.expr(f"{n} * ({n} - 1) / 2")), F.lit(0.0))
    left = cells.groupBy("left").agg(F.sum("n").alias("held"), F.count(F.lit(1)).alias("met"))
    right = cells.groupBy("right").agg(F.sum("n").alias("held"), F.count(F.lit(1)).alias("met"))
    full = after.groupBy(F.col("region").alias("right")).agg(F.count(F.lit(1)).alias("full"))
    overlap = F.col("n") / (F.col("held") + F.col("full") - F.col("n"))
    best = cells.join(left, "left").join(full, "right").groupBy("left").agg(F.max(overlap).alias("best")).agg(F.avg("best").alias("overlap"))
    # tables of one row each
    whole = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("common"), pairs("n").alias("both"))
    for rows, name, more in ((left, "l", "split_regions"), (right, "r", "merged_regions")):
        whole = whole.crossJoin(rows.agg(pairs("held").alias(name), F.count(F.when(F.col("met") > 1, 1)).alias(more), F.count(F.lit(1)).alias(f"{name}_regions")))
    whole = whole.crossJoin(best).crossJoin(before.agg(F.count(F.lit(1)).alias("old"))).crossJoin(after.agg(F.count(F.lit(1)).alias("now"), F.count_distinct("region").alias("regions")))
    every = F.col("common") * (F.col("common") - 1) / 2
    expected = F.when(every > 0, F.col("l") * F.col("r") / every).otherwise(0.0)
    most = (F.col("l") + F.col("r")) / 2
    index = F.when(most != expected, (F.col("both") - expected) / (most - expected)).when(F.col("common") > 0, 1.0)
    return whole.select(
        "common", (F.col("now") - F.col("common")).alias("new_members"), (F.col("old") - F.col("common")).alias("removed_members"), index.alias("adjusted_rand"),
        "overlap", (F.col("regions") - F.col("r_regions")).alias("new_regions"), "split_regions", "merged_regions",
    )


def claim_faults(claims: DataFrame, keys: list[str], complete: tuple[str, ...] = ("attained_optimum", "infeasible")) -> DataFrame:
    """(keys, fault) of receipts (status, key, feasible_key, replayed) that claim what they can't; the first that applies.

    fault: 'claim' (not complete, but a key), 'replay' (a key without an independent replay), 'key' (an optimum without
    its key, or with another one than the feasible key).
    """
    claimed = F.col("key").isNotNull()
    fault = (
        F.when(~F.col("status").isin(*complete) & claimed, "claim")
        .when((claimed | F.col("feasible_key").isNotNull()) & ~F.coalesce("replayed", F.lit(False)), "replay")
        .when((F.col("status") == "attained_optimum") & (~claimed | ~F.col("key").eqNullSafe(F.col("feasible_key"))), "key")
    )
    return claims.select(*keys, fault.alias("fault")).where("fault IS NOT NULL")
