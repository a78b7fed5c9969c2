"""Candidate plans: generation, skylines, covers, regret."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stats import running_counts


def generated(sites: DataFrame, pairs: DataFrame, budget: int) -> DataFrame:
    """(first, second, cost): one-stop plans of sites that offer all, and ordered two-stop plans that do so together.

    ``sites`` has id, cost and mask (1 charging, 2 service); ``pairs`` has a, b and the cost of the way between,
    each unordered pair once.  second is -1 for one stop.  Only plans within the budget.
    """
    single = sites.where("mask = 3").select(F.col("id").alias("first"), F.lit(-1).cast("long").alias("second"), "cost")
    ordered = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "way"))
    first = sites.select(F.col("id").alias("a"), F.col("cost").alias("cost_a"), F.col("mask").alias("mask_a"))
    second = sites.select(F.col("id").alias("b"), F.col("cost").alias("cost_b"), F.col("mask").alias("mask_b"))
    both = ordered.join(first, "a").join(second, "b").where("(mask_a | mask_b) = 3 AND mask_a <> 3 AND mask_b <> 3")
    double = both.select(F.col("a").alias("first"), F.col("b").alias("second"), (F.col("cost_a") + F.col("cost_b") + F.col("way")).alias("cost"))
    return single.unionByName(double).where(F.col("cost") <= budget)


def _undominated(values: np.ndarray, block: int = 256) -> np.ndarray:
    """Places of rows that no other row beats (all at most as large, one smaller); equal rows all stay.

    Rows go by their sum and then column by column, so only earlier ones can beat a row; a block of them is held against the front at once.
    """
    order = np.lexsort((*values.T[::-1], values.sum(axis=1)))
    front = np.zeros((0, values.shape[1]), values.dtype)
    kept = []
    for start in range(0, len(order), block):
        places = order[start : start + block]
        for rivals in (front, values[places]):
            mine = values[places]
            beaten = np.zeros(len(places), bool)
            for first in range(0, len(rivals), 4096):
                some = rivals[first : first + 4096, None, :]
                beaten |= ((some <= mine).all(axis=2) & (some < mine).any(axis=2)).any(axis=0)
            places = places[~beaten]
        kept.append(places)
        front = np.concatenate((front, values[places]))
    return np.sort(np.concatenate(kept)) if kept else np.zeros(0, int)


#: Rows of one share of a group, and shares that are merged at once.
SHARE_ROWS, FAN = 20_000, 8


def skyline(plans: DataFrame, group: str, objectives: list[str], share_rows: int = SHARE_ROWS) -> DataFrame:
    """Plans that no plan of the same group dominates; all objectives are to be small, ties stay.

    Equal plans are counted first.  A group is reduced in shares of about ``share_rows``, and what is left of FAN shares is
    reduced together, until one share holds the front.  So a task holds a share, or the fronts of FAN shares.
    """
    counted = plans.groupBy(group, *objectives).agg(F.count(F.lit(1)).alias("_copies"))
    schema = T.StructType([*plans.select(group, *objectives).schema.fields, T.StructField("_copies", T.LongType()), T.StructField("_share", T.LongType())])

    def reduce(table: pa.Table) -> pa.Table:
        values = np.stack([table.column(c).to_numpy() for c in objectives], axis=1)
        return table.take(pa.array(_undominated(values)))

    largest, total = counted.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    largest, total = largest or 0, total or 0
    shares = 1
    while shares * share_rows < largest:
        shares *= FAN
    rows = counted.withColumn("_share", F.pmod(F.xxhash64(*objectives), F.lit(shares)))
    while True:
        # what a task holds at once doesn't grow with the plans
        dealt = rows.select(*schema.fieldNames()).repartition(max(total // (10 * share_rows), 1 if total < share_rows else 8), group, "_share")
        rows = dealt.groupBy(group, "_share").applyInArrow(reduce, schema)
        if shares == 1:
            break
        shares //= FAN
        rows = rows.withColumn("_share", F.expr(f"_share div {FAN}"))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(group, *objectives)


def random_control(plans: DataFrame, chosen: DataFrame, group: str, objectives: list[str], seed: int) -> DataFrame:
    """As many plans of each group as were chosen of it (all, if there are fewer), without replacement, in an order by hash.

    Equal plans are drawn one by one.  Places come from ranges of the order, so a large group is many tasks' work.
    """
    size = chosen.groupBy(group).agg(F.count(F.lit(1)).alias("_wanted"))
    counted = plans.groupBy(group, *objectives).agg(F.count(F.lit(1)).alias("n"))
    drawn = counted.withColumn("_draw", F.xxhash64(F.lit(seed).cast("long"), *objectives))
    placed = running_counts(drawn, [group], ["_draw", *objectives], "_upto").join(size, group)
    taken = F.least(F.col("n"), F.col("_wanted") - (F.col("_upto") - F.col("n")))
    return placed.withColumn("_taken", taken).where("_taken > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_taken"))).select(group, *objectives)


def weight_family(count: int, objectives: int, seed: int) -> list[tuple[float, ...]]:
    """``count`` weightings, evenly spread over all that sum to one: exponential draws by hash, divided by their sum."""
    out = []
    for k in range(count):
        draws = [int.from_bytes(hashlib.blake2b(f"{seed}:{k}:{c}".encode(), digest_size=6).digest()) for c in range(objectives)]
        parts = [-math.log((d + 0.5) / (1 << 48)) for d in draws]
        out.append(tuple(p / sum(parts) for p in parts))
    return out


def cover(plans: DataFrame, group: str, objectives: list[str], tolerance: tuple) -> DataFrame:
    """A greedy cover of each group's skyline: plans and ``covered_by``, the rank of the chosen plan within tolerance.

    In lexicographic order a plan is covered by the first chosen plan that exceeds it in no objective by more than that
    objective's tolerance; if there is none it is chosen.  The greedy order is sequential inside a group.
    """
    if len(tolerance) != len(objectives) or any(t < 0 for t in tolerance):
        raise ValueError("every objective takes a tolerance that isn't negative")
    base = plans.select(group, *objectives)
    schema = T.StructType([*base.schema.fields, T.StructField("rank", T.LongType()), T.StructField("covered_by", T.LongType())])

    def greedy(table: pa.Table) -> pa.Table:
        values = np.stack([table.column(c).to_numpy() for c in objectives], axis=1)
        order = np.lexsort(values.T[::-1])
        values = values[order]
        chosen: list[int] = []
        fronts = np.empty_like(values)
        by = []
        for i, v in enumerate(values):
            fits = np.flatnonzero(np.all(fronts[: len(chosen)] <= v + np.array(tolerance), axis=1))
            if not len(fits):
                fronts[len(chosen)] = v
                chosen.append(i)
            by.append(chosen[fits[0]] if len(fits) else i)
        out = table.take(pa.array(order)).select([group, *objectives])
        return out.append_column("rank", pa.array(range(len(by)), pa.int64())).append_column("covered_by", pa.array(by, pa.int64()))

    return base.groupBy(group).applyInArrow(greedy, schema)


def regret(flat: DataFrame, chosen: DataFrame, utilities: DataFrame, group: str, objectives: list[str]) -> DataFrame:
    """(group, utility, best, best_chosen, regret): what is lost by keeping only the chosen plans.

    ``utilities`` has utility and one weight w_<objective> each; it is a parameter table.  No flat plan: no row; no
    chosen plan: regret is null.
    """
    weighted = sum(F.col(c) * F.col(f"w_{c}") for c in objectives)

    def least(plans: DataFrame, name: str) -> DataFrame:
        # each plan meets every utility once: the parameter table is small by contract
        return plans.join(F.broadcast(utilities)).groupBy(group, "utility").agg(F.min(weighted).alias(name))

    joined = least(flat, "best").join(least(chosen, "best_chosen"), [group, "utility"], "left")
    return joined.withColumn("regret", F.col("best_chosen") - F.col("best"))


def relative_regret(flat: DataFrame, chosen: DataFrame, weights: list[tuple], group: str, objectives: list[str], scales: tuple, eta: float) -> DataFrame:
    """(group, utility, best, regret, relative) over objectives divided by their scales and weights that sum to one.

    relative = regret / (|best| + eta).  A group without flat plans has no row; without chosen plans both are infinite.
    """
    if eta <= 0 or any(s <= 0 for s in scales) or any(x <= 0 for w in weights for x in w):
        raise ValueError("scales, weights and eta must be positive")
    scores = [sum(F.col(c) / float(s) * x / sum(w) for c, s, x in zip(objectives, scales, w, strict=True)) for w in weights]

    def least(plans: DataFrame, name: str) -> DataFrame:
        best = plans.groupBy(group).agg(*[F.min(score).alias(f"u{k}") for k, score in enumerate(scores)])
        return best.select(group, F.posexplode(F.array(*[f"u{k}" for k in range(len(scores))])).alias("utility", name))

    joined = least(flat, "best").join(least(chosen, "kept"), [group, "utility"], "left")
    lost = F.when(F.col("kept").isNull(), float("inf")).otherwise(F.greatest(F.lit(0.0), F.col("kept") - F.col("best")))
    return joined.select(group, "utility", "best", lost.alias("regret"), (lost / (F.abs("best") + eta)).alias("relative"))


def cover_faults(covered: DataFrame, group: str, objectives: list[str], tolerance: tuple) -> DataFrame:
    """Plans of a cover whose chosen plan exceeds them by more than the tolerance somewhere, or is missing."""
    chosen = covered.where("rank = covered_by").select(group, F.col("rank").alias("covered_by"), *[F.col(c).alias(f"_{c}") for c in objectives])
    held = covered.join(chosen, [group, "covered_by"], "left")
    within = F.lit(True)
    for c, t in zip(objectives, tolerance, strict=True):
        within = within & (F.col(f"_{c}") <= F.col(c) + t)
    return held.where(~F.coalesce(within, F.lit(False))).select(group, "rank", "covered_by")
