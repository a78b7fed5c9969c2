"""Selections with a total order: one of each class, round robin over pools, fallbacks, first gate, lockstep comparison."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_of_each(rows: DataFrame, keys: list[str], kind: str, order: list[str], most: int) -> DataFrame:
    """The first row of each ``kind`` in ``order``, then the others in order, until a group has ``most``; place counts from 1."""
    later = F.row_number().over(Window.partitionBy(*keys, kind).orderBy(*order)) > 1
    marked = rows.withColumn("_later", later)
    return marked.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("_later", *order))).where(F.col("place") <= most).drop("_later")


def best_per_anchor(sites: DataFrame, keys: list[str]) -> DataFrame:
    """One site for each anchor: sites of two effects first, then charging, then service; of equals the smallest id.

    sites: keys, site, anchor, effects (C, S), and more; only the smallest of a group is kept while rows are combined.
    """
    both = F.array_contains("effects", "C") & F.array_contains("effects", "S")
    preference = F.when(both, 0).when(F.array_contains("effects", "C"), 1).otherwise(2)
    rest = [c for c in sites.columns if c not in (*keys, "anchor", "site")]
    best = F.min(F.struct(preference.alias("_p"), "site", *rest)).alias("b")
    return sites.where(F.size("effects") > 0).groupBy(*keys, "anchor").agg(best).select(*keys, "anchor", "b.site", *[f"b.{c}" for c in rest])


def round_robin(sites: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, place, site): sites dealt in turns from pools, one pool for each stratum and effect, none twice.

    Pools are ordered by stratum, then C before S, their sites by (detour, site).  ``most`` sites are
    chosen at most, and a pool skips at most as many that others took, so the first 2 x most of each pool decide: only these
    reach the task of a group.
    """
    pooled = sites.withColumn("effect", F.explode("effects")).where("effect IN ('C', 'S')")
    place = F.row_number().over(Window.partitionBy(*keys, "stratum", "effect").orderBy("detour", "site"))
    heads = pooled.withColumn("rank", place).where(F.col("rank") <= 2 * most).select(*keys, "stratum", "effect", "rank", "site")
    types = ", ".join(f"{c} {t}" for c, t in sites.select(*keys).dtypes)

    def deal(key: tuple, table: pa.Table) -> pa.Table:
        pools: dict[tuple, list] = {}
        for row in sorted(table.to_pylist(), key=lambda r: (r["stratum"], r["effect"], r["rank"])):
            pools.setdefault((row["stratum"], row["effect"]), []).append(row["site"])
        waiting = [iter(p) for _, p in sorted(pools.items())]
        chosen: dict = {}
        while waiting and len(chosen) < most:
            going = []
            for pool in waiting:
                site = next((s for s in pool if s not in chosen), None)
                if site is not None and len(chosen) < most:
                    chosen[site] = len(chosen) + 1
                    going.append(pool)
            waiting = going
        given = {c: pa.array([k.as_py()] * len(chosen), k.type) for c, k in zip(keys, key, strict=True)}
        return pa.table(given | {"place": pa.array(chosen.values(), pa.int32()), "site": pa.array(chosen.keys(), pa.int64())})

    return heads.groupBy(*keys).applyInArrow(deal, f"{types}, place int, site long")


class DomainUnavailable(ValueError):
    """Groups that hold fewer sites than were asked for; ``short`` lists a few with what they have."""

    def __init__(self, scenario: str, requested: int, short: list):
        super().__init__(f"domain unavailable: scenario {scenario}, {requested} sites requested, but {short}")
        self.scenario, self.requested, self.short = scenario, requested, short


def domain_rows(groups: DataFrame, sites: DataFrame, keys: list[str], count: int, scenario: str, require_full: bool = True) -> DataFrame:
    """The first ``count`` sites (keys, place, site, effects) of every group of a scenario, by place.

    'energy_only' takes charging sites alone, 'schedule' all.  A group of ``groups`` that has fewer raises DomainUnavailable before anything else runs;
    without ``require_full`` what there is comes back, as it is.
    """
    if count < 0 or scenario not in ("energy_only", "schedule"):
        raise ValueError("count must not be negative, and the scenario energy_only or schedule")
    rows = sites.where(F.array_contains("effects", "C")) if scenario == "energy_only" else sites
    first = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("place", "site"))).where(F.col("_rank") <= count).drop("_rank")
    if require_full:
        held = groups.select(*keys).distinct().join(first.groupBy(*keys).agg(F.count(F.lit(1)).alias("available")), keys, "left").na.fill(0, ["available"])
        short = held.where(F.col("available") < count).orderBy(*keys).limit(5).collect()
        if short:
            raise DomainUnavailable(scenario, count, [tuple(r) for r in short])
    return first.join(groups.select(*keys).distinct(), keys, "left_semi")


def with_fallback(rows: DataFrame, candidates: DataFrame, levels: list[tuple[str, list[str]]], value: str) -> DataFrame:
    """Rows with the smallest ``value`` of the first level that has one, and that level's name (null: none has).

    A level names the columns in which row and candidate agree; no columns mean all candidates.
    """
    out = rows
    for k, (_, on) in enumerate(levels):
        least = candidates.groupBy(*on).agg(F.min(value).alias(f"_v{k}"))
        out = out.join(least, on, "left") if on else out.join(F.broadcast(least), F.lit(True), "left")  # one row
    first = F.coalesce(*[F.when(F.col(f"_v{k}").isNotNull(), F.struct(F.lit(name).alias("level"), F.col(f"_v{k}").alias(value))) for k, (name, _) in enumerate(levels)])
    return out.withColumn("_first", first).select(*rows.columns, "_first.level", f"_first.{value}")


def first_gate(gates: dict[str, Column], otherwise: str) -> Column:
    """The name of the first condition that holds."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in gates.items()], F.lit(otherwise))


def lockstep(left: DataFrame, right: DataFrame, ordinal: str) -> DataFrame:
    """(ordinal, fault): rows of equal ordinal that differ in a column, or that one side lacks ('missing' on the right, 'extra' on the left)."""
    values = [c for c in left.columns if c != ordinal]
    side = lambda frame, name: frame.select(ordinal, F.struct(*values).alias(name))
    both = side(left, "_l").join(side(right, "_r"), ordinal, "full_outer")
    fault = F.when(F.col("_l").isNull(), "extra").when(F.col("_r").isNull(), "missing").when(~F.col("_l").eqNullSafe(F.col("_r")), "differs")
    return both.select(ordinal, fault.alias("fault")).where("fault IS NOT NULL")
