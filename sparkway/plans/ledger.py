"""Ordered replay of trip ledgers: energy, time, service, feasibility.

A trip's steps are folded in order of ``seq`` with ``aggregate`` over its collected steps: a trip is one
plan, bounded by its number of stops.  Step kinds: D drive (amount: energy and time), C charge (amount; up
to the capacity, strictly more than nothing), S service (once, before its closing time), N nothing.
A step that is not possible stops the trip there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replay(steps: DataFrame, *, capacity: int = 60, initial: int = 40, floor: int = 5, overhead: int = 2, opens: int = 100, closes: int = 400, service: int = 10) -> DataFrame:
    """(trip, steps_done, energy, time, charged, served, feasible) after each trip's last possible step.

    charged = energy + driven - initial holds for every trip (see ``energy_violations``).
    """
    ordered = steps.groupBy("trip").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "amount"))).alias("steps"))
    start = f"named_struct('n', 0L, 'energy', {initial}L, 'time', 0L, 'charged', 0L, 'driven', 0L, 'served', false, 'ok', true)"
    after = f"""
      CASE WHEN NOT s.ok THEN s
        WHEN x.kind = 'D' AND s.energy - x.amount >= {floor} THEN named_struct('n', s.n + 1, 'energy', s.energy - x.amount, 'time', s.time + x.amount, 'charged', s.charged, 'driven', s.driven + x.amount, 'served', s.served, 'ok', true)
        WHEN x.kind = 'D' THEN named_struct('n', s.n, 'energy', s.energy, 'time', s.time, 'charged', s.charged, 'driven', s.driven, 'served', s.served, 'ok', false)
        WHEN x.kind = 'C' AND s.energy < {capacity} THEN named_struct('n', s.n + 1, 'energy', least({capacity}L, s.energy + x.amount), 'time', s.time + {overhead} + least({capacity}L, s.energy + x.amount) - s.energy, 'charged', s.charged + least({capacity}L, s.energy + x.amount) - s.energy, 'driven', s.driven, 'served', s.served, 'ok', true)
        WHEN x.kind = 'S' AND NOT s.served AND s.time <= {closes} - {overhead} THEN named_struct('n', s.n + 1, 'energy', s.energy, 'time', greatest({opens}L + {service}, s.time + {overhead} + {service}), 'charged', s.charged, 'driven', s.driven, 'served', true, 'ok', true)
        ELSE named_struct('n', s.n + 1, 'energy', s.energy, 'time', s.time, 'charged', s.charged, 'driven', s.driven, 'served', s.served, 'ok', true) END"""
    end = F.expr(f"aggregate(steps, {start}, (s, x) -> {after})")
    done = ordered.select("trip", end.alias("s"))
    return done.select("trip", F.col("s.n").alias("steps_done"), "s.energy", "s.time", "s.charged", "s.driven", "s.served", F.col("s.ok").alias("feasible"))


def energy_violations(replayed: DataFrame, initial: int = 40) -> DataFrame:
    """Trips whose ledger does not balance; there must be none."""
    return replayed.where(F.col("energy") != initial + F.col("charged") - F.col("driven"))
