"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``virtual_nodes`` points of the ring; a key belongs to the first point
clockwise.  Every shard has a quota of rows: all shards together hold exactly the table, and two
quotas differ by one at most.  A key whose shard is full goes on clockwise to the next shard
with room, so counts are balanced by construction and only overflowing keys leave their home.

What follows a ring position is the same for all keys of one arc (between two points), so
placement is decided for arcs, not rows: rows are counted by (arc, slice), the driver
walks the overflow clockwise over that table, whose size depends on parameters alone, and every row
finds its shard from its rank inside its (arc, slice).  Slices deal the rows of one arc over
several tasks, also those of one doc_id when their texts differ.  Slice and rank follow from what is in a row, so a
row's shard doesn't depend on how the table is read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, documents

RING_BITS = 48
RUN = 65_536


def ring_points(shards: int, virtual_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions on the ring and the shard that owns each."""
    made = {}
    for shard in range(shards):
        for k in range(virtual_nodes):
            digest = hashlib.blake2b(f"{shard}:{k}".encode(), digest_size=8).digest()
            at = int.from_bytes(digest, "big") >> (64 - RING_BITS)
            made[at] = min(shard, made.get(at, shard))
    positions = np.array(sorted(made), np.int64)
    return positions, np.array([made[p] for p in positions.tolist()], np.int64)


def quotas(rows: int, shards: int) -> np.ndarray:
    """Rows each shard may hold: the whole table, two shards at most one apart."""
    return rows // shards + (np.arange(shards) < rows % shards).astype(np.int64)


def place(counts: np.ndarray, owners: np.ndarray, quota: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(arc, slice, from rank, shard, slot of that rank, hops) for rows counted by [arc, slice].

    Round by round: what is left of every arc asks the next shard clockwise; shards with room take
    arcs in ring order.  A round walks one point further, so all rows are placed once every
    shard has been passed.
    """
    arcs = len(owners)
    left = counts.sum(axis=1).astype(np.int64)
    room, slot = quota.astype(np.int64).copy(), np.zeros(len(quota), np.int64)
    taken: list[list[tuple[int, int, int, int]]] = [[] for _ in range(arcs)]
    hops = 0
    while left.any():
        asked = np.roll(owners, -hops)
        waiting = np.flatnonzero(left)
        for shard in np.unique(asked[waiting]).tolist():
            if not room[shard]:
                continue
            mine = waiting[asked[waiting] == shard]
            ends = np.minimum(np.cumsum(left[mine]), room[shard])
            takes = np.diff(np.concatenate(([0], ends)))
            for arc, n in zip(mine[takes > 0].tolist(), takes[takes > 0].tolist(), strict=True):
                taken[arc].append((n, shard, int(slot[shard]), hops))
                slot[shard] += n
                left[arc] -= n
            room[shard] -= ends[-1]
        hops += 1
    rules = []
    for arc in range(arcs):
        slices = [(s, n) for s, n in enumerate(counts[arc].tolist()) if n]
        at = used = 0
        for n, shard, first, hop in taken[arc]:
            while n:
                s, size = slices[at]
                step = min(n, size - used)
                rules.append((arc, s, used, shard, first, hop))
                n, first, used = n - step, first + step, used + step
                if used == size:
                    at, used = at + 1, 0
    return rules


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shards: int = 40, virtual_nodes: int = 128, slices: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, hops) for each row of ``docs``.

    size: UTF-8 bytes of the text plus 16.  slot: place in the shard, gapless from 0.  hops: points
    of the ring passed clockwise until there was room (0: the key's own shard).

    A null text counts as empty (crc32 0).  A null doc_id is a key like any other.  Rows
    with one doc_id share an arc but not a slot.  Ranks inside a slice go by ring position,
    doc_id, checksum and size; rows that are equal in all of these are interchangeable.  Partitions and order of
    ``docs`` change nothing.  An
    empty table gives an empty result; further columns are not read.
    """
    positions, owners = ring_points(shards, virtual_nodes)

    @F.pandas_udf("int")
    def arc_of(ring: pd.Series) -> pd.Series:  # the first point at or after the key; past the last one the ring starts again
        return pd.Series(np.searchsorted(positions, ring.to_numpy()) % len(positions), dtype="int32")

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    ring = F.shiftrightunsigned(F.xxhash64(F.lit("ring"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 64 - RING_BITS)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), ring.alias("ring"), F.pmod(F.xxhash64(F.lit("slice"), id_col, text), F.lit(slices)).cast("int").alias("slice"))
    rows = checkpointed(rows.withColumn("arc", arc_of("ring")))
    counts = np.zeros((len(positions), slices), np.int64)
    for r in rows.groupBy("arc", "slice").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():  # at most arcs x slices rows
        counts[r["arc"], r["slice"]] = r["n"]
    rules = place(counts, owners, quotas(int(counts.sum()), shards))
    table = docs.sparkSession.createDataFrame(rules, "arc int, slice int, from_rank long, to_shard int, first_slot long, hops int")
    by_slice = table.groupBy("arc", "slice").agg(F.array_sort(F.collect_list(F.struct("from_rank", "to_shard", "first_slot", "hops"))).alias("rules"))
    order = Window.partitionBy("arc", "slice").orderBy("ring", "doc_id", "text_crc32", "size")
    equal = rows.groupBy("arc", "slice", "ring", "doc_id", "text_crc32", "size").agg(F.count(F.lit(1)).alias("n"))
    first = equal.withColumn("first", F.sum("n").over(order) - F.col("n"))
    # equal rows are counted before they are shuffled, and given back a run at a time
    runs = first.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN))))
    each = runs.withColumn("at", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + RUN, "n") - 1)))
    ranked = each.withColumn("rank", F.col("first") + F.col("at"))
    # the table of rules has about arcs x slices rows, whatever the size of the input
    ruled = ranked.join(F.broadcast(by_slice), ["arc", "slice"])
    rule = F.element_at(F.filter("rules", lambda r: r["from_rank"] <= F.col("rank")), -1)
    return ruled.withColumn("rule", rule).select(
        "doc_id",
        "size",
        "text_crc32",
        F.col("rule.to_shard").alias("shard"),
        (F.col("rule.first_slot") + F.col("rank") - F.col("rule.from_rank")).alias("slot"),
        F.col("rule.hops").alias("hops"),
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards whose row counts are at most one apart."""
    placed = shard(documents(spark, sf_dir), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hops")
