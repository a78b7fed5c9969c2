"""Joins and copies whose largest group is many tasks' work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_SENT

#: A key with over one in so many rows is hot: there are fewer hot keys than that.
HOT_SHARE = 1000
#: Bytes of keys that are sent to every task at most.
MOST_BYTES = 64 << 20
#: Copies of a row that one task makes at once.
RUN = 65_536


def with_facts(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the columns of ``facts``, one row for each ``key`` of ``rows`` (null too), ``count`` saying how many rows it has.

    A small table of facts is sent to all tasks.  Of a larger one only the hot keys are, of which there are fewer than
    HOT_SHARE, and the rest is shuffled.  Both should be cheap to read again.
    """
    named = facts.withColumnRenamed(key, "_key")
    same = F.col(key).eqNullSafe(F.col("_key"))
    total = facts.agg(F.count(F.lit(1)).alias("n"), F.sum(count).alias("rows"), F.sum(F.length(F.col(key).cast("string"))).alias("letters")).first()
    if total["n"] <= MOST_SENT and (total["letters"] or 0) * 4 <= MOST_BYTES:
        return rows.join(F.broadcast(named), same).drop("_key")
    is_hot = F.col(count) * HOT_SHARE > total["rows"]
    hot = named.where(is_hot)
    cold = rows.join(F.broadcast(hot.select(F.col("_key").alias("_hot"))), F.col(key).eqNullSafe(F.col("_hot")), "left_anti")
    return rows.join(F.broadcast(hot), same).unionByName(cold.join(named.where(~is_hot), same)).drop("_key")


def copied(rows: DataFrame, n: str, name: str) -> DataFrame:
    """Every row ``n`` times, numbered from 0 in column ``name``; the copies of one row are dealt over tasks, RUN each."""
    numbers = lambda first, end: F.explode(F.sequence(first, end - 1))
    zero = F.lit(0).cast("long")
    few = rows.where(F.col(n) <= RUN).withColumn(name, numbers(zero, F.col(n).cast("long")))
    runs = rows.where(F.col(n) > RUN).withColumn("_run", F.explode(F.sequence(zero, F.col(n).cast("long") - 1, F.lit(RUN).cast("long"))))
    many = runs.repartition(F.col("_run"), F.xxhash64(*rows.columns)).withColumn(name, numbers(F.col("_run"), F.least(F.col("_run") + RUN, n)))
    return few.unionByName(many.drop("_run"))
