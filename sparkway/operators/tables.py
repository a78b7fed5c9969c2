"""Relational operators with stated contracts: validated joins, grids, dense ids, checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tables of more bytes, as shuffled, aren't sent to all tasks unasked.
SENT_BYTES = 1 << 20
#: Bytes in memory that a byte of a file counts as, when Spark guesses what a table takes: sorted numbers pack tightly.
UNPACKED = 8


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to spark.checkpoint.dir, lineage cut; a temporary folder where none is set and all runs in one process."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the checkpoint folder and read again, for tables that a loop makes from those of its last round.

    A checkpoint keeps the size that Spark guessed, a product of its inputs' sizes for a join, so that in a loop its digits may double every round
    until planning takes all time and memory of the driver; files have their own size.
    """
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sparkway-checkpoint-"))
    return context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")


def small_broadcasts(spark: SparkSession) -> None:
    """Lowers the session's threshold for broadcasts to SENT_BYTES, also where none is set, and counts bytes of files as UNPACKED times as many.

    Spark compares compressed bytes with it; ten megabytes of sorted numbers are over a million rows, whose hash table takes the driver hundreds of megabytes.
    """
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        # get() with a default of None gives None for a setting that only has Spark's own default
        held = spark.conf.get(name) if name == "spark.sql.autoBroadcastJoinThreshold" else spark.conf.get(name, None)
        if held is None:
            continue
        number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)b?", str(held).strip().lower()).groups()
        if int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}[unit] > SENT_BYTES:
            spark.conf.set(name, str(SENT_BYTES))
    factor = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(factor)) < UNPACKED:
        spark.conf.set(factor, str(float(UNPACKED)))


def must_be_empty(violations: DataFrame, what: str) -> None:
    """Raises ValueError with a few examples if a check found rows."""
    found = violations.limit(5).collect()
    if found:
        raise ValueError(f"{what}: {found}")


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def one_to_one(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join that refuses repeated keys on either side."""
    must_be_empty(repeated(left, *keys), "repeated keys on the left")
    must_be_empty(repeated(right, *keys), "repeated keys on the right")
    return left.join(right, list(keys))


def completed(grid: DataFrame, rows: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """Every slot of the grid, with defaults where no row reported."""
    joined = grid.join(rows, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def conflicts(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """Keys whose rows disagree: an upsert of equal rows is fine, of different ones is not."""
    return rows.groupBy(key).agg(F.count_distinct(F.struct(*values)).alias("versions"), F.count(F.lit(1)).alias("rows")).where("versions > 1")


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group; the order has to be total."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def dense_ids(keys: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """(key, id): 0-based ids of the distinct keys in their order, without a single-task window.

    Keys are dealt into ranges, numbered inside each, and every range starts where those before it end.
    """
    n = parts or int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(keys.select(key).distinct().repartitionByRange(n, key).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each range
    starts, at = {}, 0
    for part in sorted(sizes):
        starts[part], at = at, at + sizes[part]
    base = F.coalesce(*[F.when(F.col("_part") == p, F.lit(s)) for p, s in starts.items()], F.lit(0)).cast("long")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return dealt.select(key, (base + inside).cast("long").alias("id"))


def identity_faults(given: DataFrame, key: str = "key", id_col: str = "id") -> DataFrame:
    """(key, id, place) of keys whose id isn't their 0-based place in sorted order; null ids count."""
    places = dense_ids(given, key).withColumnRenamed("id", "place")
    return given.join(places, key).where(~F.col(id_col).eqNullSafe(F.col("place"))).select(key, id_col, "place")
