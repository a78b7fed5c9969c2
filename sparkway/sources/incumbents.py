"""Durable receipts of the best plans so far: checksummed, replaced by key, safe against a batch that is played again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.tables import must_be_empty

#: Fixed value: the form of a receipt.
FORM = "sparkway.incumbent.v1"
RECEIPT = "form string, problem string, turn long, payload string, sha256 string"


def _sum(problem: Column, turn: Column, payload: Column) -> Column:
    """Checksum over lengths and texts, so that no two receipts are written alike."""
    parts = [F.lit(FORM), problem, turn.cast("string"), payload]
    return F.sha2(F.concat(*[x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)]), 256)


def sealed(rows: DataFrame) -> DataFrame:
    """Receipts of rows (problem, turn, payload); a problem, turn or payload that is missing is an error."""
    must_be_empty(rows.where("problem IS NULL OR problem = '' OR turn IS NULL OR payload IS NULL").select("problem", "turn"), "receipts take a problem, a turn and a payload")
    return rows.select(F.lit(FORM).alias("form"), "problem", F.col("turn").cast("long").alias("turn"), "payload", _sum(F.col("problem"), F.col("turn").cast("long"), F.col("payload")).alias("sha256"))


def save_batch(path: str):
    """A function for foreachBatch: a batch owns its folder, so playing it again replaces it by itself."""

    def save(rows: DataFrame, batch: int) -> None:
        # of a problem's receipts in one batch the last turn is kept, and of that the smallest payload
        last = rows.groupBy("problem").agg(F.min(F.struct((-F.col("turn")).alias("t"), "payload")).alias("r")).select("problem", (-F.col("r.t")).alias("turn"), "r.payload")
        sealed(last).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={batch}")

    return save


def sink(rows: DataFrame, path: str, state: str) -> DataStreamWriter:
    """A writer of a stream of (problem, turn, payload) into receipts at ``path``; ``state`` is the stream's checkpoint."""
    return rows.writeStream.foreachBatch(save_batch(path)).option("checkpointLocation", state)


def load(spark: SparkSession, path: str, problems: DataFrame | None = None) -> DataFrame:
    """(problem, turn, payload): the last receipt of each problem; receipts that were changed or have another form are errors.

    With ``problems`` (problem), receipts of others are errors too, and problems without one have no row.
    """
    rows = spark.read.schema(f"{RECEIPT}, batch long").parquet(path)
    must_be_empty(rows.where(~F.col("form").eqNullSafe(FORM)).select("problem", "form"), "receipts of another form")
    must_be_empty(rows.where(~F.col("sha256").eqNullSafe(_sum(F.col("problem"), F.col("turn"), F.col("payload")))).select("problem", "turn"), "receipts that don't bear their checksum")
    if problems is not None:
        must_be_empty(rows.join(problems.select("problem"), "problem", "left_anti").select("problem"), "receipts of other problems")
    best = rows.groupBy("problem").agg(F.max(F.struct("turn", "batch", "payload")).alias("r"))
    return best.select("problem", "r.turn", "r.payload")
