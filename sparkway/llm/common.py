"""What the training-data operators share: sizes, checkpoints, word splitting, packed exchanges.

The packed exchange
-------------------
Several operators need, for every word window of the corpus, one corpus-wide fact
(smallest owner, counts).  One shuffled row per window would cost far more than the
text itself, so windows travel packed:

* documents are dealt by ``block_of`` into *blocks* of a few MB of text;
* a block sends, for every *bucket* (a range of the hash), one row with its sorted
  distinct hashes and what it knows about them (map-side combine);
* a bucket merges the rows of all blocks and answers each block in the order of
  the request, so that the answer carries no keys.

A hash that occurs in a third of all documents reaches its bucket once per block,
never once per document.
"""

from __future__ import annotations

import math
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table; from here on the session's Arrow batches are small."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows and bytes that are handed to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows, so that a worker holds a few MB of texts and not 10,000 of them.

    It stays so for the session, as results are computed after a query has returned.
    """
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    for name, most in limits.items():
        now = spark.conf.get(name).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where none is set and all runs in one process (tests, a laptop)."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sparkway-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: A table of keys of at most so many rows is sent to every task; a larger one is shuffled.
MOST_SENT = 300_000


def joined(frame: DataFrame, keys: DataFrame, on, how: str) -> DataFrame:
    """``frame`` joined with a small table of keys, so that wide rows stay where they lie while the table is small enough."""
    few = keys.limit(MOST_SENT + 1).count() <= MOST_SENT
    return frame.join(F.broadcast(keys) if few else keys, on, how)


def text_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(rows, UTF-8 bytes of text) of a table, in one narrow aggregate."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_col)).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def power_of_two(x: float) -> int:
    """The smallest power of two that is at least x (1 at least)."""
    return 1 << max(0, math.ceil(math.log2(max(1.0, x))))


def block_of(n_blocks: int, *columns):
    """Block of a row: an even deal by the hash of some columns."""
    return F.pmod(F.xxhash64(F.lit("block"), *columns), F.lit(n_blocks)).cast("int")


def words_of(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of UTF-8 text: what bytes.split() cuts at is just that set."""
    return text.split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply) over an array."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for k in range(size):
        out = out * U64(0x9E3779B97F4A7C15) + words[k : k + n]
    return mix64(out)


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def bucket_bounds(sorted_hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Positions that cut sorted hashes into ``n_buckets`` (a power of two) equal ranges."""
    if n_buckets == 1:
        return np.array([0, len(sorted_hashes)])
    starts = np.arange(n_buckets, dtype=U64) << U64(64 - n_buckets.bit_length() + 1)
    return np.append(np.searchsorted(sorted_hashes, starts), len(sorted_hashes))
