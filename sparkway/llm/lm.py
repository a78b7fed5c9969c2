"""Language-model scoring by cross-entropy difference.

Two bigram models share one vocabulary: the target model is counted from documents labelled
good (quality 1, not toxic), the background model from all others.  They are matched: the same
smoothing, and background counts scaled to the target's number of tokens.  Each token
has a loss under both; a document's score is the mean difference, background minus target:
above 0 it reads like the target.  A document's own counts are left out of the model it belongs
to.

    P0(w)     = (c(w) + 1) / (N + vocabulary)                  both corpora together
    P(w)      = (c_m(w) + unigram_mass P0(w)) / (N_m + unigram_mass)
    P(w | v)  = (c_m(v w) + bigram_mass P(w)) / (c_m(v) + bigram_mass)

Counts are exact over the whole corpus up to collisions of 48-bit hashes, and travel in packed
exchanges (see ``common``): a block sends its distinct unigrams and bigrams with counts,
buckets add them up and answer in the order of the request.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, block_of, bucket_bounds, documents, mix64, power_of_two, text_size, words_of

BLOCK_BYTES = 10 << 20
BUCKET_ENTRIES = 1 << 20
KEY_BITS = 48
REQUEST = "bucket int, block int, keys binary, counts binary"
ANSWER = "block int, bucket int, doc_id long, target boolean, counts binary"


def _narrow(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8].tobytes()


def _wide(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, KEY_BITS // 8)
    return np.concatenate((raw, np.zeros((len(raw), 8 - KEY_BITS // 8), np.uint8)), axis=1).view("<u8").ravel()


class Block:
    """Tokens of one block, their unigram and bigram keys, and the roles of its documents."""

    def __init__(self, table: pa.Table, roles: pa.Table):
        target = {d for d, t in zip(roles.column("doc_id").to_pylist(), roles.column("target").to_pylist(), strict=True) if t}
        self.ids = table.column("doc_id").to_pylist()
        words = [words_of(t.lower() if t else t) for t in table.column("text").to_pylist()]
        self.sizes = np.array([len(w) for w in words], np.int64)
        digest = xxhash.xxh3_64_intdigest
        flat = np.fromiter((digest(w) for doc in words for w in doc), U64, int(self.sizes.sum()))
        self.doc = np.repeat(np.arange(len(words)), self.sizes)
        self.role = np.array([d in target for d in self.ids], bool)
        self.first = np.ones(len(flat), bool)  # a document's first token has no bigram
        self.first[1:] = self.doc[1:] != self.doc[:-1]
        drop = U64(64 - KEY_BITS)
        single = mix64(flat) >> drop
        double = mix64(np.roll(flat, 1) * U64(0x9E3779B97F4A7C15) + flat + U64(1))[~self.first] >> drop
        self.keys, inverse = np.unique(np.concatenate((single, double)), return_inverse=True)
        self.single = inverse[: len(flat)]
        self.double = np.full(len(flat), -1)
        self.double[~self.first] = inverse[len(flat) :]

    def counts(self) -> np.ndarray:
        """[target, background] counts of each key."""
        own = self.role[self.doc]
        second = ~self.first
        key = np.concatenate((self.single, self.double[second]))
        role = np.concatenate((own, own[second]))
        return np.stack([np.bincount(key[role == r], minlength=len(self.keys)) for r in (True, False)]).astype(np.int64)

    def own(self, key: np.ndarray) -> np.ndarray:
        """For each token, how often its document has its key (0 where there is none)."""
        if not len(key):
            return np.zeros(0, np.int64)
        _, at, n = np.unique(self.doc * (len(self.keys) + 1) + key + 1, return_inverse=True, return_counts=True)
        return np.where(key >= 0, n[at], 0)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: int = 1 << 20, unigram_mass: float = 1000.0, bigram_mass: float = 20.0, block_bytes: int = BLOCK_BYTES, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, score): losses in nats per token.

    ``labels`` has doc_id, quality and toxic; a document is target if some label row gives it quality
    1 and none gives it toxic 1.  Documents without a label, or with null labels, are background.

    Texts without words have no losses and no score (null).  Without any target or background
    token both models fall back to what they share.  Repeated rows are counted and
    scored each; a null doc_id is background; an empty table gives an empty result; further
    columns are not read.
    """
    rows, size = text_size(docs, text_col)
    n_blocks = max(1, -(-size // block_bytes))
    n_buckets = power_of_two(size / 6 / bucket_entries)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    roles = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.coalesce(F.max("quality"), F.lit(0)) == 1).alias("good"), (F.coalesce(F.max("toxic"), F.lit(0)) == 1).alias("bad"))
    roles = roles.where("doc_id is not null and good and not bad").select("doc_id", F.lit(True).alias("target"))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(words_of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n"])

    sizes = source.mapInArrow(lengths, "doc_id long, n long").join(roles, "doc_id", "left")
    totals = {bool(r["t"]): r["n"] for r in sizes.groupBy(F.coalesce("target", F.lit(False)).alias("t")).agg(F.sum("n").alias("n")).collect()}
    n_target, n_background = float(totals.get(True) or 0), float(totals.get(False) or 0)
    scale = n_target / n_background if n_target and n_background else 1.0

    blocks = source.withColumn("block", block_of(n_blocks, "doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))).groupBy("block")
    dealt_roles = roles.select(block_of(n_blocks, "doc_id", F.lit(None).cast("binary")).alias("block"), F.lit(None).cast("int").alias("bucket"), "doc_id", "target", F.lit(None).cast("binary").alias("counts"))

    def ask(key: tuple, table: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(table, right)
        counts = block.counts()
        cuts = bucket_bounds(block.keys << U64(64 - KEY_BITS), n_buckets)
        full = [k for k in range(n_buckets) if cuts[k + 1] > cuts[k]]
        press = zstandard.ZstdCompressor(level=1).compress
        return pa.table(
            {
                "bucket": pa.array(full, pa.int32()),
                "block": pa.array([key[0].as_py()] * len(full), pa.int32()),
                "keys": pa.array([_narrow(block.keys[cuts[k] : cuts[k + 1]]) for k in full], pa.binary()),
                "counts": pa.array([press(counts[:, cuts[k] : cuts[k + 1]].tobytes()) for k in full], pa.binary()),
            }
        )

    def add(table: pa.Table) -> pa.Table:
        unpress, press = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        parts = [_wide(k) for k in table.column("keys").to_pylist()]
        counts = np.concatenate([np.frombuffer(unpress(c), np.int64).reshape(2, -1) for c in table.column("counts").to_pylist()], axis=1)
        keys = np.concatenate(parts)
        order = np.argsort(keys, kind="stable")
        new = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
        run = np.empty(len(keys), np.int64)
        run[order] = np.cumsum(new) - 1
        sums = np.add.reduceat(counts[:, order], np.flatnonzero(new), axis=1)[:, run]
        cuts = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        n = len(parts)
        return pa.table(
            {
                "block": table.column("block").cast(pa.int32()),
                "bucket": table.column("bucket").cast(pa.int32()),
                "doc_id": pa.nulls(n, pa.int64()),
                "target": pa.nulls(n, pa.bool_()),
                "counts": pa.array([press(sums[:, a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
            }
        )

    def judge(key: tuple, table: pa.Table, right: pa.Table) -> pa.Table:
        known = pa.compute.is_valid(right.column("bucket"))
        block = Block(table, right.filter(pa.compute.invert(known)))
        unpress = zstandard.ZstdDecompressor().decompress
        answers = right.filter(known).sort_by("bucket").column("counts").to_pylist()
        sums = np.concatenate([np.frombuffer(unpress(c), np.int64).reshape(2, -1) for c in answers], axis=1) if answers else np.zeros((2, 0), np.int64)
        assert sums.shape[1] == len(block.keys), "an answer is missing"
        sums = np.concatenate((sums, np.zeros((2, 1), np.int64)), axis=1)  # the last column stands for no key
        before = np.roll(block.single, 1)
        before[block.first] = -1
        own_one, own_two = block.own(block.single), block.own(block.double)
        own_before = np.where(block.first, 0, np.roll(own_one, 1))
        role, length = block.role[block.doc], block.sizes[block.doc]
        base = (sums[:, block.single].sum(axis=0) - own_one + 1.0) / (n_target + n_background - length + vocabulary)
        losses = []
        for m, mine, total, factor in ((0, role, n_target, 1.0), (1, ~role, n_background, scale)):
            rest = lambda column, own: (sums[m, column] - np.where(mine, own, 0)) * factor  # noqa: B023, E731
            one = (rest(block.single, own_one) + unigram_mass * base) / ((total - np.where(mine, length, 0)) * factor + unigram_mass)
            two = (rest(block.double, own_two) + bigram_mass * one) / (rest(before, own_before) + bigram_mass)
            losses.append(np.bincount(block.doc, -np.log(two), minlength=len(block.sizes)))
        some = block.sizes > 0
        per_token = [np.divide(x, block.sizes, where=some, out=np.zeros(len(x))) for x in losses]
        value = lambda x: pa.array(x, pa.float64(), mask=~some)
        return pa.table({"doc_id": pa.array(block.ids, pa.int64()), "n_tokens": pa.array(block.sizes), "loss_target": value(per_token[0]), "loss_background": value(per_token[1]), "score": value(per_token[1] - per_token[0])})

    asked = blocks.cogroup(dealt_roles.groupBy("block")).applyInArrow(ask, REQUEST)
    answers = asked.groupBy("bucket").applyInArrow(add, ANSWER)
    right = dealt_roles.unionByName(answers)
    return blocks.cogroup(right.groupBy("block")).applyInArrow(judge, "doc_id long, n_tokens long, loss_target double, loss_background double, score double")


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of all documents between good ones and the rest."""
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
