"""Exact top-k inner products over a bit-sliced index.

A block of vectors is kept as bit slices: for every dimension and bit one bitmap over the
rows, after moving the dimension's smallest value to zero.  The scores of all rows against
a query are formed at once with bitmap arithmetic: each set bit of a query component adds
that dimension's slices, shifted, and full adders over bitmaps reduce the slices of each
weight until one is left (negative components add complemented slices and a constant).
The top rows are then selected from the most significant slice downward; rows that tie at the
boundary are resolved by the smaller id.  Blocks answer for themselves, and the
answers of all blocks are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, checkpointed

BLOCK_ROWS = 16_384
QUERY_ROWS = 4096


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int, *more) -> DataFrame:
    """(vec_id, q array<long>, dims): floor(scale * x), without vectors that hold null or non-finite values."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"), *more).where("vec_id is not null and x is not null").where(fine)
    return rows.select(*[c for c in rows.columns if c != "x"], F.transform("x", lambda v: F.floor(v * float(scale)).cast("long")).alias("q"), F.size("x").alias("dims"))


class SlicedBlock:
    """Bit slices of one block of integer vectors, rows in order of id."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, slices: np.ndarray):
        self.ids, self.low, self.bits = ids, low, slices.shape[1]
        dims, bits, words = slices.shape
        self.table = np.concatenate((slices.reshape(dims * bits, words), ~slices.reshape(dims * bits, words)))
        self.valid = _bitmap(np.ones(len(ids), bool), words)

    @staticmethod
    def build(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, smallest value by dimension, slices [dimension, bit, word]."""
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        low = values.min(axis=0)
        raised = (values - low).astype(U64)
        bits = max(1, int(raised.max(initial=0)).bit_length())
        words = -(-len(ids) // 64)
        slices = np.zeros((values.shape[1], bits, words), U64)
        for d in range(values.shape[1]):
            for b in range(bits):
                slices[d, b] = _bitmap((raised[:, d] >> U64(b)) & U64(1) == 1, words)
        return ids, low, slices

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the scores from weight 0 up, and the constant to add."""
        dims = len(query)
        size = np.abs(query)
        negative = query < 0
        top = int(size.max(initial=0)).bit_length()
        constant = sum(int(q) * int(v) for q, v in zip(query.tolist(), self.low.tolist(), strict=True))
        constant -= int(size[negative].sum()) * ((1 << self.bits) - 1)
        columns: list[list[np.ndarray]] = [[] for _ in range(top + self.bits)]
        first = (np.arange(dims) + np.where(negative, dims, 0)) * self.bits
        for i in range(top):
            used = first[(size >> i) & 1 == 1]
            for j in range(self.bits if len(used) else 0):
                columns[i + j].append(self.table[used + j])
        out, weight = [], 0
        while weight < len(columns):
            column = columns[weight]
            rows = np.concatenate(column) if column else np.zeros((0, self.table.shape[1]), U64)
            while len(rows) > 1:
                if len(rows) == 2:
                    carry, rows = rows[:1] & rows[1:], rows[:1] ^ rows[1:]
                else:
                    third = len(rows) // 3
                    a, b, c, rest = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third], rows[3 * third :]
                    half = a ^ b
                    carry, rows = (a & b) | (half & c), half ^ c
                    rows = np.concatenate((rows, rest)) if len(rest) else rows
                if weight + 1 == len(columns):
                    columns.append([])
                columns[weight + 1].append(carry)
            out.append(rows[0] if len(rows) else np.zeros(self.table.shape[1], U64))
            columns[weight] = []
            weight += 1
        return out, constant

    def top(self, own: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
        """Ids and scores of the k best rows (in no order), without the rows in ``own``."""
        slices, constant = self.scores(query)
        open_ = self.valid
        if len(own):
            mask = np.zeros(len(self.ids), bool)
            mask[own] = True
            open_ = open_ & ~_bitmap(mask, len(open_))
        sure, found = np.zeros_like(open_), 0
        for s in reversed(slices):
            higher = open_ & s
            count = found + int(np.bitwise_count(higher).sum())
            if count > k:
                open_ = higher
            else:
                sure, found, open_ = sure | higher, count, open_ & ~s
                if found == k:
                    break
        rows = _rows(sure)
        if found < k:  # rows that tie: the smallest ids, which come first
            rows = np.concatenate((rows, _rows(open_)[: k - found]))
        word, bit = rows // 64, (rows % 64).astype(U64)
        scores = [constant + sum(int(s[w] >> b & U64(1)) << e for e, s in enumerate(slices)) for w, b in zip(word, bit, strict=True)]
        return self.ids[rows], scores


def _bitmap(flags: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 8, np.uint8)
    packed = np.packbits(flags, bitorder="little")
    out[: len(packed)] = packed
    return out.view(U64)


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def search(vectors: DataFrame, asks: Column | str, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 5, scale: int = 256, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that meets ``asks`` the k other rows with the highest inner product.

    Components become floor(scale * x).  Ties go to the smaller id.  A row never finds itself, but it finds
    other rows with its id, equal ones too.  Vectors that are null or hold null or non-finite components, and rows with a
    null id, take no part; vectors meet only vectors of as many components.  Equal rows (id and vector)
    are one row of the index with at most k + 1 copies, as more can't be among k results; equal query rows give equal results
    each.  Fewer than k candidates give fewer rows; an empty table gives none; further columns are not read.  Scores
    have to fit a long.

    Blocks of rows meet parts of queries: a task holds ``block_rows`` rows and ``query_rows`` queries at most, more or less as
    hashing deals them, and builds the index of its block once.
    """
    asked = F.coalesce(F.expr(asks) if isinstance(asks, str) else asks, F.lit(False))
    rows = quantised(vectors, id_col, vector_col, scale, asked.alias("asks"))
    rows = checkpointed(rows.groupBy("vec_id", "dims", "q").agg(F.count(F.lit(1)).alias("copies"), F.max("asks").alias("asks")))
    sizes = rows.agg(F.sum(F.least("copies", F.lit(k + 1))).alias("rows"), F.count(F.when(F.col("asks"), 1)).alias("queries")).first()
    n_blocks, n_parts = max(1, -(-(sizes["rows"] or 0) // block_rows)), max(1, -(-sizes["queries"] // query_rows))
    every = lambda n: F.sequence(F.lit(0), F.lit(n - 1))

    def answer(key: tuple, table: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        if table.num_rows and queries.num_rows:
            dims = key[0].as_py()
            matrix = lambda t: t.column("q").combine_chunks().flatten().to_numpy().reshape(t.num_rows, dims)
            ids, values, copy = table.column("vec_id").to_numpy(), matrix(table), table.column("copy").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, values, copy = ids[order], values[order], copy[order]
            block = SlicedBlock(*SlicedBlock.build(ids, values))
            for query_id, query, n in zip(queries.column("vec_id").to_pylist(), matrix(queries), queries.column("copies").to_pylist(), strict=True):
                same = slice(*np.searchsorted(ids, (query_id, query_id + 1)))
                own = same.start + np.flatnonzero((copy[same] == 0) & (values[same] == query).all(axis=1))
                found, scores = block.top(own, query, k)
                out[0].extend([query_id] * len(scores))
                out[1].extend(found.tolist())
                out[2].extend(scores)
                out[3].extend([(query.tobytes(), n)] * len(scores))
        which, n = zip(*out[3], strict=True) if out[3] else ((), ())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64()), "query": pa.array(which, pa.binary()), "n": pa.array(n, pa.int64())})

    hashed = lambda what, n, *columns: F.pmod(F.xxhash64(F.lit(what), *columns), F.lit(n)).cast("int")
    copied = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.least("copies", F.lit(k + 1)).cast("int") - 1)))
    index = copied.select("dims", hashed("block", n_blocks, "vec_id", "q", "copy").alias("block"), F.explode(every(n_parts)).alias("part"), "vec_id", "q", "copy")
    queries = rows.where("asks").select("dims", F.explode(every(n_blocks)).alias("block"), hashed("part", n_parts, "vec_id", "q").alias("part"), "vec_id", "q", "copies")
    cell = ["dims", "block", "part"]
    best = index.groupBy(*cell).cogroup(queries.groupBy(*cell)).applyInArrow(answer, "query_id long, vec_id long, score long, query binary, n long")
    place = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    top = best.withColumn("rank", place).where(F.col("rank") <= k)
    return top.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows by integer inner product for every vec_id divisible by 50, over all embeddings."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, "vec_id % 50 = 0", k=5, scale=256)


OP6_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.own, a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.own <> b.own AND len(a.q) = len(b.q)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
