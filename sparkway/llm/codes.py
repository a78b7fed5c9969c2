"""Vector code compression: every vector as one codebook entry for each of its parts.

The nearest entry is found by lower bounds, coarse to fine.  With both vectors cut into blocks, let M be the block means, each weighted
by the root of the block's length, and r the norm of what is left after the means are taken off.  Then

    |x - c|^2  >=  |M(x) - M(c)|^2 + (r(x) - r(c))^2,

because means and rest are orthogonal and the rests' norms differ by no more than the rests do.  One block comes first, then two, four ...:
each level drops the entries whose bound is above the distance of the best entry known, with some slack for rounding, and the
survivors receive exact integer distances.  So the entries chosen are those of a full comparison.

Training is a few rounds over all vectors.  A task sums its parts by entry, the sums are added up, and the driver holds nothing but the codebooks, whose size
follows from parameters and the number of components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, small_batches
from .skew import with_facts

#: Rows that are compared with a codebook at once.
ROWS = 2048
#: Slack of the bounds, as a share of the squared lengths of both vectors: far above what double arithmetic loses.
SLACK = 1e-9


def integers(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, lengths, values): which vectors are whole and finite, how long they are, and floor(scale * x) of their components."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = pc.list_flatten(column).cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(column)), lengths)
    fine = np.asarray(column.is_valid()).copy()
    fine[owner[~np.isfinite(x)]] = False
    return np.flatnonzero(fine), lengths[fine], np.floor(scale * x[fine[owner]]).astype(np.int64)


def matrix(lengths: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """One row of ``width`` for each vector, short ones filled up with zeros."""
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def summary(x: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block means weighted by the root of the block's length [row, block], and the norm of the rest."""
    cuts = np.linspace(0, x.shape[1], blocks + 1).astype(int)
    means, rest = np.empty((len(x), blocks)), np.zeros(len(x))
    for b, (start, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = x[:, start:end].astype(np.float64)
        mean = part.mean(axis=1)
        means[:, b] = mean * np.sqrt(end - start)
        rest += ((part - mean[:, None]) ** 2).sum(axis=1)
    return means, np.sqrt(rest)


class Codebook:
    """Entries of one part position, with their summaries at every level."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        width = entries.shape[1]
        self.levels = [1 << k for k in range(max(1, width).bit_length()) if 1 << k < width]
        self.summaries = {b: summary(entries, b) for b in self.levels}
        self.sizes = (entries.astype(np.float64) ** 2).sum(axis=1)

    def exact(self, x: np.ndarray, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
        d = x[rows] - self.entries[which]
        return np.einsum("ij,ij->i", d, d)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of every row, of equals the first, and the squared distance."""
        n = len(x)
        every = np.arange(n)
        best = np.full(n, np.inf)
        open_ = np.ones((n, len(self.entries)), bool)
        slack = SLACK * ((x.astype(np.float64) ** 2).sum(axis=1)[:, None] + self.sizes[None, :] + 1)
        for blocks in self.levels:
            (means, rest), (entry_means, entry_rest) = summary(x, blocks), self.summaries[blocks]
            bound = (rest[:, None] - entry_rest[None, :]) ** 2 - slack
            # |M(x) - M(c)|^2, written out; the slack covers what cancels
            bound += (means**2).sum(axis=1)[:, None] + (entry_means**2).sum(axis=1)[None, :] - 2 * means @ entry_means.T
            bound[~open_] = np.inf
            # the open entry with the smallest bound may give a better known distance
            best = np.minimum(best, self.exact(x, every, bound.argmin(axis=1)))
            open_ = bound <= best[:, None]
        rows, which = np.nonzero(open_)
        table = np.full((n, len(self.entries)), np.iinfo(np.int64).max)
        table[rows, which] = self.exact(x, rows, which)
        chosen = table.argmin(axis=1)
        return chosen, table[every, chosen]


def _chunks(n: int) -> Iterator[slice]:
    return (slice(a, a + ROWS) for a in range(0, n, ROWS))


def _parts(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return [np.ascontiguousarray(p) for p in np.split(x, parts, axis=1)]


def _start(vectors: DataFrame, scale: int, parts: int, entries: int) -> tuple[int, np.ndarray]:
    """Components of a vector, filled up to a multiple of ``parts``, and the vectors of the smallest ids."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        longest = -1
        for batch in batches:
            rows, lengths, values = integers(batch.column("vector"), scale)
            longest = max(longest, int(lengths.max(initial=-1)))
            ends = np.cumsum(lengths)
            ids = batch.column("vec_id").take(pa.array(rows)).to_pylist()
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            for i in order[: entries + sum(1 for j in order[entries:] if ids[j] == ids[order[entries - 1]]) if len(order) > entries else None]:
                held.append((ids[i] is None, ids[i] or 0, values[ends[i] - lengths[i] : ends[i]].tolist()))
            held = sorted(held)[:entries]
        yield pa.record_batch({"last": pa.array([h[0] for h in held], pa.bool_()), "vec_id": pa.array([h[1] for h in held], pa.int64()), "q": pa.array([h[2] for h in held], pa.list_(pa.int64())), "longest": pa.array([longest] * len(held), pa.int64())})

    found = checkpointed(vectors.mapInArrow(smallest, "last boolean, vec_id long, q array<long>, longest long"))
    longest = found.agg(F.max("longest")).first()[0]
    if longest is None:
        return 0, np.zeros((0, 0), np.int64)
    width = -(-longest // parts) * parts
    first = [r["q"] for r in found.orderBy("last", "vec_id", "q").limit(entries).collect()]  # as many as a codebook has entries
    flat = np.array([v for q in first for v in q], np.int64)
    return width, matrix(np.array([len(q) for q in first], np.int64), flat, width)


def _sums(vectors: DataFrame, books: list[np.ndarray], scale: int, width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry): how many parts are nearest to the entry, and their componentwise sums."""
    part_width = width // len(books)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks = [Codebook(b) for b in books]
        sums = [np.zeros((len(b), part_width + 1), np.int64) for b in books]
        for batch in batches:
            _, lengths, values = integers(batch.column("vector"), scale)
            whole = matrix(lengths, values, width)
            for rows in _chunks(len(whole)):
                for book, total, x in zip(codebooks, sums, _parts(whole[rows], len(books)), strict=True):
                    chosen, _ = book.nearest(x)
                    np.add.at(total, chosen, np.c_[np.ones(len(x), np.int64), x])
        used = [(p, e) for p, total in enumerate(sums) for e in np.flatnonzero(total[:, 0]).tolist()]
        columns = {"part": pa.array([p for p, _ in used], pa.int32()), "entry": pa.array([e for _, e in used], pa.int32())}
        for c in range(part_width + 1):
            columns[f"s{c}"] = pa.array([int(sums[p][e, c]) for p, e in used], pa.int64())
        yield pa.record_batch(columns)

    names = [f"s{c}" for c in range(part_width + 1)]
    found = vectors.mapInArrow(summed, "part int, entry int, " + ", ".join(f"{c} long" for c in names))
    added = found.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names])
    return {(r["part"], r["entry"]): (r["s0"], [r[c] for c in names[1:]]) for r in added.collect()}  # parts x entries rows at most


def trained(vectors: DataFrame, *, scale: int, parts: int, entries: int, rounds: int) -> tuple[int, list[np.ndarray]]:
    """The number of components, and the codebook of every part position, of vectors (vec_id, vector)."""
    width, first = _start(vectors, scale, parts, entries)
    if not len(first):
        return 0, []
    books = _parts(first, parts)
    for _ in range(rounds):
        for (part, entry), (n, total) in _sums(vectors, books, scale, width).items():
            books[part][entry] = [v // n for v in total]
    return width, books


def coded(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *more: str, scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, code, error, *more), codebooks): every vector as the places of its parts' nearest entries.

    Components become floor(scale * x); vectors are cut into ``parts`` equal consecutive parts.  A part's codebook starts as that
    part of the ``entries`` smallest ids; each round replaces an entry by the componentwise floor of its parts' mean, and an unused entry stays.
    Nearest is by squared Euclidean distance, ties to the lower place.  code: two hex digits for each part.  error: squared distances, summed.

    Vectors that are null or hold null or non-finite components take no part.  Vectors shorter than the longest, and a length
    that the parts don't divide, are filled up with zeros.  Equal ids start in order of their components, null ids come last; repeated rows
    count as often as they stand.  An empty table gives an empty result and no codebooks.  No more than 256 entries
    fit a code.  Scaled components, and sums of squares, have to fit a long.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code holds up to 256 entries a part")
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), *[F.col(c).alias(f"_{c}") for c in more])
    width, books = trained(named.select("vec_id", "vector"), scale=scale, parts=parts, entries=entries, rounds=rounds)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks = [Codebook(b) for b in books]
        for batch in batches:
            kept, lengths, values = integers(batch.column("vector"), scale)
            whole = matrix(lengths, values, width)
            codes, errors = np.zeros((len(whole), parts), np.uint8), np.zeros(len(whole), np.int64)
            for rows in _chunks(len(whole)):
                for p, (book, x) in enumerate(zip(codebooks, _parts(whole[rows], parts), strict=True)):
                    codes[rows, p], distance = book.nearest(x)
                    errors[rows] += distance
            others = {f"_{c}": batch.column(f"_{c}").take(pa.array(kept)) for c in more}
            yield pa.record_batch({"vec_id": batch.column("vec_id").take(pa.array(kept)), "code": pa.array([c.tobytes().hex() for c in codes], pa.string()), "error": pa.array(errors), **others})

    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), *[named.schema[f"_{c}"] for c in more]])
    return named.mapInArrow(code, schema).withColumnsRenamed({f"_{c}": c for c in more}), books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """Hash of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as codes of four parts, with their errors and those of their labels."""
    small_batches(spark)
    codes, books = coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")
    codes = checkpointed(codes)
    labels = codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    return with_facts(codes, labels, "label", "n").select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _part_sql(vector: str) -> str:
    return f"list_slice({vector}, CAST(p * len({vector}) / 4 AS BIGINT) + 1, CAST((p + 1) * len({vector}) / 4 AS BIGINT))"


def _op13_sql() -> str:
    """Rounds written out: b<r> are the codebooks, a<r> the nearest entries."""
    distance = "list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        "k AS MATERIALIZED (SELECT row_number() OVER () AS own, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT own, p, {_part_sql('q')} AS v FROM k, range(4) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, e, {_part_sql('q')} AS v FROM (SELECT q, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS e FROM k) f, range(4) t(p) WHERE e < 256)",
    ]
    for r in range(5):
        steps.append(f"a{r} AS MATERIALIZED (SELECT own, p, arg_min(e, (d, e)) AS e, CAST(min(d) AS BIGINT) AS d FROM (SELECT x.own, x.p, b.e, {distance} AS d FROM x JOIN b{r} b ON b.p = x.p) GROUP BY own, p)")
        if r < 4:
            means = f"SELECT p, e, list(m ORDER BY i) AS v FROM (SELECT a.p, a.e, i, CAST(floor(sum(x.v[i]) / count(*)) AS BIGINT) AS m FROM a{r} a JOIN x USING (own, p), (SELECT unnest(range(1, 1 + len(x.v))) AS i) GROUP BY a.p, a.e, i) GROUP BY p, e"
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN ({means}) m USING (p, e))")
    steps.append("c AS (SELECT k.vec_id, k.label, string_agg(printf('%02x', a.e), '' ORDER BY a.p) AS code, CAST(sum(a.d) AS BIGINT) AS error FROM a4 a JOIN k USING (own) GROUP BY k.own, k.vec_id, k.label)")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b4) AS codebooks_sha256 FROM c"


OP13_SQL = _op13_sql()
