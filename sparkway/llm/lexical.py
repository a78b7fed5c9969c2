"""Ranked lexical search over a bit-sliced impact index.

A document's impact for a term is the integer that the term adds to its score.  A block of documents keeps, for every term that is
asked, the impacts as bitmaps: one for each bit, with one place for each document.  An item's scores for all documents of
a block are the sum of its terms' slices, formed by bitwise carry arithmetic: full adders over bitmaps reduce three
numbers to two until one addition with rippling carries is left.  The top documents are then found from the most significant
slice downward; documents that tie at the boundary go by the smaller id.

Texts are read once: the counts of the terms that are asked, and the number of all terms, are what is kept of a document.
Corpus statistics come from that table, and blocks are made of it wherever it lies.  Only the best rows of a task
travel, and they meet in two steps.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, checkpointed, documents

#: Documents of one block of the index.
BLOCK_ROWS = 4096
#: Item texts that are searched in one pass over the documents, in bytes.
PASS_BYTES = 4 << 20
#: Tasks whose answers are merged first.
MERGED = 512
#: Fixed values of the score.
SCALE, GAIN, LENGTH, FLOOR = 1_000_000_000, 1000, 12, 75

_SPACES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in _SPACES)


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of UTF-8 text: runs of digits, letters and all that isn't ASCII; only A-Z are lower-cased."""
    return text.translate(_TABLE).split() if text else []


def weight(n_docs: int, df: int) -> int:
    """The weight of a term that ``df`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def bitmap(flags: np.ndarray, words: int) -> np.ndarray:
    """Flags as bits of ``words`` 64-bit words; the last axis is packed."""
    packed = np.packbits(flags, axis=-1, bitorder="little")
    out = np.zeros((*flags.shape[:-1], words * 8), np.uint8)
    out[..., : packed.shape[-1]] = packed
    return out.view(U64)


def sliced(values: np.ndarray, words: int, bits: int) -> np.ndarray:
    """[bit, word] slices of non-negative integers below 2^bits."""
    shifted = values.astype(np.int64)[None, :] >> np.arange(bits, dtype=np.int64)[:, None]
    return bitmap((shifted & 1).astype(bool), words)


def added(numbers: np.ndarray) -> np.ndarray:
    """[bit, word] slices of the sum of sliced numbers [number, bit, word]; the sum has to fit the bits."""
    while len(numbers) > 2:
        third = len(numbers) // 3
        a, b, c, rest = numbers[:third], numbers[third : 2 * third], numbers[2 * third : 3 * third], numbers[3 * third :]
        half = a ^ b
        carry = np.zeros_like(a)
        carry[:, 1:] = ((a & b) | (half & c))[:, :-1]
        numbers = np.concatenate((half ^ c, carry, rest))
    if len(numbers) == 1:
        return numbers[0]
    a, b = numbers
    half, both = a ^ b, a & b
    carry = np.zeros(a.shape[1], U64)
    for bit in range(len(a)):
        half[bit], carry = half[bit] ^ carry, both[bit] | (half[bit] & carry)
    return half


def times(number: np.ndarray, factor: int) -> list[np.ndarray]:
    """Sliced numbers whose sum is ``factor`` times the number: one for each set bit of the factor."""
    out = []
    for shift in range(factor.bit_length()):
        if factor >> shift & 1:
            moved = np.zeros_like(number)
            moved[shift:] = number[: len(number) - shift]
            out.append(moved)
    return out


def top(slices: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest numbers above zero (in no order), of equals the first places."""
    open_ = np.bitwise_or.reduce(slices, axis=0)
    sure, found = np.zeros_like(open_), 0
    for s in slices[::-1]:
        higher = open_ & s
        count = found + int(np.bitwise_count(higher).sum())
        if count > k:
            open_ = higher
        else:
            sure, found, open_ = sure | higher, count, open_ & ~s
            if found == k:
                break
    places = lambda bits: np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))
    chosen = places(sure)
    return np.concatenate((chosen, places(open_)[: k - found])) if found < k else chosen


def values_at(slices: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The numbers that the slices hold at some places."""
    bits = (slices[:, places // 64] >> (places % 64).astype(U64)) & U64(1)
    return (bits.astype(np.int64) << np.arange(len(slices), dtype=np.int64)[:, None]).sum(axis=0)


class ImpactBlock:
    """Sliced impacts of one block of documents, by term; documents in order of id."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        """``counts`` says how many of the flat ``terms`` and ``tfs`` each document has; ``lengths`` is its number of all terms."""
        self.words = -(-len(lengths) // 64)
        m = FLOOR + (25 * lengths * n_docs) // n_terms
        at = np.repeat(np.arange(len(lengths)), counts)
        impacts = weights[terms] * ((SCALE * tfs) // (GAIN * tfs + LENGTH * m[at]))
        order = np.argsort(terms, kind="stable")
        terms, self.at, self.impacts = terms[order], at[order], impacts[order]
        found, starts = np.unique(terms, return_index=True)
        ends = np.append(starts[1:], len(terms))[: len(found)]
        self.spans = {t: (a, b) for t, a, b in zip(found.tolist(), starts.tolist(), ends.tolist(), strict=True)}

    def slices(self, term: int, bits: int) -> np.ndarray:
        a, b = self.spans[term]
        whole = np.zeros(self.words * 64, np.int64)
        whole[self.at[a:b]] = self.impacts[a:b]
        return sliced(whole, self.words, bits)

    def answer(self, asked: list[tuple[int, int]], kept: dict[int, np.ndarray], bits: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents for (term, repeats)."""
        numbers = []
        for term, repeats in asked:
            if term in self.spans:
                if term not in kept:
                    kept[term] = self.slices(term, bits)
                numbers += times(kept[term], repeats)
        if not numbers:
            return np.zeros(0, int), np.zeros(0, np.int64)
        slices = added(np.stack(numbers))
        places = top(slices, k)
        return places, values_at(slices, places)


def counted(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): the number of all terms of every document, and how often it holds those of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in batch.column("text"):
                words = terms_of(text.as_py())
                held = [(vocabulary[w], tf) for w, tf in Counter(words).items() if w in vocabulary]
                n.append(len(words))
                terms.append([t for t, _ in held])
                tfs.append([tf for _, tf in held])
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n": pa.array(n, pa.int64()), "terms": pa.array(terms, pa.list_(pa.int32())), "tfs": pa.array(tfs, pa.list_(pa.int64()))})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>")


def _passes(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Items (id, text) in parts of PASS_BYTES at most, or of one item."""
    part, held = [], 0
    for row in items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").cast("binary").alias("text")).toLocalIterator():
        size = len(row["text"] or b"") + 64
        if part and held + size > PASS_BYTES:
            yield part
            part, held = [], 0
        part.append((row["item"], bytes(row["text"] or b"")))
        held += size
    if part:
        yield part


def _searched(docs: DataFrame, part: list[tuple], id_col: str, text_col: str, k: int, block_rows: int) -> DataFrame:
    vocabulary: dict[bytes, int] = {}
    asked = []
    for _, text in part:
        repeats = Counter(terms_of(text))
        asked.append([(vocabulary.setdefault(w, len(vocabulary)), c) for w, c in repeats.items()])
    ids = [item for item, _ in part]
    index = checkpointed(counted(docs, id_col, text_col, vocabulary).where("n > 0"))
    total = index.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = int(total["docs"]), int(total["terms"] or 0)
    weights = np.full(len(vocabulary), 0, np.int64)
    # one row for each term of this pass, whose number the pass bounds
    for row in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():
        weights[row["term"]] = weight(n_docs, row["df"])
    # no score of the pass has more bits
    most = max((sum(c * int(weights[t]) for t, c in a) for a in asked), default=0) * (SCALE // GAIN)
    bits = max(1, most.bit_length())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, float, int]]] = [[] for _ in asked]

        def one_block(tables: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(tables)
            docs_at = np.array([math.inf if d is None else d for d in table.column("doc_id").to_pylist()], object)
            order = np.array(sorted(range(len(docs_at)), key=lambda i: docs_at[i]), np.int64)
            table = table.take(pa.array(order)).combine_chunks()
            lists = table.column("terms").combine_chunks()
            block = ImpactBlock(table.column("n").to_numpy(), lists.value_lengths().to_numpy(), lists.flatten().to_numpy(), table.column("tfs").combine_chunks().flatten().to_numpy(), weights, n_docs, n_terms)
            kept: dict[int, np.ndarray] = {}
            for at, terms in enumerate(asked):
                places, scores = block.answer(terms, kept, bits, k)
                if len(places):
                    found = [(-s, docs_at[order[p]]) for p, s in zip(places.tolist(), scores.tolist(), strict=True)]
                    best[at] = sorted(best[at] + found)[:k]
                if len(kept) * bits * block.words > BLOCK_ROWS * 1024:  # 32 MB of slices
                    kept.clear()

        held, rows = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                step = min(batch.num_rows - at, block_rows - rows)
                held.append(batch.slice(at, step))
                rows, at = rows + step, at + step
                if rows == block_rows:
                    one_block(held)
                    held, rows = [], 0
        if held:
            one_block(held)
        flat = [(at, None if d == math.inf else d, -s) for at, found in enumerate(best) for s, d in found]
        ask, doc, score = zip(*flat, strict=True) if flat else ((), (), ())
        yield pa.record_batch({"ask": pa.array(ask, pa.int64()), "doc_id": pa.array(doc, pa.int64()), "score": pa.array(score, pa.int64())})

    found = index.mapInArrow(search, "ask long, doc_id long, score long").withColumn("share", F.expr(f"spark_partition_id() div {MERGED}"))
    ranked = lambda rows, *keys: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
    merged = ranked(ranked(found, "ask", "share"), "ask")
    names = docs.sparkSession.createDataFrame(list(enumerate(ids)), "ask long, item_id long")
    return merged.join(names, "ask").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", *, k: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents that score highest for every item, of equal scores the smaller id first.

    Terms are runs of ASCII letters, digits and all other characters beyond ASCII, with A-Z lower-cased.  A term weighs
    floor(1000 ln((2N + 2) / (2 df + 1))), N being the documents with a term and df those that hold it; it adds
    weight * (10^9 tf div (1000 tf + 12 m)) to a document's score, where m = 75 + (25 n N) div L, n and L being the number of terms of the
    document and of all documents.  A term that stands twice in an item counts twice.

    Only scores above zero are given; fewer than k documents give fewer rows.  A null or empty text has no
    terms: such a document is in no count, such an item finds nothing.  Rows are taken one by one: repeated documents all rank, each repeated
    item gets its own rows, a null item_id too.  A null doc_id comes last among equal scores.  Very long texts are
    one row of a block, with as many entries as the items have terms.  Empty tables give an empty result; further columns are not read.  Scores have to fit a long.

    Items of ``PASS_BYTES`` together are sent to all tasks; more of them take further passes over the documents.
    """
    found = [_searched(docs, part, doc_id, doc_text, k, block_rows) for part in _passes(items, item_id, item_text)]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that score highest for each benchmark item, of all documents."""
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS own, doc_id, {_WORDS} AS terms FROM documents WHERE text IS NOT NULL),
n AS (SELECT own, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
asked AS (SELECT ask, item_id, term, count(*) AS repeats FROM (
  SELECT ask, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS ask, item_id, {_WORDS} AS terms FROM benchmark WHERE text IS NOT NULL)) GROUP BY ALL),
tf AS (SELECT own, term, count(*) AS tf FROM (SELECT own, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY own, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), whole),
p AS (SELECT own, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))) AS p FROM tf JOIN n USING (own) JOIN w USING (term), whole),
s AS (SELECT ask, item_id, own, doc_id, CAST(sum(p * repeats) AS BIGINT) AS score FROM asked JOIN p USING (term) GROUP BY ask, item_id, own, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20
"""
