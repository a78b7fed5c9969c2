"""Substring deduplication by relative Lempel-Ziv parsing against indexed reference blocks.

Every block of documents is a reference; its index holds every ``window``-word phrase under the place where
it stands first (smallest doc_id, then place).  A document is factored greedily: the first phrase that is indexed under an earlier
document seeds a factor, which is extended along that document: it goes on while later phrases are indexed there
at the same distance and their words join up, also across phrases that an even earlier document has.
Where a factor ends, the phrases that start inside its last words are looked up again, so spans are also
found across factor boundaries.  Factors have at least ``window`` words, and the words under them are
the duplicate spans.  A phrase is indexed once, so a factor is the longest copy of indexed text that its seed begins; a
longer one in a later document that repeats indexed text isn't looked for (it would cover the same words).

The index is built and asked in two rounds of packed exchanges (see ``common``):

1. Anchors: every phrase chooses the smallest hash of its ``anchor``-word pieces, so
   equal phrases choose equal anchors, about one in five words.  Only anchors that occur in two
   documents can lie in a repeated phrase; the rest of the text is settled here.
2. Phrases around such anchors are indexed with their smallest doc_id; the answers give the
   source of every factor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, block_of, bucket_bounds, documents, mix64, pack_bits, power_of_two, text_size, unpack_bits, window_hashes, words_of

BLOCK_BYTES = 8 << 20
BUCKET_ENTRIES = 1 << 20
PLACE = np.dtype([("doc", np.int64), ("tag", np.uint32), ("at", np.uint32)])
RESULT = "doc_id long, n_words long, n_removed long, factors array<struct<start: long, end: long, source: long>>, kept_text string"


class Block:
    """Words of the documents of one block, end to end, in order of doc_id."""

    def __init__(self, table: pa.Table, window: int, anchor: int):
        self.window = window
        ids = table.column("doc_id").to_pylist()
        texts = table.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        self.ids = [ids[i] for i in order]
        self.words = [words_of(texts[i]) for i in order]
        counts = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(counts)))
        digest = xxhash.xxh3_64_intdigest
        flat = np.fromiter((digest(w) for words in self.words for w in words), U64, int(self.starts[-1]))
        self.doc = np.repeat(np.arange(len(counts)), counts)
        known = np.array([i is not None for i in self.ids], bool)
        self.id_of = np.array([i if i is not None else 0 for i in self.ids], np.int64)
        n = max(0, len(flat) - window + 1)
        doc = self.doc[:n]
        inside = (self.doc[window - 1 :] == doc) & known[doc] if n else np.zeros(0, bool)
        self.at = np.flatnonzero(inside)  # starts of the phrases
        self.phrase = window_hashes(flat, window)[self.at]
        pieces = mix64(window_hashes(flat, anchor) ^ U64(0x5851F42D4C957F2D))
        least = pieces[:n].copy()
        for k in range(1, window - anchor + 1):
            np.minimum(least, pieces[k : k + n], out=least)
        self.anchor = mix64(least)[self.at]  # minima crowd at the low end; mixed, they fill the buckets evenly
        self.owner = self.doc[self.at]
        # where each phrase stands: document, then a tag of its text (rows can have equal ids), then place
        self.place = np.zeros(len(self.at), PLACE)
        self.place["doc"] = self.id_of[self.owner]
        self.place["tag"] = np.array([xxhash.xxh32_intdigest(t or b"") for t in (texts[i] for i in order)], np.uint32)[self.owner] if len(self.at) else 0
        self.place["at"] = self.at - self.starts[self.owner]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct anchors, and whether two documents of this block have them."""
        change = np.ones(len(self.anchor), bool)
        change[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.owner[1:] != self.owner[:-1])
        anchor, ids = self.anchor[change], self.id_of[self.owner[change]]
        order = np.argsort(anchor, kind="stable")
        anchor, ids = anchor[order], ids[order]
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))) if len(anchor) else np.zeros(0, int)
        if not len(first):
            return anchor, np.zeros(0, bool)
        return anchor[first], np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)

    def phrases(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions (in ``at``) of phrases with a repeated anchor; their sorted distinct hashes and first places."""
        anchors, _ = self.anchors()
        repeated = anchors[_answered(answers, len(anchors))]
        if not len(repeated):
            return np.zeros(0, int), np.zeros(0, U64), np.zeros(0, PLACE)
        found = np.searchsorted(repeated, self.anchor)
        found[found == len(repeated)] = 0
        at = np.flatnonzero(repeated[found] == self.anchor)
        order = np.lexsort((*keys_of(self.place[at]), self.phrase[at]))
        hashes = self.phrase[at][order]
        first = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        return at, hashes[first], self.place[at][order][first]


def keys_of(places: np.ndarray) -> tuple[np.ndarray, ...]:
    """The fields of places, least important first."""
    return places["at"], places["tag"], places["doc"]


def factors_of(starts: np.ndarray, sources: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """Greedy factors (start, end, source document) of one document.

    starts: where its phrases begin that are indexed under an earlier document, ascending; sources: the places there.  A
    factor is seeded by the first phrase that no factor covers, and goes on along the seed's document as long
    as that document has the next phrase at the same distance, at most ``window`` words on (so their words join or overlap).
    Where it ends, the phrases that start in its last words are looked up again.
    """
    n = len(starts)
    shift = starts - sources["at"]
    lines = np.lexsort((starts, shift, sources["tag"], sources["doc"]))
    a, b = lines[:-1], lines[1:]
    goes_on = np.zeros(n, bool)
    goes_on[1:] = (shift[a] == shift[b]) & (sources["tag"][a] == sources["tag"][b]) & (sources["doc"][a] == sources["doc"][b]) & (starts[b] - starts[a] <= window)
    heads = np.flatnonzero(~goes_on)
    last = np.empty(n, np.int64)
    last[lines] = np.repeat(starts[lines[np.append(heads[1:], n) - 1]], np.diff(np.append(heads, n)))
    ends = (last + window).tolist()
    docs, begin, found, at, reached = sources["doc"].tolist(), starts.tolist(), [], 0, 0
    while at < n:
        reached = ends[at]
        found.append((begin[at], reached, docs[at]))
        # phrases that lie inside the factor are done; the next one reaches beyond it
        at = int(np.searchsorted(starts, reached - window + 1))
    return found


def _answered(answers: pa.Table, n: int) -> np.ndarray:
    """The bits of all buckets, in the order of the hashes asked for."""
    rows = sorted(zip(answers.column("bucket").to_pylist(), answers.column("n").to_pylist(), answers.column("bits").to_pylist(), strict=True))
    flags = np.concatenate([unpack_bits(bits, k) for _, k, bits in rows]) if rows else np.zeros(0, bool)
    assert len(flags) == n, "an answer is missing"
    return flags


REQUEST = "bucket int, block int, hashes binary, facts binary"
ANSWER = "block int, bucket int, n int, bits binary, facts binary"


def _requests(block: int, hashes: np.ndarray, facts: np.ndarray, n_buckets: int) -> pa.Table:
    cuts = bucket_bounds(hashes, n_buckets)
    full = [k for k in range(n_buckets) if cuts[k + 1] > cuts[k]]
    press = zstandard.ZstdCompressor(level=1).compress
    return pa.table(
        {
            "bucket": pa.array(full, pa.int32()),
            "block": pa.array([block] * len(full), pa.int32()),
            "hashes": pa.array([hashes[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary()),
            "facts": pa.array([press(facts[cuts[k] : cuts[k + 1]].tobytes()) for k in full], pa.binary()),
        }
    )


def _merged(table: pa.Table, kind) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket: entries per block, facts, order by hash, starts of equal hashes in it, and the run of each entry."""
    unpress = zstandard.ZstdDecompressor().decompress
    parts = [np.frombuffer(h, U64) for h in table.column("hashes").to_pylist()]
    facts = np.concatenate([np.frombuffer(unpress(f), kind) for f in table.column("facts").to_pylist()])
    hashes = np.concatenate(parts)
    order = np.argsort(hashes, kind="stable")
    new = np.concatenate(([True], hashes[order][1:] != hashes[order][:-1]))
    run = np.empty(len(hashes), np.int64)
    run[order] = np.cumsum(new) - 1
    return [len(p) for p in parts], facts, order, np.flatnonzero(new), run


def _answers(table: pa.Table, sizes: list[int], bits: np.ndarray, facts: list[bytes]) -> pa.Table:
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    return pa.table(
        {
            "block": table.column("block").cast(pa.int32()),
            "bucket": table.column("bucket").cast(pa.int32()),
            "n": pa.array(sizes, pa.int32()),
            "bits": pa.array([pack_bits(bits[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
            "facts": pa.array(facts, pa.binary()),
        }
    )


def parse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 13, anchor: int = 5, block_bytes: int = BLOCK_BYTES, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """Relative Lempel-Ziv factors of every document and the text that is left.

    Returns doc_id, n_words, n_removed, factors (start and end word, source: the
    document copied) and kept_text (kept words joined by one space).  A word
    goes if it lies in ``window`` consecutive words that also stand in a document with a smaller doc_id.

    Null, empty and short texts have no phrases and lose nothing.  Rows with a null doc_id
    lose nothing and are no source.  Rows with equal doc_ids are no sources for each
    other.  An empty table gives an empty result; further columns are not read.  Phrases are
    compared by 64-bit hashes.
    """
    rows, size = text_size(docs, text_col)
    n_blocks = max(1, -(-size // block_bytes))
    words = size / 6
    few, many = power_of_two(words / 5 / bucket_entries), power_of_two(words / bucket_entries)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    blocks = source.withColumn("block", block_of(n_blocks, "doc_id", "text"))

    def ask_anchors(key: tuple, table: pa.Table) -> pa.Table:
        hashes, twice = Block(table, window, anchor).anchors()
        return _requests(key[0].as_py(), hashes, twice.astype(np.uint8), few)

    def answer_anchors(table: pa.Table) -> pa.Table:
        sizes, twice, order, first, run = _merged(table, np.uint8)
        ends = np.append(first[1:], len(order))
        repeated = (ends - first > 1) | np.maximum.reduceat(twice[order], first).astype(bool)
        return _answers(table, sizes, repeated[run], [b""] * len(sizes))

    def ask_phrases(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        _, hashes, least = Block(table, window, anchor).phrases(answers)
        return _requests(key[0].as_py(), hashes, least, many)

    def answer_phrases(table: pa.Table) -> pa.Table:
        sizes, least, order, first, run = _merged(table, PLACE)
        by_place = np.lexsort((*keys_of(least), run))  # the first place of every run of equal hashes
        source_of = least[by_place[first]][run]
        earlier = source_of["doc"] < least["doc"]
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        press = zstandard.ZstdCompressor(level=1).compress
        facts = [press(source_of[a:b][earlier[a:b]].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return _answers(table, sizes, earlier, facts)

    def factor(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table, window, anchor)
        first_round = answers.filter(pa.compute.equal(answers.column("round"), 1))
        second = answers.filter(pa.compute.equal(answers.column("round"), 2)).sort_by("bucket")
        at, hashes, least = block.phrases(first_round)
        earlier = _answered(second, len(hashes))
        unpress = zstandard.ZstdDecompressor().decompress
        sources = least.copy()
        if earlier.any():
            sources[earlier] = np.concatenate([np.frombuffer(unpress(f), PLACE) for f in second.column("facts").to_pylist()])
        owner = block.owner[at]
        source_of = sources[np.searchsorted(hashes, block.phrase[at])] if len(at) else np.zeros(0, PLACE)
        hit = source_of["doc"] < block.id_of[owner]
        start, owner, source_of = block.place["at"][at][hit].astype(np.int64), owner[hit], source_of[hit]
        keep = np.ones(int(block.starts[-1]), bool)
        factors: list[list[dict]] = [[] for _ in block.ids]
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, int)
        for a, z in zip(first.tolist(), np.append(first[1:], len(owner)).tolist(), strict=False):
            d = int(owner[a])
            base = int(block.starts[d])
            for begin, end, source in factors_of(start[a:z], source_of[a:z], window):
                keep[base + begin : base + end] = False
                factors[d].append({"start": begin, "end": end, "source": source})
        kept, removed = [], []
        for words_, a, z in zip(block.words, block.starts[:-1].tolist(), block.starts[1:].tolist(), strict=True):
            mine = keep[a:z]
            removed.append(int(z - a - mine.sum()))
            kept.append(b" ".join(words_ if not removed[-1] else [words_[i] for i in np.flatnonzero(mine).tolist()]).decode("utf-8", "replace"))
        struct = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("source", pa.int64())])
        return pa.table({"doc_id": pa.array(block.ids, pa.int64()), "n_words": pa.array([len(w) for w in block.words], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "factors": pa.array(factors, pa.list_(struct)), "kept_text": pa.array(kept, pa.string())})

    dealt = blocks.groupBy("block")
    first = dealt.applyInArrow(ask_anchors, REQUEST).groupBy("bucket").applyInArrow(answer_anchors, ANSWER)
    second = dealt.cogroup(first.groupBy("block")).applyInArrow(ask_phrases, REQUEST).groupBy("bucket").applyInArrow(answer_phrases, ANSWER)
    both = first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))
    return dealt.cogroup(both.groupBy("block")).applyInArrow(factor, RESULT)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 13-word relative Lempel-Ziv factors leave of all documents."""
    parsed = parse(documents(spark, sf_dir), window=13)
    return parsed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), F.size("factors").cast("long").alias("n_factors"))
