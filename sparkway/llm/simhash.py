"""SimHash near-duplicate detection over a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank (their position in the reflected Gray code), so
that neighbours share long bit patterns.  Runs of ``FANOUT`` neighbours form a node that
keeps the bits on which all of them agree (mask and pattern); runs of nodes form upper
nodes, whose masks are subsets.  A pair of nodes is dropped as soon as the agreed bits of
both differ in more than ``max_distance`` places: that count only grows on the way down.
A pair is also dropped when all its fingerprints are already in one component, which
keeps dense groups of near copies from being compared pair by pair.

Spread over the cluster: distinct fingerprints are routed by ``max_distance + 1`` bit
blocks (two fingerprints within the distance agree in one block at least).  A block value
that gathers more than ``group_limit`` fingerprints is split by a second block of the
remaining bits, and so on, so no group is capped and none is unbounded while
bits remain.  Each group yields a spanning forest of its links; components over all
groups come from alternating large-star / small-star rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, checkpointed, documents, joined, mix64, window_hashes

FANOUT = 8
ROWS_AT_ONCE = 1024
ROWS_A_PART = 25_000
PAIRS_AT_ONCE = 1 << 17


# -- fingerprints ---------------------------------------------------------------------


def simhash(text: bytes | None, shingle: int, seed: int) -> int:
    """Fingerprint of one text (already UTF-8; A-Z is lower-cased here)."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], seed) for a, b in spans], ">u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 60_000):  # bounded scratch space for very long texts
        bits = np.unpackbits(hashes[at : at + 60_000].view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, seed: int = 42) -> DataFrame:
    """(doc_id, fp): one signed 64-bit fingerprint for each row.

    Null and wordless texts have fingerprint 0; texts with fewer words than a shingle use
    the whole word sequence.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(t.as_py(), shingle, seed) for t in batch.column(1)], U64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return source.mapInArrow(run, "doc_id long, fp long")


# -- the index -------------------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code word in the reflected Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U64(shift))
    return x


class GrayIndex:
    """Gray-order hierarchy over fingerprints that fall into groups.

    ``group`` says which fingerprints may be compared; nodes never span two groups.
    """

    def __init__(self, group: np.ndarray, prints: np.ndarray):
        order = np.lexsort((gray_rank(prints), group))
        self.order, self.prints = order, prints[order]
        group = group[order]
        ones = np.full(len(group), ~U64(0))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # first child, pattern, mask
        self._add(np.arange(len(group)), self.prints, ones)
        while len(group) and np.any(group[1:] == group[:-1]):
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            at = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
            starts = np.flatnonzero(at % FANOUT == 0)
            _, pattern, mask = self.levels[-1]
            both = np.bitwise_and.reduceat(pattern, starts)
            either = np.bitwise_or.reduceat(pattern, starts)
            agreed = np.bitwise_and.reduceat(mask, starts) & ~(both ^ either)
            self._add(starts, both & agreed, agreed)
            group = group[starts]

    def _add(self, first: np.ndarray, pattern: np.ndarray, mask: np.ndarray) -> None:
        self.levels.append((first, pattern, mask))

    def _width(self, level: int) -> np.ndarray:
        first = self.levels[level][0]
        return np.diff(np.append(first, len(self.levels[level - 1][0])))

    def forest(self, max_distance: int) -> list[tuple[int, int]]:
        """A spanning forest of the links, as positions in the given arrays."""
        n = len(self.prints)
        parent = np.arange(n)
        edges: list[tuple[int, int]] = []
        if n < 2:
            return edges

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        stack = [(top, roots, roots)]
        low, high = self._components(parent)
        while stack:
            level, a, b = stack.pop()
            if len(a) > PAIRS_AT_ONCE:
                half = len(a) // 2
                stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            one = (low[level][a] == high[level][a]) & (low[level][b] == high[level][b]) & (low[level][a] == low[level][b])
            a, b = a[~one], b[~one]
            if level == 0:
                near = np.bitwise_count(self.prints[a] ^ self.prints[b]) <= max_distance
                joined = False
                for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
                    p, q = find(i), find(j)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        edges.append((int(self.order[i]), int(self.order[j])))
                        joined = True
                if joined:
                    low, high = self._components(parent)
                continue
            first, width = self.levels[level][0], self._width(level)
            count = width[a] * width[b]
            pair = np.repeat(np.arange(len(a)), count)
            inner = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
            c = first[a][pair] + inner // width[b][pair]
            d = first[b][pair] + inner % width[b][pair]
            _, pattern, mask = self.levels[level - 1]
            keep = c <= d if level > 1 else c < d
            keep &= np.bitwise_count((pattern[c] ^ pattern[d]) & mask[c] & mask[d]) <= max_distance
            if keep.any():
                stack.append((level - 1, c[keep], d[keep]))
        return edges

    def _components(self, parent: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Smallest and largest component under each node of each level."""
        root = parent
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        low, high = [root], [root]
        for first, _, _ in self.levels[1:]:
            low.append(np.minimum.reduceat(low[-1], first))
            high.append(np.maximum.reduceat(high[-1], first))
        return low, high


# -- links and components --------------------------------------------------------------


def _blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of ``parts`` bit ranges that cover ``bits`` bits."""
    cuts = [bits * k // parts for k in range(parts + 1)]
    return [(cuts[k], cuts[k + 1] - cuts[k]) for k in range(parts)]


def _field(col, shift: int, width: int):
    return F.shiftrightunsigned(col, shift).bitwiseAND(F.lit((1 << width) - 1))


def routed(prints: DataFrame, max_distance: int, group_limit: int) -> DataFrame:
    """(key, space, fp): every two fingerprints of one space within the distance share a key.

    ``rest`` holds the bits that no key has used yet, moved to its low end; a key with more than
    ``group_limit`` fingerprints is replaced by one key for each block of those bits.
    """
    parts, left = max_distance + 1, 64
    level = prints.select("fp", "space", F.col("space").cast("string").alias("key"), F.col("fp").alias("rest"))
    done = None
    while True:
        blocks = _blocks(left, parts)

        def cut(k: int, shift: int, size: int, left: int = left) -> F.Column:
            # a wide block keeps its top bits in "rest" too, so that all blocks leave as many bits
            upper = F.shiftrightunsigned("rest", shift + size) if shift + size < 64 else F.lit(0).cast("long")
            lower = _field(F.col("rest"), 0, shift) if shift else F.lit(0).cast("long")
            value = _field(F.col("rest"), shift, size)
            return F.struct(
                F.concat_ws("/", "key", F.lit(f"{k}"), F.hex(value)).alias("key"),
                F.shiftleft(upper, shift).bitwiseOR(lower).alias("rest"),
            )

        level = level.select("fp", "space", F.inline(F.array(*[cut(k, s, w) for k, (s, w) in enumerate(blocks)])))
        left -= min(w for _, w in blocks)
        if left < parts * 2:
            return level.select("key", "space", "fp") if done is None else done.unionByName(level.select("key", "space", "fp"))
        heavy = checkpointed(level.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_limit).select("key"))
        if heavy.isEmpty():
            return level.select("key", "space", "fp") if done is None else done.unionByName(level.select("key", "space", "fp"))
        light = level.join(heavy, "key", "left_anti").select("key", "space", "fp")
        done = light if done is None else done.unionByName(light)
        level = level.join(heavy, "key", "left_semi").select("fp", "space", "key", "rest")


def links(prints: DataFrame, *, max_distance: int = 3, group_limit: int = 20_000) -> DataFrame:
    """(space, a, b): links whose components are those of all pairs of one space within the distance.

    ``prints`` has distinct (space, fp).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[pa.Array] = []
        prints_: list[np.ndarray] = []
        spaces: list[np.ndarray] = []
        rows = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal keys, prints_, spaces, rows
            if not rows:
                return
            key = pa.concat_arrays(keys).dictionary_encode()
            code = np.asarray(key.indices)
            fp, space = np.concatenate(prints_), np.concatenate(spaces)
            cut = len(code) if last else int(np.flatnonzero(code != code[-1])[-1] + 1) if np.any(code != code[-1]) else 0
            if cut:
                edges = GrayIndex(code[:cut], fp[:cut].view(U64)).forest(max_distance)
                if edges:
                    i, j = np.array(edges).T
                    yield pa.RecordBatch.from_arrays([pa.array(space[i]), pa.array(fp[i]), pa.array(fp[j])], ["space", "a", "b"])
            rest = slice(cut, None)
            keys, prints_, spaces, rows = ([], [], [], 0) if cut == len(code) else ([pa.concat_arrays(keys)[rest]], [fp[rest]], [space[rest]], len(code) - cut)

        for batch in batches:
            if batch.num_rows:
                keys.append(batch.column(0))
                spaces.append(np.asarray(batch.column(1)))
                prints_.append(np.asarray(batch.column(2)))
                rows += batch.num_rows
                if rows >= 200_000:
                    yield from flush(False)
        yield from flush(True)

    dealt = routed(prints.select("fp", "space"), max_distance, group_limit)
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "space int, a long, b long")


def components(edges: DataFrame, parts: int = 1 << 30) -> DataFrame:
    """(node, root): root is the smallest node of each node's component; only nodes with an edge.

    Alternating large-star and small-star rounds; each round's edges are checkpointed,
    and rounds end when the edges stay the same (then every edge joins a node to its root).  ``parts``: partitions that
    edges are held in at most between shuffles.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").coalesce(parts).distinct().coalesce(parts))
    before = None
    while True:
        count = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if (count["n"], count["h"]) == before or not count["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = (count["n"], count["h"])
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").coalesce(parts).distinct().coalesce(parts)
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = checkpointed(
            large.join(small, "a")
            .select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))))
            .where("a <> b")
            .coalesce(parts)
            .distinct()
            .coalesce(parts)
        )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, seed: int = 42, max_distance: int = 3, group_limit: int = 20_000) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``.

    component_id is the smallest doc_id reachable over links (fingerprints that differ in at
    most ``max_distance`` bits).  Null texts and texts without words have fingerprint 0 and link
    like others; repeated rows give repeated results; a null doc_id takes part but never names a
    component while another id is there; an empty table gives an empty result; further columns
    of ``docs`` are not read.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col, shingle=shingle, seed=seed))
    owners = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(owners.withColumn("space", F.lit(0)), max_distance=max_distance, group_limit=group_limit))
    named = owners.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = named.join(first, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


# -- near copies by similarity ------------------------------------------------------------


def word_prints(words: list[bytes], spaces: int) -> list[int]:
    """Fingerprints of the distinct words, one for each space (a hash function of its own)."""
    distinct = set(words)
    if not distinct:
        return [0] * spaces
    base = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), U64, len(distinct))
    out = []
    for space in range(spaces):
        hashes = mix64(base + U64(space * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).astype(">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        out.append(int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(base)).tobytes(), "big"))
    return out


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles (A-Z lower-cased); fewer words than a shingle are one shingle."""
    return shingles_of(text.lower().split() if text else [], shingle)


def shingles_of(words: list[bytes], shingle: int) -> np.ndarray:
    flat = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))
    return np.unique(window_hashes(flat, min(shingle, len(flat)))) if len(flat) else np.zeros(1, U64)


def head_size(n: int, least: float) -> int:
    """Of two sets in one order with a Jaccard similarity of at least ``least``, these first elements have one in common."""
    return n - math.ceil(least * n - 1e-9) + 1


class Near:
    """Classes of near texts among those of one task, asked by prefix filter.

    Two sets with a Jaccard similarity of at least ``least`` share hashes among the smallest ones of each, the first
    size - ceil(least * size) + 1 of the sorted set: as many as both need less what lies behind one of the heads.
    Candidates that share most come first, and those of a class that is joined already are left out.
    """

    AT_ONCE = 16

    def __init__(self, least: float, most: int):
        self.least = least
        self.sets: list[np.ndarray] = []
        self.sizes = np.zeros(most, np.int64)
        self.label = np.arange(most)
        self.postings: dict[int, list[int]] = {}

    def similar(self, mine: np.ndarray, others: list[int]) -> np.ndarray:
        """Of some sets, which are near to this one."""
        flat = np.concatenate([self.sets[j] for j in others])
        sizes = self.sizes[others]
        hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
        shared = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
        return shared / (len(mine) + sizes - shared) >= self.least

    def add(self, mine: np.ndarray) -> list[tuple[int, int]]:
        """Takes a set in; returns links (earlier, this one) that join it to the classes it is near to."""
        this, n, edges = len(self.sets), len(mine), []
        self.sets.append(mine)
        self.sizes[this] = n
        head = mine[: head_size(n, self.least)].tolist()
        lists = [self.postings[h] for h in head if h in self.postings]
        if lists:
            counts = np.bincount(np.fromiter(chain.from_iterable(lists), np.int64))
            met = np.flatnonzero(counts)
            sizes = self.sizes[met]
            need = np.ceil(self.least / (1 + self.least) * (n + sizes) - 1e-6)
            behind = np.maximum(n - len(head), np.ceil(self.least * sizes - 1e-9) - 1)
            met = met[(counts[met] >= need - behind) & (np.minimum(n, sizes) >= need)]
            met = met[np.argsort(-counts[met], kind="stable")]
            while len(met):
                some, met = met[: self.AT_ONCE], met[self.AT_ONCE :]
                for other in some[self.similar(mine, some)].tolist():
                    a, b = self.label[other], self.label[this]
                    if a != b:
                        edges.append((other, this))
                        known = self.label[: this + 1]
                        known[known == max(a, b)] = min(a, b)
                if edges:
                    met = met[self.label[met] != self.label[this]]
        for h in head:
            self.postings.setdefault(h, []).append(this)
        return edges


def sets_of(shingle: int):
    """Batches with the last column, a text, turned into its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, ROWS_AT_ONCE) for at in range(0, batch.num_rows, ROWS_AT_ONCE)):
                made = [shingle_set(t.as_py(), shingle).view(np.int64) for t in part.columns[-1]]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(made, pa.list_(pa.int64()))], [*part.schema.names[:-1], "shingles"])

    return run


def frequent_shingles(source: DataFrame, shingle: int, sample: int, hot: int, most_hot: int) -> np.ndarray:
    """Sorted hashes of the shingles found ``hot`` times in one of ``sample`` texts, the ``most_hot`` most frequent at most."""
    flat = source.where(F.pmod(F.xxhash64("text_key"), F.lit(sample)) == 0).select("text").mapInArrow(sets_of(shingle), "shingles array<long>")
    common = flat.select(F.explode("shingles").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= hot)
    return np.sort(np.array([r["h"] for r in common.orderBy(F.desc("n"), "h").limit(most_hot).select("h").toLocalIterator()], np.int64))


def signatures(source: DataFrame, shingle: int, least: float, spaces: int, frequent: np.ndarray) -> DataFrame:
    """(doc_id, text_key, size, n_rare, fps, heads): what candidates are found by, in one pass over the texts.

    size: distinct shingles; heads: the first ``head_size`` of them when frequent ones come last; n_rare: how many
    of those aren't frequent; fps: a fingerprint of the distinct words for each space.
    """
    sent = source.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = sent.value
        for batch in batches:
            for part in (batch.slice(at, ROWS_AT_ONCE) for at in range(0, batch.num_rows, ROWS_AT_ONCE)):
                sizes, rare, prints, heads = [], [], [], []
                for text in part.column(2):
                    words = (text.as_py() or b"").lower().split()
                    prints.append(np.array(word_prints(words, spaces), U64).view(np.int64))
                    mine = shingles_of(words, shingle).view(np.int64)
                    late = np.zeros(len(mine), bool)
                    if len(last):
                        late = last[np.minimum(np.searchsorted(last, mine), len(last) - 1)] == mine
                        mine = np.concatenate([mine[~late], mine[late]])
                    n = head_size(len(mine), least)
                    sizes.append(len(mine))
                    rare.append(min(n, len(mine) - int(late.sum())))
                    heads.append(mine[:n])
                made = [pa.array(sizes, pa.int32()), pa.array(rare, pa.int32()), pa.array(prints, pa.list_(pa.int64())), pa.array(heads, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], ["doc_id", "text_key", "size", "n_rare", "fps", "heads"])

    return source.mapInArrow(run, "doc_id long, text_key string, size int, n_rare int, fps array<long>, heads array<long>")


def fingerprint_groups(texts: DataFrame, max_distance: int, group_limit: int, parts: int) -> DataFrame:
    """(node, root): texts that hang together over close fingerprints of any space; only those that have a partner.

    texts: (node, fps).
    """
    placed = texts.select("node", F.posexplode("fps").alias("space", "fp"))
    owners = checkpointed(placed.groupBy("space", "fp").agg(F.min("node").alias("owner")).coalesce(parts))
    found = links(owners, max_distance=max_distance, group_limit=group_limit)
    between = found.join(owners.select("space", F.col("fp").alias("a"), F.col("owner").alias("x")), ["space", "a"]).join(owners.select("space", F.col("fp").alias("b"), F.col("owner").alias("y")), ["space", "b"])
    equal = placed.join(owners, ["space", "fp"]).where("node <> owner").select(F.col("node").alias("a"), F.col("owner").alias("b"))
    return with_roots(components(checkpointed(equal.unionByName(between.select(F.col("x").alias("a"), F.col("y").alias("b"))).coalesce(parts)), parts), parts)


def with_roots(grouped: DataFrame, parts: int) -> DataFrame:
    """(node, root) with a row for every root too."""
    return grouped.unionByName(grouped.select(F.col("root").alias("node"), "root")).coalesce(parts).distinct().coalesce(parts)


def near_within(groups: DataFrame, read, least: float, together: int, parts: int) -> DataFrame:
    """(a, b): near pairs whose components are those of all near pairs among the texts that meet in one task.

    groups: (node, root).  Small groups share tasks of about ``together`` texts; a larger group is dealt over several.
    read: adds the shingles to a table of nodes.
    """
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    sized = groups.join(sizes, "root")
    tasks = max(1, -(-groups.count() // together))
    small = F.concat_ws("/", F.lit("s"), F.pmod(F.xxhash64("root"), F.lit(tasks)))
    large = F.concat_ws("/", F.lit("l"), "root", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / together)))
    dealt = checkpointed(sized.select("node", F.when(F.col("n") > together, large).otherwise(small).alias("task")).coalesce(parts))
    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        nodes, shingles = table.column("node").to_pylist(), table.column("shingles").combine_chunks()
        flat, at = shingles.flatten().to_numpy().view(U64), np.concatenate(([0], np.cumsum(pa.compute.list_value_length(shingles).to_numpy())))
        index, edges = Near(least, len(nodes)), []
        for k in range(len(nodes)):
            edges += index.add(flat[at[k] : at[k + 1]])
        return pa.table({"a": pa.array([nodes[i] for i, _ in edges], pa.int64()), "b": pa.array([nodes[j] for _, j in edges], pa.int64())})

    return read(dealt).groupBy("task").applyInArrow(compare, "a long, b long")


def shared_heads(texts: DataFrame) -> DataFrame:
    """(h, node, size, n_heads): head shingles that several texts have.

    Only frequent shingles can be at the head of very many texts, so a count over equal shingles sees few rows
    of one; frequent ones need no count.
    """
    placed = texts.select("node", "size", "n_rare", F.size("heads").alias("n_heads"), F.posexplode("heads").alias("at", "h"))
    placed = placed.select("h", "node", "size", "n_heads", (F.col("at") >= F.col("n_rare")).alias("frequent"))
    rare = placed.where("NOT frequent").withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("m > 1")
    return rare.drop("m", "frequent").unionByName(placed.where("frequent").drop("frequent"))


def needed(size: str, other: str, least: float) -> Column:
    """Shingles that two texts of these sizes have in common at least: similarity >= least means least / (1 + least) of both together."""
    return F.ceil(F.lit(least / (1 + least)) * (F.col(size) + F.col(other)) - 1e-6)


def near_across(shared: DataFrame, roots: DataFrame, read, least: float, few: int, share: int, parts: int, rounds: int = 3) -> DataFrame:
    """(a, b): near pairs that join the classes in ``roots`` (node, root) to those of all near pairs.

    Prefix filter: with all shingles in one order, two near texts share at their heads what both together need, less
    what lies behind one of the heads.  So pairs are counted over the shingles they share, which leaves hardly a
    pair that only has a passage in common.

    A shingle at the head of more than ``few`` texts first links one text of each class to one of another, chosen anew for
    each shingle and in each of the ``rounds``, so that a large family of copies is one class before its texts are
    paired.
    """
    found = None
    for turn in range(rounds):
        luck = F.xxhash64("node", "h", F.lit(turn))
        rooted = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        by_class = rooted.groupBy("h", "root").agg(F.min(F.struct(luck, "node", "size")).alias("x"), F.count(F.lit(1)).alias("n"))
        firsts = by_class.groupBy("h").agg(F.min(F.struct(F.xxhash64("root", "h", F.lit(turn)), "root", "x")).alias("first"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes")).where((F.col("classes") > 1) & (F.col("n") > few))
        star = by_class.drop("n").join(firsts.select("h", F.col("first.root").alias("low"), F.col("first.x").alias("y")), "h").where("root <> low")
        star = star.where(F.least("x.size", "y.size") >= needed("x.size", "y.size", least))
        tried = checkpointed(star.select(F.col("x.node").alias("x"), F.col("y.node").alias("y")).coalesce(parts).distinct().coalesce(parts))
        if tried.isEmpty():
            break
        more = checkpointed(near_pairs(tried, read, least).coalesce(parts))
        if more.isEmpty():
            break
        found = more if found is None else found.unionByName(more)
        roots = moved_on(roots, more, parts)

    rooted = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("h", F.ceil(F.col("n") / share).alias("shares"))
    left_over = checkpointed(rooted.join(apart, "h"))
    side = lambda c: [F.col(k).alias(f"{c}_{k}") for k in ("node", "root", "size", "n_heads")]
    left = left_over.select("h", F.pmod(F.xxhash64("node"), "shares").alias("share"), *side("x"))
    right = left_over.select("h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), *side("y"))
    enough = needed("x_size", "y_size", least)
    met = (F.col("x_node") < F.col("y_node")) & (F.col("x_root") != F.col("y_root")) & (F.least("x_size", "y_size") >= enough)
    behind = F.greatest(F.col("x_size") - F.col("x_n_heads"), F.col("y_size") - F.col("y_n_heads"))
    counted = left.join(right, ["h", "share"]).where(met).groupBy("x_node", "y_node").agg(F.count(F.lit(1)).alias("n"), F.first(enough - behind).alias("least"))
    pairs = counted.where("n >= least").select(F.col("x_node").alias("x"), F.col("y_node").alias("y"))
    last = near_pairs(checkpointed(pairs), read, least)
    return last if found is None else found.unionByName(last)


def moved_on(roots: DataFrame, edges: DataFrame, parts: int) -> DataFrame:
    """(node, root) with the classes joined that ``edges`` (a, b) link."""
    end = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    between = edges.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    to = with_roots(components(checkpointed(between.coalesce(parts)), parts), parts)
    kept = roots.join(to.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return checkpointed(kept.unionByName(to).coalesce(parts).distinct().coalesce(parts))


def near_pairs(pairs: DataFrame, read, least: float) -> DataFrame:
    """(a, b): those of the pairs (x, y) that are near."""
    held = checkpointed(read(pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()))
    both = pairs.join(held.select(F.col("node").alias("x"), F.col("shingles").alias("p")), "x").join(held.select(F.col("node").alias("y"), F.col("shingles").alias("q")), "y")
    both = both.withColumn("common", F.size(F.array_intersect("p", "q")))
    return both.where(F.col("common") / (F.size("p") + F.size("q") - F.col("common")) >= least).select(F.col("x").alias("a"), F.col("y").alias("b"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, min_similarity: float = 0.8, spaces: int = 8, max_distance: int = 3, group_limit: int = 20_000, together: int = 1000, sample: int = 16, hot: int = 8, most_hot: int = 500_000, few: int = 50, share: int = 500) -> DataFrame:
    """(doc_id, text_key, kept_id, stays) for each row: its class of near copies, by the smallest doc_id in it.

    Texts are near when the Jaccard similarity of their ``shingle``-word shingles is at least ``min_similarity``; a class
    holds what hangs together over near pairs.  stays: the row has the class's smallest doc_id (of texts
    with one doc_id the one with the smallest text_key).

    Candidates are texts in one component over ``spaces`` fingerprints of their distinct words, each searched with
    the Gray-order index, and what these miss is found by an exact prefix filter over the shingles (``near_across``); similarity is
    exact, so no pair is missed.  Texts are read where they lie; only fingerprints, heads and the shingles of candidates
    are shuffled.  ``sample``, ``hot`` and ``most_hot`` say which shingles come last in the filter's order, ``together``, ``few`` and
    ``share`` how work is dealt: none of them changes the result.

    text_key: md5 of the text.  Null texts count as empty; texts without words are equal to each other;
    rows with a null doc_id are left out (nothing can be kept for them); repeated rows
    give repeated results; an empty table gives an empty result; further columns are not read.  Shingles and
    texts are told apart by 64-bit hashes.
    """
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).cast("string").cast("binary").alias("text"))
    rows = checkpointed(signatures(source, shingle, min_similarity, spaces, frequent_shingles(source, shingle, sample, hot, most_hot)))
    counted = rows.groupBy("text_key", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    # tables of a row or a few for each text; coalescing only lowers their partitions, so small ones don't lie in many files
    parts = max(1, -(-rows.count() // ROWS_A_PART))
    named = checkpointed(counted.groupBy("text_key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"), F.max("n").alias("repeats")).withColumn("node", F.xxhash64("text_key")).coalesce(parts))
    # one row of each text: those of texts that stand once, and the first of the others
    copied = joined(rows, named.where("n > 1").select("text_key", "id"), "text_key", "left")
    single = copied.where("id IS NULL OR id = doc_id").withColumn("node", F.xxhash64("text_key"))
    if not named.where("repeats > 1").isEmpty():
        single = single.dropDuplicates(["node"])
    texts = single.select("node", "size", "n_rare", "fps", "heads")
    keyed = named.select("node", F.col("id").alias("doc_id"), "text_key")

    def read(nodes: DataFrame) -> DataFrame:
        wanted = checkpointed(nodes.join(keyed, "node").coalesce(parts))
        found = joined(source, wanted, ["doc_id", "text_key"], "inner").select(*nodes.columns, "text")
        found = found.mapInArrow(sets_of(shingle), ", ".join(f"{n} {t}" for n, t in nodes.dtypes) + ", shingles array<long>")
        return found.dropDuplicates(["node"]) if repeated else found

    repeated = not named.where("repeats > 1").isEmpty()
    within = checkpointed(near_within(checkpointed(fingerprint_groups(checkpointed(texts.select("node", "fps")), max_distance, group_limit, parts)), read, min_similarity, together, parts).coalesce(parts))
    roots = with_roots(components(within, parts), parts)
    across = near_across(checkpointed(shared_heads(texts)), checkpointed(roots), read, min_similarity, few, share, parts)
    classes = with_roots(components(checkpointed(within.unionByName(across).coalesce(parts)), parts), parts)
    members = keyed.join(classes, "node")
    kept = members.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("kept"))
    # texts that others are equal or near to; all other rows stand for themselves
    moved = members.join(kept, "root").select("text_key", F.col("kept.doc_id").alias("kept_id"), F.col("kept.text_key").alias("kept_key"))
    moved = checkpointed(moved.unionByName(named.join(classes, "node", "left_anti").where("n > 1").select("text_key", F.col("id").alias("kept_id"), F.col("text_key").alias("kept_key"))).coalesce(parts))
    judged = joined(rows.select("doc_id", "text_key"), moved, "text_key", "left")
    stays = F.col("kept_id").isNull() | ((F.col("doc_id") == F.col("kept_id")) & (F.col("text_key") == F.col("kept_key")))
    return judged.select("doc_id", "text_key", F.coalesce("kept_id", "doc_id").alias("kept_id"), stays.alias("stays"))


def text_key(text_col: str) -> Column:
    """A digest that equal texts share (null counts as empty)."""
    return F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents: 3-word shingles, links at 3 bits or fewer."""
    found = near_duplicates(documents(spark, sf_dir), shingle=3, seed=42, max_distance=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
