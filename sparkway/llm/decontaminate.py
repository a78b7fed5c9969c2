"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names (capitalised inside a sentence) and units (after a
number) are replaced by typed placeholders, all else is lower-cased.  Windows of ``window``
template tokens of documents and benchmark items are hash-joined.  Windows that continue each
other on one diagonal (equal distance between document and item) form a chain; a chain of
``run`` tokens, or of nearly the whole of a shorter item, is a finding if its slots are
consistent: every value of the item always stands for one value of the document and the other way
round.  Where values collide (two of the item for one of the document, or the other way round), the chain is
split at the slots whose pair of values isn't the most frequent one of those that collide, and each part counts for
itself.  So a question that was only re-parameterised is caught, and a passage that merely
looks alike once its values are gone is not.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, checkpointed, documents, mix64, window_hashes

# Units, and number words.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec min h hr hrs ms hz khz mhz ghz w kw mw v a k c f pa bar j kj cal kcal b kb mb gb tb usd eur gbp dollar dollars euro euros cent cents percent degree degrees second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet gram grams kilogram kilograms liter liters litre litres pound pounds".split())
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())

TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?\n]")
PLAIN, NUMBER, TITLE, UNIT, END = range(5)
SLOT = {NUMBER: U64(11), TITLE: U64(13), UNIT: U64(17)}
CACHED_TOKENS = 200_000


class Codes(dict):
    """Token -> hash and kind in one integer, learned as tokens come."""

    def __missing__(self, token: str) -> int:
        if len(self) > CACHED_TOKENS:
            self.clear()
        lower = token.lower()
        if token in ".!?\n":
            kind = END
        elif token[0].isdigit() or lower in NUMBER_WORDS:
            kind = NUMBER
        elif lower in UNITS:
            kind = UNIT
        elif token[0].isupper() and token[1:] == lower[1:] and len(token) > 1:
            kind = TITLE
        else:
            kind = PLAIN
        code = xxhash.xxh3_64_intdigest(lower.encode()) >> 3 << 3 | kind
        self[token] = code
        return code


class Template:
    """Canonical tokens of one text: a hash for each, and where the slots are."""

    def __init__(self, text: str, codes: Codes):
        tokens = TOKEN.findall(text)
        code = np.fromiter(map(codes.__getitem__, tokens), U64, len(tokens))
        kind = (code & U64(7)).astype(np.int8)
        word = np.flatnonzero(kind != END)
        opens = np.ones(len(tokens), bool)  # a sentence starts at the first token and after an end
        opens[1:] = kind[:-1] == END
        self.tokens, self.at = tokens, word
        kind, opens = kind[word], opens[word]
        after_number = np.zeros(len(word), bool)
        after_number[1:] = kind[:-1] == NUMBER
        self.slot = (kind == NUMBER) | ((kind == TITLE) & ~opens) | ((kind == UNIT) & after_number)
        literal = code[word] >> U64(3)
        self.hash, self.valued = literal.copy(), literal
        for k, value in SLOT.items():
            self.hash[self.slot & (kind == k)] = value
        self.valued[self.slot] = mix64(literal[self.slot]) + self.hash[self.slot]

    def windows(self, size: int) -> np.ndarray:
        """Hash of each window; where most tokens are placeholders their values count, so that only verbatim copies are equal."""
        hashes, thin = window_hashes(self.hash, size), self.fixed(size) * 2 < size
        if thin.any():
            hashes[thin] = ~window_hashes(self.valued, size)[thin]
        return hashes

    def places(self, start: int, size: int) -> list[int]:
        """Where the placeholders of one window are."""
        return np.flatnonzero(self.slot[start : start + size]).tolist()

    def slots(self, start: int, size: int) -> list[str]:
        """Values of the placeholders of one window, lower-cased."""
        return [self.tokens[self.at[start + i]].lower() for i in self.places(start, size)]

    def fixed(self, size: int) -> np.ndarray:
        """For each window, how many of its tokens are not placeholders."""
        total = np.concatenate(([0], np.cumsum(~self.slot)))
        return total[size:] - total[:-size] if len(self.slot) >= size else np.zeros(0, int)


def consistent_part(start: int, n_tokens: int, slots: list) -> tuple[int, int, int, bool]:
    """(start, n_tokens, n_slots, verbatim) of the longest part of a chain between slots that collide.

    slots: (at, item value, document value), sorted.  A pair of values stays if it occurs more often than every pair that
    has one value in common with it.
    """
    pairs = Counter((a, b) for _, a, b in slots)
    of_item, of_doc = defaultdict(list), defaultdict(list)
    for (a, b), n in pairs.items():
        of_item[a].append(n)
        of_doc[b].append(n)
    # most frequent on both sides, and the only one that is
    leads = lambda n, counts: n == max(counts) and counts.count(n) == 1
    stays = {(a, b) for (a, b), n in pairs.items() if leads(n, of_item[a]) and leads(n, of_doc[b])}
    edges = [start - 1, *(at for at, a, b in slots if (a, b) not in stays), start + n_tokens]
    length, before = max((z - a - 1, -a - 1) for a, z in zip(edges, edges[1:], strict=False))
    inside = {(a, b) for at, a, b in slots if -before <= at < length - before}
    return -before, length, len(inside), all(a == b for a, b in inside)


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", *, window: int = 8, least_tokens: int = 4) -> DataFrame:
    """(size, hash, item_id, item_pos, item_tokens, item_at, item_slots) of all benchmark items.

    Items of fewer than ``window`` tokens have one window, the whole item; those of fewer than
    ``least_tokens`` say too little and have none.
    """
    source = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            rows: list[tuple] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                template = Template(text, codes)
                n = len(template.hash)
                if n < least_tokens:
                    continue
                size = min(window, n)
                hashes = template.windows(size).view(np.int64).tolist()
                rows += [(size, h, item, at, n, template.places(at, size), template.slots(at, size)) for at, h in enumerate(hashes)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["size", "hash", "item_id", "item_pos", "item_tokens", "item_at", "item_slots"])

    return source.mapInArrow(run, "size int, hash long, item_id long, item_pos long, item_tokens long, item_at array<int>, item_slots array<string>")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", *, window: int = 8, run: int = 13, most_windows: int = 2_000_000) -> DataFrame:
    """(doc_id, text_key, item_id, start, n_tokens, n_slots, verbatim): one row for each document and item found.

    start: first token of the longest chain or part of one; n_tokens: its length in template tokens; n_slots: values it
    holds; verbatim: all values are those of the item.  text_key: md5 of the text.

    A finding needs a chain of ``run`` tokens, or of all but the first token of an item with
    fewer.  Windows with more placeholders than other tokens count where they are verbatim.  Null and empty
    texts and items match nothing; repeated rows count once; a null doc_id or item_id stays
    null; an empty table gives an empty result; further columns are not read.  Up to ``most_windows``
    distinct item windows are sent to the scan as a filter; beyond that all windows are joined.
    """
    listed = checkpointed(item_windows(items, item_id_col, item_text_col, window=window))
    distinct = listed.select("size", "hash").distinct()
    few = distinct.limit(most_windows + 1).count() <= most_windows
    wanted: dict[int, np.ndarray] = {}
    if few:
        for row in distinct.groupBy("size").agg(F.sort_array(F.collect_list("hash")).alias("hashes")).toLocalIterator():
            wanted[row["size"]] = np.array(row["hashes"], np.int64)
    sizes = sorted(wanted) if few else sorted(r["size"] for r in listed.select("size").distinct().collect())
    filters = docs.sparkSession.sparkContext.broadcast(wanted)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, known = Codes(), filters.value
        for batch in batches:
            rows: list[tuple] = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                template, key = Template(body, codes), None
                for size in sizes:
                    hashes = template.windows(size).view(np.int64)
                    hits = np.arange(len(hashes))
                    if few:
                        place = np.minimum(np.searchsorted(known[size], hashes), len(known[size]) - 1)
                        hits = np.flatnonzero(known[size][place] == hashes)
                    key = key or (hashlib.md5(body.encode()).hexdigest() if len(hits) else None)
                    rows += [(doc, key, size, int(hashes[at]), at, template.slots(at, size)) for at in hits.tolist()]
                if len(rows) > 50_000:
                    yield _hits(rows)
                    rows = []
            yield _hits(rows)

    hits = source.mapInArrow(scan, "doc_id long, text_key string, size int, hash long, doc_pos long, doc_slots array<string>").distinct()
    pairs = hits.join(listed.distinct(), ["size", "hash"]).withColumn("diagonal", F.col("doc_pos") - F.col("item_pos"))
    group = ["doc_id", "text_key", "item_id", "item_tokens", "size", "diagonal"]
    order = Window.partitionBy(*group).orderBy("doc_pos")
    chained = pairs.withColumn("island", F.col("doc_pos") - F.row_number().over(order))
    # windows of an island follow each other: the first token of each, and the rest of the last one
    valued = F.transform(F.arrays_zip("item_at", "item_slots", "doc_slots"), lambda v: F.struct((F.col("doc_pos") + v["item_at"]).alias("at"), v["item_slots"].alias("item"), v["doc_slots"].alias("doc")))
    heads = F.collect_list(F.when(F.get("item_at", F.lit(0)) == 0, F.get("valued", F.lit(0))))
    slots = F.array_sort(F.array_distinct(F.concat(heads, F.max_by("valued", "doc_pos"))))
    chains = chained.withColumn("valued", valued).groupBy(*group, "island").agg(F.min("doc_pos").alias("start"), (F.count(F.lit(1)) + F.col("size") - 1).alias("n_tokens"), slots.alias("slots"))
    enough = F.least(F.lit(run), F.greatest(F.col("item_tokens") - 1, F.col("size")))
    values = F.array_distinct(F.transform("slots", lambda v: F.struct(v["item"].alias("item"), v["doc"].alias("doc"))))
    one_to_one = (F.size("values") == F.size(F.array_distinct("values.item"))) & (F.size("values") == F.size(F.array_distinct("values.doc")))
    long = chains.where(F.col("n_tokens") >= enough).withColumn("values", values).withColumn("whole", one_to_one)
    part = F.udf(lambda start, n, slots: None if slots is None else consistent_part(start, n, slots), "start long, n_tokens long, n_slots long, verbatim boolean")
    whole = F.struct("start", "n_tokens", F.size("values").cast("long").alias("n_slots"), F.forall("values", lambda v: v["item"] == v["doc"]).alias("verbatim"))
    found = long.withColumn("part", part("start", "n_tokens", F.when(~F.col("whole"), F.col("slots")))).withColumn("p", F.when(F.col("whole"), whole).otherwise(F.col("part")))
    found = found.select("doc_id", "text_key", "item_id", "item_tokens", "size", "p.*").where(F.col("n_tokens") >= enough)
    best = F.max(F.struct("n_tokens", (-F.col("start")).alias("before"), "n_slots", "verbatim")).alias("b")
    return found.groupBy("doc_id", "text_key", "item_id").agg(best).select("doc_id", "text_key", "item_id", (-F.col("b.before")).alias("start"), "b.n_tokens", "b.n_slots", "b.verbatim")


def _hits(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "text_key", "size", "hash", "doc_pos", "doc_slots"])


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, verbatim or re-parameterised, by document and item."""
    found = contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "start", "n_tokens", "n_slots", "verbatim")
