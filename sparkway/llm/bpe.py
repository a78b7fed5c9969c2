"""BPE encoding and decoding with a public vocabulary, merged in batched numpy rounds.

The distinct words of a batch lie in one flat symbol array.  A round looks every adjacent
pair up by binary search over the sorted pair keys, takes each word's lowest rank,
merges all its occurrences at once (left to right where they overlap) and goes on with the words
that still have a known pair.  A word of more than LONG_WORD bytes would take a round for each of very many ranks; its places
wait ordered by rank instead, and only pairs beside a merge are looked up again.
"""

from __future__ import annotations

import bisect
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

ROWS_AT_ONCE = 512
CACHED_WORDS = 100_000
#: A word of more bytes is merged by itself.
LONG_WORD = 512
NO_RANK = np.iinfo(np.int64).max

# Texts of these letters alone are cut by the standard library, twice as fast; its classes are spelt
# out, as \s and \d differ between the two libraries elsewhere.
LATIN = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
NOT_LATIN = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")
LATIN_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^\x09-\x0d \x85\xa0{LATIN}0-9]+")
LATIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(extra), extra + 1
    return [letters[b] for b in range(256)]


class WordBpe:
    """A byte-level BPE vocabulary with word ends (lower case, white space dropped)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), merged[order]
        self.by_rank = (left, right, merged)
        self.listed: list[list[int]] | None = None
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + self.end] for c in letters], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern)
        self.latin = pattern == LATIN_PATTERN
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def _symbols(self, word: bytes) -> np.ndarray:
        raw = np.frombuffer(word, np.uint8)
        return np.append(self.inner[raw[:-1]], self.final[raw[-1]])

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """Token ids of the symbols of one long word.

        A word takes a round for each rank that it meets, which are very many in a long one.  Here its places wait ordered by rank and place, and
        only the pairs beside a merge are looked up again, by the same binary search.
        """
        if self.listed is None:
            self.listed = [a.tolist() for a in (self.keys, self.ranks, *self.by_rank)]
        keys, ranks, left, right, merged = self.listed
        pairs = (symbols[:-1] << 32) | symbols[1:]
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        places = np.flatnonzero(self.keys[at] == pairs)
        waiting = list(zip(self.ranks[at[places]].tolist(), places.tolist(), strict=True))
        heapq.heapify(waiting)
        n, held = len(symbols), symbols.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while waiting:
            rank, i = heapq.heappop(waiting)
            j = after[i]
            if j >= n or held[i] != left[rank] or held[j] != right[rank]:
                continue  # the pair is gone
            held[i], held[j] = merged[rank], -1
            after[i] = end = after[j]
            if end < n:
                before[end] = i
            for a, b in ((before[i], i), (i, end)):
                if a >= 0 and b < n:
                    pair = held[a] << 32 | held[b]
                    k = bisect.bisect_left(keys, pair)
                    if k < len(keys) and keys[k] == pair:
                        heapq.heappush(waiting, (ranks[k], a))
        found = np.array(held, np.int64)
        return found[found >= 0]

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each (non-empty) word."""
        if any(len(w) > LONG_WORD for w in words):
            few = [w for w in words if len(w) <= LONG_WORD]
            short = iter(self.merge(few) if few else ())
            return [next(short) if len(w) <= LONG_WORD else self._merge_long(self._symbols(w)) for w in words]
        lengths = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.final[raw[ends]]
        word = np.repeat(np.arange(len(words)), lengths)
        done: list[np.ndarray | None] = [None] * len(words)
        while len(symbols):
            keys = (symbols[:-1] << 32) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            rank = np.full(len(symbols), NO_RANK)  # a symbol's pair with the next one
            known = (self.keys[at] == keys) & (word[:-1] == word[1:])
            rank[:-1][known] = self.ranks[at[known]]
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            counts = np.diff(np.append(starts, len(word)))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), counts)
            over = lowest == NO_RANK
            if over.any():
                for a, n in zip(starts.tolist(), counts.tolist(), strict=True):
                    if over[a]:
                        done[word[a]] = symbols[a : a + n]
            hit = (rank == lowest) & ~over
            places = np.flatnonzero(hit)
            if len(places):
                run = np.concatenate(([True], np.diff(places) != 1))
                since = np.arange(len(places)) - np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))
                places = places[since % 2 == 0]
                symbols[places] = self.merged[at[places]]
            stay = ~over
            stay[places + 1] = False
            symbols, word = symbols[stay], word[stay]
        return done

    def pieces(self, text: str) -> list[str]:
        """The words of a text, special tokens as they are."""
        if self.specials is None or not any(t in text for t in self.special):
            return self._words(text)
        found: list[str] = []
        for part in self.specials.split(text):
            found += [part] if part in self.special else self._words(part)
        return found

    def _words(self, text: str) -> list[str]:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # the final-sigma rule of str.lower() looks at neighbours; lower case here goes letter by letter
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        if self.latin and NOT_LATIN.search(text) is None:
            return LATIN_SPLIT.findall(text)
        return self.split.findall(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(t) if t else [] for t in texts]
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        new = list({w for words in cut for w in words}.difference(self.known))
        self.known |= {t: np.array([i], "<u4").tobytes() for t, i in self.special.items()}
        new = [w for w in new if w not in self.special]
        if new:
            for w, ids in zip(new, self.merge([w.encode() for w in new]), strict=True):
                self.known[w] = ids.astype("<u4").tobytes()
        return [b"".join(map(self.known.__getitem__, words)) for words in cut]

    def decode(self, ids: bytes) -> str:
        """Token strings joined by one space, as a vocabulary without a decoder gives them."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def vocabulary(path: str) -> WordBpe:
    return WordBpe(path)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids): ids are little-endian unsigned 32-bit integers in one binary value.

    Null and empty texts have no tokens; repeated rows give repeated results; an empty table
    gives an empty result; a null doc_id stays null; further columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in _slices(batches):
            ids = bpe.encode(batch.column(1).to_pylist())
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return source.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, *, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of what ``encode`` returns; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in _slices(batches):
            texts = [bpe.decode(x or b"") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def coded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str) -> DataFrame:
    """What ``decode(encode(docs))`` returns, both in one pass, with one vocabulary a task; rows as in ``encode``."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in _slices(batches):
            ids = bpe.encode(batch.column(1).to_pylist())
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return source.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents, encoded and decoded."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return coded(documents(spark, sf_dir), path=path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
