"""Language identification by compression with per-language zstandard dictionaries.

Each language has a raw-content dictionary: whole training texts, lower-cased, up to
``dictionary_bytes``.  A text is cut into pieces, every piece is compressed with every
dictionary, and the language with the smallest total wins.  A fast compressor decides clear cases;
where its margin is under ``clear_margin`` a careful one decides.  Every piece follows the dictionary's
own last bytes, which cost next to nothing to encode, so that short texts are still compressed
and not stored as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

PIECE_BYTES = 4096
LEAD_BYTES = 200
#: A margin is (second smallest - smallest) / second smallest.
CLEAR_MARGIN = 0.15
NARROW_MARGIN = 0.005
VERDICT = "struct<lang_pred: string, score: double, rejected: boolean>"


@dataclass(frozen=True)
class Model:
    """Languages with their dictionaries, most frequent in training first."""

    dictionaries: tuple[tuple[str, bytes], ...]


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id", *, texts_per_language: int = 400, dictionary_bytes: int = 1 << 17, most_languages: int = 256) -> Model:
    """A model from a bounded sample: ``texts_per_language`` texts and ``dictionary_bytes`` of them, of the ``most_languages`` most frequent languages.

    The sample is the rows with the smallest hash of ``order_col`` and text, whatever their order; rows
    with a null text or language are not used.  Training rows are counted over the whole table.
    """
    keyed = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(order_col).cast("string"), text_col).alias("h")).where("lang is not null and text is not null")
    counted = keyed.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    counts = counted.orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    texts: dict[str, list[tuple[int, bytes]]] = {r["lang"]: [] for r in counts}
    if counts:
        # hashes are spread evenly: this share of their range holds the wanted texts, and some more, of each language
        share = {r["lang"]: min(1.0, (texts_per_language + 8 * math.sqrt(texts_per_language) + 64) / r["texts"]) for r in counts}
        low = F.coalesce(*[F.when(F.col("lang") == lang, F.col("h") <= max(-(1 << 63), min((1 << 63) - 1, int(x * (1 << 64)) - (1 << 63)))) for lang, x in share.items()])
        for r in keyed.where(low).groupBy("lang", "h").agg(F.first(F.substring("text", 1, dictionary_bytes)).alias("text")).toLocalIterator():
            texts[r["lang"]].append((r["h"], r["text"].lower().encode()))
    return Model(tuple((r["lang"], b"\n".join(t for _, t in sorted(texts[r["lang"]])[:texts_per_language])[:dictionary_bytes]) for r in counts))


class Coder:
    """Sizes of texts under one kind of compressor for every language."""

    def __init__(self, model: Model, careful: bool):
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.coders = []
        for _, data in model.dictionaries:
            held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            if careful:
                params = zstandard.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=17, strategy=zstandard.STRATEGY_BTLAZY2, min_match=3, search_log=5, **plain)
                coder = zstandard.ZstdCompressor(compression_params=params, dict_data=held)
            else:
                coder = zstandard.ZstdCompressor(level=3, dict_data=held, **plain)
            lead = data[-LEAD_BYTES:]
            self.coders.append((coder.compress, lead, len(coder.compress(lead))))

    def sizes(self, pieces: list[bytes]) -> list[int]:
        return [sum(len(compress(lead + p)) - base for p in pieces) for compress, lead, base in self.coders]


class Classifier:
    def __init__(self, model: Model):
        self.languages = [lang for lang, _ in model.dictionaries]
        self.fast, self.careful = Coder(model, careful=False), Coder(model, careful=True)

    def verdict(self, text: str | None, narrow_margin: float) -> tuple[str, float, bool]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        data = text.lower().encode()
        pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        best, margin = _choose(self.fast.sizes(pieces))
        if margin < CLEAR_MARGIN:
            best, margin = _choose(self.careful.sizes(pieces))
        return self.languages[best], margin, margin < narrow_margin


def _choose(sizes: list[int]) -> tuple[int, float]:
    """The smallest (of equals the language with more training rows) and its margin."""
    best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
    second = min((s for k, s in enumerate(sizes) if k != best), default=None)
    if second is None:
        return best, 1.0
    return best, min(1.0, max(0.0, (second - sizes[best]) / max(1, second)))


def verdicts(model: Model, text: Column, *, narrow_margin: float = NARROW_MARGIN) -> Column:
    """Column (lang_pred, score, rejected) for a text column.

    lang_pred is 'und' for a null text and one without a letter; score is the margin; rejected
    says 'und' or a margin under ``narrow_margin``.
    """

    @F.pandas_udf(VERDICT)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(model)
        for texts in batches:
            yield pd.DataFrame([classifier.verdict(t, narrow_margin) for t in texts], columns=["lang_pred", "score", "rejected"])

    return judge(text.cast("string"))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *, narrow_margin: float = NARROW_MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row of ``docs``.

    Repeated rows give repeated results, an empty table an empty one; a null doc_id stays
    null; a model without languages answers 'und'; further columns are not read.
    """
    judged = docs.select(F.col(id_col).cast("long").alias("doc_id"), verdicts(model, F.col(text_col), narrow_margin=narrow_margin).alias("v"))
    return judged.select("doc_id", "v.lang_pred", "v.score", "v.rejected")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those that are not held out."""
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
