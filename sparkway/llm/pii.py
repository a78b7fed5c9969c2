"""Personal data: patterns, and information-theoretic sanitisation of what surrounds them.

Patterns find e-mail addresses, IP addresses, payment cards and phone numbers.  Words near a
match can still tell what was there.  The corpus says how strongly: with P(c) the share of all
words that stand near matches of kind c, and P(c|t) that share among the occurrences of term t,

    IC(c) = -ln P(c)        PMI(t; c) = ln (P(c|t) / P(c)).

A term discloses kind c when PMI(t; c) >= IC(c) / alpha (alpha >= 1; equality at 1 means that the
term always stands near the kind) and it was seen near at least ``min_values`` different
values.  The same rule holds with a single value (one address, one number) for c, so that a surname beside one
address counts, if ``min_texts`` different texts have the two together.  Disclosing terms near a match are generalised; those beyond the stricter ``alpha_remove`` are removed.
Counts cover the whole corpus.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, documents

# Kinds in their order, and what replaces them.
KINDS = ("email", "ip", "card", "phone", "term")
PLACEHOLDERS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]")
TERM = KINDS.index("term")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match that starts inside a run of digits could also start at its head, so only heads are tried
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]{2,}")
DIGIT = re.compile(r"[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, kind, end: sorts as results do


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def patterns(text: str) -> list[Span]:
    """Base matches of one text, sorted."""
    found: list[Span] = []
    last = 0
    at = text.find("@")
    while at >= 0:  # a local part holds no @, so each @ has one candidate, left to right
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            found.append((start, 0, last))
        at = text.find("@", at + 1)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = NOT_DIGITS.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(NOT_DIGITS.sub("", m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def contexts(text: str, spans: list[Span], near_words: int, near_chars: int) -> dict[tuple[int, int, int, int], str]:
    """(start, end, kind, hash of the value) -> term: the words near the matches.

    Near: the ``near_words`` words on either side that begin and end within ``near_chars`` characters, outside all matches.
    """
    found: dict[tuple[int, int, int, int], str] = {}
    starts = [s for s, _, _ in spans]
    reach = list(accumulate((end for _, _, end in spans), max))  # how far the spans up to here reach
    for start, kind, end in spans:
        value = xxhash.xxh3_64_intdigest(text[start:end]) >> 1
        low, high = max(0, start - near_chars), min(len(text), end + near_chars)
        before = [m for m in WORD.finditer(text, low, start)][-near_words:]
        after = [m for m, _ in zip(WORD.finditer(text, end, high), range(near_words), strict=False)]
        for m in [*before, *after]:
            a, z = m.span()
            # cut at an edge of the neighbourhood, or part of a match
            if (a == low and a and WORD.match(text[a - 1 : a] * 2)) or (z == high and z < len(text) and WORD.match(text[z : z + 1] * 2)) or ((k := bisect_left(starts, z)) and reach[k - 1] > a):
                continue
            found[a, z, kind, value] = m.group().lower()
    return found


def blanked(text: str, spans: list[Span]) -> str:
    """The text without what the matches cover."""
    parts, at = [], 0
    for start, _, end in spans:
        if start > at:
            parts.append(text[at:start])
        at = max(at, end)
    return " ".join([*parts, text[at:]])


def sanitised(text: str, spans: list[Span], removed: set[tuple[int, int]]) -> str:
    """The text with every span replaced; spans that overlap become one, named after the first."""
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], "" if (start, end) in removed else PLACEHOLDERS[kind]]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def disclosing_terms(docs: DataFrame, text_col: str = "text", *, alpha: float = 1.25, alpha_remove: float = 1.05, min_values: int = 3, min_texts: int = 3, near_words: int = 6, near_chars: int = 100, most_terms: int = 200_000) -> DataFrame:
    """(term, kind, value, remove): terms that disclose a kind (value null), or one value, near which they stand; from the whole corpus.

    ``most_terms`` bounds the set of candidates that is sent to the tasks that count; a larger
    set is counted by a join instead, with equal results.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: Counter = Counter()
            for text in batch.column(0).to_pylist():
                spans = patterns(text)
                if spans:
                    own = xxhash.xxh3_64_intdigest(text) >> 1
                    rows.update((term, key[2], key[3], own) for key, term in contexts(text, spans, near_words, near_chars).items())
            term, kind, value, own = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(kind, pa.int32()), pa.array(value, pa.int64()), pa.array(own, pa.int64()), pa.array(rows.values(), pa.int64())], ["term", "kind", "value", "own", "n"])

    texts = _texts(docs, text_col)
    by_text = texts.mapInArrow(near, "term string, kind int, value long, own long, n long").groupBy("term", "kind", "value", "own").agg(F.sum("n").alias("n"))
    by_value = checkpointed(by_text.groupBy("term", "kind", "value").agg(F.sum("n").alias("near"), F.count(F.lit(1)).alias("texts")))
    by_kind = by_value.groupBy("term", "kind").agg(F.sum("near").alias("near"), F.count(F.lit(1)).alias("n_values"))
    wide = by_kind.where(F.col("n_values") >= min_values).select("term", "kind", F.lit(None).cast("long").alias("value"), "near")
    candidates = checkpointed(wide.unionByName(by_value.where(F.col("texts") >= min_texts).select("term", "kind", "value", "near")))
    terms = candidates.select("term").distinct()
    few = terms.limit(most_terms + 1).count() <= most_terms
    wanted = frozenset(r["term"] for r in terms.toLocalIterator()) if few else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal counts, total
            terms = [None, *counts]
            out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([total, *counts.values()], pa.int64())], ["term", "n"])
            counts, total = Counter(), 0
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                spans = patterns(text)
                words = WORD.findall(blanked(text, spans) if spans else text)
                total += len(words)
                lower = map(str.lower, words)
                counts.update(lower if wanted is None else filter(wanted.__contains__, lower))
            if len(counts) > 200_000:
                yield flush()
        yield flush()

    counted = checkpointed(texts.mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")))
    total = float(counted.where("term is null").agg(F.sum("n")).first()[0] or 0)
    # words near matches of a kind (value null), and near one value
    whole = by_value.groupBy("kind").agg(F.sum("near").alias("all_near")).withColumn("value", F.lit(None).cast("long"))
    single = by_value.groupBy("kind", "value").agg(F.sum("near").alias("all_near"))
    shares = whole.unionByName(single.select(*whole.columns))
    c = shares.select(F.col("kind").alias("c_kind"), F.col("value").alias("c_value"), "all_near")
    scored = candidates.join(counted, "term").join(c, (F.col("kind") == F.col("c_kind")) & F.col("value").eqNullSafe(F.col("c_value")))
    # a share of 1 (every word near a match) carries no information and discloses nothing
    scored = scored.where(F.col("all_near") < total).withColumn("ic", -F.log(F.col("all_near") / F.lit(total)))
    scored = scored.withColumn("pmi", F.log(F.least(F.col("near") / F.col("n"), F.lit(1.0))) + F.col("ic"))
    return scored.where(F.col("pmi") >= F.col("ic") / alpha - 1e-12).select("term", "kind", "value", (F.col("pmi") >= F.col("ic") / alpha_remove - 1e-12).alias("remove"))


RESULT = "struct<spans: array<struct<kind: string, start: long, end: long>>, clean_text: string>"


def sanitise(docs: DataFrame, text_col: str = "text", *, near_words: int = 6, near_chars: int = 100, most_terms: int = 200_000, into: str = "pii", **thresholds) -> DataFrame:
    """``docs`` with one more column ``into``: (spans, clean_text).

    spans: base matches and disclosing terms near them, as code points (end exclusive), sorted by
    start, then kind.  clean_text: the text with matches and generalised terms replaced and
    removed terms left out.  Near means ``near_words`` words and ``near_chars`` characters on either side: what stands further
    away is neither counted nor replaced.  Up to ``most_terms`` disclosing terms are sent to the tasks; more of them are joined to the
    texts that hold them, with equal results.

    Null texts count as empty and stay null in clean_text; repeated rows give repeated results; an
    empty table gives an empty result; other columns, whatever their names, pass unchanged.
    """
    terms = checkpointed(disclosing_terms(docs, text_col, near_words=near_words, near_chars=near_chars, most_terms=most_terms, **thresholds))
    few = terms.limit(most_terms + 1).count() <= most_terms
    table = {(r["term"], r["kind"], r["value"]): r["remove"] for r in terms.toLocalIterator()} if few else {}
    broadcast = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf(RESULT)
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = broadcast.value
        for texts in batches:
            yield pd.DataFrame([_clean(t, known, near_words, near_chars) for t in texts], columns=["spans", "clean_text"])

    if few:
        return docs.withColumn(into, clean(F.col(text_col).cast("string")))

    @F.pandas_udf(RESULT)
    def clean_by(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, own in batches:
            # numbers travel as text: beside a null they would come as floats
            known = [{} if k is None else {(x["term"], int(x["kind"]), None if x["value"] is None else int(x["value"])): x["remove"] for x in map(dict, k)} for k in own]
            yield pd.DataFrame([_clean(t, k, near_words, near_chars) for t, k in zip(texts, known, strict=True)], columns=["spans", "clean_text"])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = patterns(text)
                near = {(term, at[2], at[3]) for at, term in contexts(text, spans, near_words, near_chars).items()} if spans else ()
                rows += [(key, *x) for x in near]
            key, term, kind, value = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(term, pa.string()), pa.array(kind, pa.int32()), pa.array(value, pa.int64())], ["own_key", "term", "kind", "own_value"])

    key = F.md5(F.col(text_col).cast("string").cast("binary"))
    keyed = docs.select(key.alias("own_key"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    places = keyed.mapInArrow(held, "own_key string, term string, kind int, own_value long").distinct()
    met = places.join(terms, ["term", "kind"]).where(F.col("value").isNull() | (F.col("value") == F.col("own_value")))
    lists = met.groupBy("own_key").agg(F.collect_set(F.struct("term", F.col("kind").cast("string").alias("kind"), F.col("value").cast("string").alias("value"), "remove")).alias("own_terms"))
    own, own_key = _free(docs, "own_terms"), _free(docs, "own_key")
    joined = docs.withColumn(own_key, key).join(lists.select(F.col("own_key").alias(own_key), F.col("own_terms").alias(own)), own_key, "left")
    return joined.select(*[F.col(f"`{x}`") for x in docs.columns], clean_by(F.col(text_col).cast("string"), F.col(own)).alias(into))


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _clean(text: str | None, known: dict[tuple[str, int, int | None], bool], near_words: int, near_chars: int) -> tuple[list[dict], str | None]:
    spans = patterns(text) if text else []
    if not spans:
        return [], text
    removed: set[tuple[int, int]] = set()
    more: set[Span] = set()
    if known:
        for (start, end, kind, value), term in contexts(text, spans, near_words, near_chars).items():
            rules = [x for x in (known.get((term, kind, None)), known.get((term, kind, value))) if x is not None]
            if rules:
                more.add((start, TERM, end))
                if any(rules):
                    removed.add((start, end))
    every = sorted([*spans, *more])
    return [{"kind": KINDS[kind], "start": start, "end": end} for start, kind, end in every], sanitised(text, every, removed)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents, and the terms around it that disclose it."""
    found = sanitise(documents(spark, sf_dir).select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("pii.spans").alias("spans"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "term")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[number(k) for k in KINDS[:4]], F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
