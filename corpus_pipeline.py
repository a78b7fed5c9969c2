"""A corpus pipeline: language, near copies, benchmark leaks, personal data, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; stages are applied in order, each to
what the one before has kept, written as Parquet in between.  All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkway.llm import bpe, decontaminate, langid, pii, simhash
from sparkway.llm.common import checkpointed, documents, joined, shared_folder, small_batches

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is certain: no 'und', no narrow margin.

    The model is learned from ``docs`` that are not held out.  Null texts and texts without a letter go.
    """
    small_batches(spark)
    model = langid.train(docs.where(~langid.held_out()))
    verdict = _fresh(docs, "verdict")
    judged = docs.withColumn(verdict, langid.verdicts(model, F.col("text")))
    return judged.where(~F.col(f"{verdict}.rejected")).select(*_own(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of equal or near texts, the one with the smallest doc_id.

    Repeated rows of a kept document become one.  Rows with a null doc_id stay.  Texts stay where they lie: only
    the keys of rows that go are sent or shuffled.
    """
    small_batches(spark)
    judged = checkpointed(simhash.near_copies(docs, shingle=5, min_similarity=0.8))
    gone = checkpointed(judged.where("NOT stays").select("doc_id", "text_key").distinct())
    again = checkpointed(judged.where("stays").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    left = _keyed(docs, gone, "left_anti")
    if not again.isEmpty():
        key = _fresh(docs, "text_key")
        twice = _keyed(left, again, "left_semi").withColumn(key, simhash.text_key("text")).dropDuplicates(["doc_id", key])
        left = _keyed(left, again, "left_anti").unionByName(twice.select(*_own(docs)))
    return left


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, verbatim or re-parameterised.

    Texts are judged, so rows with a null doc_id and repeated rows are too; null and empty texts hold nothing and stay; an
    empty table stays empty.
    """
    small_batches(spark)
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _keyed(docs, checkpointed(found.select("doc_id", "text_key").distinct()), "left_anti")


def _keyed(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi- or anti-join of documents with (doc_id, text_key); a null doc_id equals another."""
    sent = keys.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("_doc_key"), F.col("text_key").alias("_text_key"))
    doc_key, text_key = _fresh(docs, "doc_key"), _fresh(docs, "text_key")
    keyed = docs.withColumns({doc_key: F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text_key: simhash.text_key("text")})
    return joined(keyed, sent, (F.col(doc_key) == F.col("_doc_key")) & (F.col(text_key) == F.col("_text_key")), how).select(*_own(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and terms that disclose it, in the text; n_chars follows.  No document goes."""
    small_batches(spark)
    into = _fresh(docs, "pii")
    clean = pii.sanitise(docs, into=into)
    text = F.col(f"{into}.clean_text")
    changed = {"text": text.cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size(f"{into}.spans") > 0, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return clean.withColumns(changed).select(*_own(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and digests of ids and decoded text.  Null and empty texts have no tokens."""
    small_batches(spark)
    return bpe.coded(docs, path=VOCABULARY).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: Compression, fingerprints and merges are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what lies between them is written to the shared folder."""
    docs = documents(spark, sf_dir)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
