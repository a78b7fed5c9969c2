"""The pipeline's stages, each on its own input."""

from __future__ import annotations

import corpus_pipeline as p

PASSAGE = "it was told that the river rose in the night and that people of the town went up the hill to wait for the day while water came in at every door"


def test_stages_keep_columns_and_clean_rows(spark, data):
    docs = p.documents(spark, data)
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and 0.5 * docs.count() < out.count() <= docs.count()


def test_odd_rows(spark, data):
    rows = [(1, PASSAGE), (2, PASSAGE), (3, PASSAGE + " again"), (4, None), (5, ""), (None, PASSAGE), (6, "other words stand here alone"), (6, "other words stand here alone")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", "z") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, verdict string, text_key string, pii string")
    kept = p.near_dedup(spark, docs, data).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 1), (False, 4), (False, 6), (True, 0)]
    assert p.language(spark, docs, data).where("text is null or text = ''").count() == 0
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), data).count() == 0
    assert p.personal_data(spark, docs, data).count() == len(rows)


def test_run(spark, data):
    out = p.run(spark, data)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() <= p.documents(spark, data).count()
