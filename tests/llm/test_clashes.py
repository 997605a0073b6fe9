"""Columns whose names the operators use themselves: a result column wins over a carried one, others come along."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import html_extract, language_id, mixing, packing, quality_model, quality_rules, token_files
from ledgerline.llm.common import new_path

USED = ("id", "text_", "__text", "__t", "__c0", "score", "kept", "ids", "size", "rank", "lang_pred", "sequence_id", "start", "length", "b.l")


@pytest.fixture(scope="module")
def crowded(docs):
    return docs.withColumns({c: F.lit(f"own {c}") for c in USED})


CARRY = ("doc_id", "text", "__text", "__t", "__c0", "score", "kept", "b.l")


def test_judge(crowded):
    out = quality_rules.judge(crowded, carry=CARRY)
    assert out.columns[:7] == ["doc_id", "text", "__text", "__t", "__c0", "score", "b.l"] and out.columns.count("kept") == 1
    assert {r["__t"] for r in out.collect()} == {"own __t"}


def test_quality_score(crowded, spark):
    labels = crowded.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    out = quality_model.score(crowded, quality_model.train(crowded, labels), carry=CARRY)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "__text", "__t", "__c0", "kept", "b.l", "score", "predicted"]
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) == crowded.count()


def test_language(crowded):
    out = language_id.identify(crowded, language_id.train(crowded), carry=CARRY)
    assert out.columns == ["doc_id", "text", "__text", "__t", "__c0", "kept", "b.l", "lang_pred", "score"]
    assert len(out.collect()) == crowded.count()


def test_extract(spark):
    pages = spark.createDataFrame([(1, "<p>One, two", "x", 5)], "page_id long, html string, text string, n_chars int")
    out = html_extract.extract(pages, carry=("page_id", "html", "text", "n_chars"))
    assert [tuple(r) for r in out.collect()] == [(1, "<p>One, two", "One, two", 8)]


def test_token_files_and_packing(crowded, spark, tokenizer):
    path = new_path(spark, "test-clash")
    token_files.write_token_files(crowded, path, tokenizer, 1, word_level=True)
    assert token_files.read_token_files(spark, path).count() == crowded.count()
    packed = packing.pack(crowded, tokenizer, 2, word_level=True)
    assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert packed.select("doc_id").distinct().count() == crowded.count()


def test_mixture(crowded):
    out = mixing.mixture(crowded)
    assert out.columns == crowded.columns and {r["size"] for r in out.collect()} == {"own size"}


def test_one_huge_text_and_a_repeated_id_in_the_fit(spark):
    """The features that come to the driver are bounded whatever the texts."""
    passages = quality_model.spaced(quality_model.features("word and more words " * 50_000))
    assert len(passages) == quality_model.FIT_PASSAGES
    rows = [(7, f"text {i} of it") for i in range(300)] + [(i, "plain words " * (i % 5 + 1)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality_model.train(docs, labels, sample_rows=20)
    assert quality_model.score(docs, model).count() == len(rows)


def test_languages_that_no_plane_parts():
    """Labels at random must not make the model diverge."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.abs(rng.standard_normal((400, 50))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = language_id._train_svm(x, np.where(rng.random(400) < 0.5, 1, -1).astype(np.float32))
    assert np.isfinite(w).all() and np.abs(w).max() < 1e3
