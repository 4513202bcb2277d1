"""Null ids, null columns and columns of clashing names in every operator on documents."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandgraph.llm import chat, jaccard, langid, licences, packing, quality, secrets_crf, wordbpe, wrapper


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None, None, None, None, None), (1, "a b c d e f g h i j k", None, "x", 3), (1, "a b c d e f g h i j k", None, "x", 3)]
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("n_words", "token", "u", "_key", "n", "_doc", "share", "words", "lang_pred", "licence", "spans"):
        out = out.withColumn(name, F.lit("own"))
    return out


def test_every_operator_on_documents(spark, docs):
    bpe, word = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
    assert quality.assess(docs).where("kept").count() == 0
    assert sorted((r.n_shingles, r.component_id or -1) for r in jaccard.similar(docs).collect()) == [(0, -1), (9, 1), (9, 1)]
    assert licences.licences(docs).where("n_segments = 0").count() == 3
    assert wordbpe.digests(docs, word).agg(F.sum("n_tokens")).first()[0] == 22
    assert packing.pack(docs, bpe).agg(F.sum("length")).first()[0] == 1 + 2 * 12
    assert secrets_crf.scan(docs).count() == 3
    assert {r.lang_pred for r in langid.score(docs, None).collect()} == {"und"}


def test_every_filtering_stage_keeps_the_columns(spark, docs):
    for stage, left in ((quality.stage, 0), (langid.stage, 0), (jaccard.stage, 2), (secrets_crf.stage, 3)):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() == left, stage.__module__


def test_pages_and_messages_without_anything(spark):
    pages = spark.createDataFrame([(None, None, None), (1, None, "<p>x")], "page_id long, url string, html string").withColumn("host", F.lit(1))
    assert sorted(r.text for r in wrapper.extract(pages).collect()) == ["", "x"]
    messages = spark.createDataFrame([(None, None, None, None), (1, None, "user", "x")], "conv_id long, turn long, role string, text string")
    assert sorted(r.json for r in chat.link(messages, {}).collect()) == ['{"content":"x","role":"user"}', "{}"]
