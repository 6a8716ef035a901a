"""Ids come back as they went in: null, beyond 2**53, the largest, negative and repeated ones in one batch."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from dealforge.llm import debruijn_dedup, decontaminate, jaccard_join, kneser_ney, language_id, line_dedup, sentencepiece_codec, simhash_dedup, suffix_dedup, token_alignment, warc

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BIG = 2**53
IDS = [None, BIG, BIG + 1, BIG + 3, 2**63 - 1, -(2**63), -(BIG + 1), 5, 5]
SENTENCE = "the quick brown fox number {} jumps over every lazy dog that sleeps beside the river in summer"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, SENTENCE.format(n), "en", "src", 90) for n, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def ids(df, name="doc_id"):
    return sorted((r[0] for r in df.select(name).collect()), key=str)


EVERY = sorted(IDS, key=str)
KNOWN = sorted((i for i in IDS if i is not None), key=str)


@pytest.mark.parametrize(
    "run,want",
    [
        (lambda d: jaccard_join.linked_components(d), KNOWN),
        (lambda d: line_dedup.deduplicate(d), EVERY),
        (lambda d: suffix_dedup.digests(d), EVERY),
        (lambda d: suffix_dedup.deduplicate(d), EVERY),
        (lambda d: kneser_ney.held_out_scores(d), EVERY),
        (lambda d: debruijn_dedup.digests(d), EVERY),
        (lambda d: debruijn_dedup.deduplicate(d, k=50), EVERY),
        (lambda d: language_id.identify_documents(d, language_id.fit(d)), EVERY),
        (lambda d: sentencepiece_codec.roundtrip_digests(d, B), EVERY),
        (lambda d: sentencepiece_codec.encode(d, B), EVERY),
        (lambda d: sentencepiece_codec.decode(sentencepiece_codec.encode(d, B), B), EVERY),
        (lambda d: sentencepiece_codec.encode_and_decode(d, B, keep=("doc_id", "lang", "n_chars")), EVERY),
        (lambda d: token_alignment.alignment_digests(d, A, B), EVERY),
        (lambda d: simhash_dedup.linked_components(d), KNOWN),
    ],
    ids=["jaccard", "lines", "suffix", "suffix_text", "lm", "substring", "substring_text", "language", "pieces", "pieces_encode", "pieces_decode", "pieces_both", "alignment", "simhash"],
)
def test_operators(docs, run, want):
    out = run(docs)
    assert dict(out.dtypes)["doc_id"] == "bigint"
    assert ids(out) == want


def test_leaks_and_what_is_dropped(spark, docs):
    """The leak goes, its neighbours by number stay."""
    item = spark.createDataFrame([(BIG + 7, SENTENCE.format(2)), (3, SENTENCE.format(0))], "item_id long, text string")
    only = decontaminate.leaks(docs, item, rate=0.0)
    assert sorted(map(tuple, only.select("doc_id", "item_id").collect()), key=str) == sorted([(None, 3), (BIG + 1, BIG + 7)], key=str)
    left = decontaminate.decontaminate(docs, item, rate=0.0)
    assert ids(left) == sorted((i for i in IDS if i != BIG + 1), key=str)  # rows with a null id stay


def test_language_stage_drops_the_right_row(spark, docs):
    odd = spark.createDataFrame([(BIG + 5, "123 456", "en", "src", 7), (BIG + 4, SENTENCE.format(1), "en", "src", 90)], docs.schema)
    every = docs.unionByName(odd).coalesce(1)
    left = language_id.keep_identified(every, language_id.fit(every))
    assert ids(left) == sorted([*IDS, BIG + 4], key=str)


def test_archives(spark):
    page = "<html>" + "x" * 200
    rows = [(BIG + 1, "http://a/", page), (BIG + 3, "http://b/", page), (2**63 - 1, None, page), (-7, "http://c/", None), (-(2**63), "http://d/", page), (BIG + 5, "http://e/", "small")]
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive_roundtrip(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    first = -(2**63)
    assert got == {first: ("response", None), BIG + 1: ("revisit", first), BIG + 3: ("revisit", first), 2**63 - 1: ("revisit", first), -7: ("response", None), BIG + 5: ("response", None)}


def test_stages(spark, docs):
    sf = "/root/testdata/sf0.001"
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert set(ids(out)) <= set(IDS) and out.schema["doc_id"] == docs.schema["doc_id"], name
    out = pipeline.STAGES[-1][1](spark, docs, sf)
    assert ids(out) == EVERY and out.filter(F.size("token_ids") != F.col("n_tokens")).count() == 0
