"""The pipeline: every stage's columns and decisions."""

from __future__ import annotations

import random
from fractions import Fraction

import corpus_pipeline as pipeline
from dealforge.llm import jaccard_join

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "tokenize":
            assert out.columns == columns
        m = out.count()
        assert 0 < m <= n
        docs, n = out, m
    assert {"doc_id", "token_ids", "n_tokens"} <= set(docs.columns)


def test_stages_on_edge_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "the same line of words that stands here twice in all", "en", "s", 9), (3, "the same line of words that stands here twice in all", "en", "s", 9)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs.count()


def test_run(spark):
    assert pipeline.run(spark, SF).count() > 0


def test_run_takes_out_what_was_planted(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    kept = docs.filter("lang IS NOT NULL AND length(text) > 1500").orderBy("doc_id").first()
    rnd = random.Random(7)
    words = [w for w in kept["text"].split() if w.isalpha()]

    def fresh(n):
        return [rnd.choice(words) for _ in range(n)]

    first, clean, holder = fresh(100), fresh(100), fresh(100)
    # two neighbouring words replaced: too much for line_dedup, 90 of 102 shingles in common
    near = [*first[:50], "zwei", "andere", *first[52:]]
    item = items.filter("length(text) > 60").orderBy("item_id").first()["text"]
    planted = {
        900_001: " ".join(first),
        900_002: " ".join(first),
        900_003: " ".join(near),
        900_004: " ".join(clean),
        900_005: " ".join(holder[:50]) + " " + item.replace("\n", " ") + " " + " ".join(holder[50:]),
        900_006: "აბ გდ ევ ზთ " * 40,
    }
    more = [kept.asDict() | {"doc_id": i, "text": x} for i, x in planted.items()]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")

    left, seen = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES:
        at = f"{tmp_path}/{name}"
        stage(spark, seen, str(tmp_path)).write.parquet(at)
        seen = spark.read.parquet(at)
        left[name] = {r.doc_id for r in seen.filter("doc_id > 900000").select("doc_id").collect()}
    assert 900_006 not in left["language_id"]
    assert {900_001, 900_003, 900_004, 900_005} <= left["line_dedup"]
    assert 900_002 not in left["line_dedup"]
    assert left["near_duplicates"] == left["line_dedup"] - {900_003}
    assert left["decontaminate"] == {900_001, 900_004}
    assert left["tokenize"] == {900_001, 900_004}


def test_copies_are_gone_after_both_stages(spark, tmp_path):
    """Of the documents that near copies of smaller ones are in the table as it came, nine in ten at least are gone after line dedup and near duplicates together."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    linked = jaccard_join.linked_components(docs, n=5, threshold=Fraction(4, 5))
    copies = {r.doc_id for r in linked.filter("component_id < doc_id").collect()}
    for name, stage in pipeline.STAGES[:3]:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    left = copies & {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(copies) > 50 and len(left) <= 0.1 * len(copies)
