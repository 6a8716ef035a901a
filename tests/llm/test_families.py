"""How much is sent: families of near copies, blocks of vectors; benchmarks of several blocks; letters of all planes."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealforge.llm import decontaminate, jaccard_join, language_id, pivot_search


def shuffled(spark):
    """Bytes that all stages so far have written for others to read."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jvm = sc._jvm
    nothing = sc._gateway.new_array(jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, nothing, jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_a_family_is_not_sent_once_a_cell(spark):
    rnd = random.Random(1)
    words = [f"{rnd.randrange(16**7):x}" for _ in range(1000)]
    rows = []
    for i in range(1200):
        w = list(words)
        for at in rnd.sample(range(1000), 6):
            w[at] = f"{rnd.randrange(16**7):x}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    size = sum(len(t) for _, t in rows)
    before = shuffled(spark)
    got = jaccard_join.linked_components(docs).collect()
    sent = shuffled(spark) - before
    assert {r.component_id for r in got} == {0} and len(got) == 1200
    assert sent < 6 * size, sent / size


def test_cell_of_known_components():
    """Sets of one component aren't compared again, and no link between components is lost."""
    base = np.arange(1000, dtype=np.uint64)
    sets = [np.concatenate([base[: 1000 - 5 * i], base[:0]]) for i in range(4)]
    cell = jaccard_join.Cell([4, 5, 6, 7], sets, jaccard_join.Fraction(9, 10), np.array([4, 4, 6, 6]))
    every = np.arange(4)
    assert len(list(cell.links(every, every))) == 1
    whole = jaccard_join.Cell([4, 5, 6, 7], sets, jaccard_join.Fraction(9, 10), np.array([4, 4, 4, 4]))
    assert list(whole.links(every, every)) == []


def test_blocks_of_vectors_are_sent_once(spark, monkeypatch):
    """On clustered vectors, with many blocks on both sides: all that top_k shuffles stays below 4 x the vectors."""
    monkeypatch.setattr(pivot_search, "CANDIDATE_BLOCK", 256)
    monkeypatch.setattr(pivot_search, "QUERY_BLOCK", 16)
    rnd = np.random.default_rng(4)
    dim, n = 96, 4000
    x = np.floor(64 * (rnd.normal(size=(24, dim))[rnd.integers(0, 24, n)] * 3 + rnd.normal(size=(n, dim)) * 0.3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>").repartition(4).cache()
    rows.count()
    before = shuffled(spark)
    got = pivot_search.top_k(rows, F.col("vec_id") % 20 == 0, 5).collect()
    sent = shuffled(spark) - before
    scores = x[::20] @ x.T
    for r in got:
        scores[r.query_id // 20, r.query_id] = -np.inf
    want = -np.sort(-scores, axis=1)[:, :5]
    by = {(r.query_id, r["rank"]): r.score for r in got}
    assert all(by[20 * q, k + 1] == want[q, k] for q in range(len(want)) for k in range(5))
    assert sent < 4 * 8 * dim * n, sent / (8 * dim * n)
    rows.unpersist()


@pytest.mark.parametrize("held", [1, 1 << 30])
def test_many_blocks_in_one_scan(spark, monkeypatch, held):
    """A benchmark of ten blocks gives what one block gives, and the documents are scanned once."""
    monkeypatch.setattr(decontaminate, "HELD_BYTES", held)
    rnd = random.Random(6)
    words = [f"word{i}" for i in range(400)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, text(12)) for i in range(30)]
    docs = [(i, f"{text(30)} {items[i % 30][1] if i % 3 else ''} {text(20)}") for i in range(60)]
    dd, bb = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda df: sorted(map(tuple, df.collect()))
    whole = key(decontaminate.leaks(dd, bb))
    assert len(whole) == 40
    parts = decontaminate.leaks(dd, bb, block_bytes=300)
    assert key(parts) == whole
    assert parts._jdf.queryExecution().toString().count("MapInPandas") == decontaminate.leaks(dd, bb)._jdf.queryExecution().toString().count("MapInPandas")


def test_letters_of_all_planes(spark):
    """Adlam and Han extension B have letters; vowel signs don't cut words of Devanagari."""
    adlam, han = "".join(chr(0x1E900 + i % 34) for i in range(60)), "".join(chr(0x20000 + 7 * i) for i in range(60))
    assert len(language_id.trigrams(adlam)) == 60 and len(language_id.trigrams(han)) == 60
    hindi = "हिन्दी"
    assert len(language_id.trigrams(hindi)) == len(hindi)
    words = ["".join(chr(0x1E922 + (5 * w + 7 * j) % 34) for j in range(6)) for w in range(12)]
    rows = [(i, " ".join(words[(i + j) % 12] for j in range(20)) if i % 2 else "the quick brown fox jumps over lazy dogs again and again", "ff" if i % 2 else "en", "s", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert language_id.keep_identified(docs, language_id.fit(docs)).count() == 60


def tasks(spark):
    """Tasks of all stages so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jvm = sc._jvm
    nothing = sc._gateway.new_array(jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, nothing, jvm.java.util.ArrayList())
    return sum(stages.apply(i).numCompleteTasks() for i in range(stages.size()))


def test_a_join_over_many_partitions_takes_few_tasks(spark):
    """Each task leaves files and a place in the driver's log: a chain of families takes below 110 tasks a shuffle partition."""
    rnd = random.Random(2)
    base = [f"{rnd.randrange(16**7):x}" for _ in range(200)]
    rows = []
    for i in range(60):
        if i % 12 == 0:
            w = [f"{rnd.randrange(16**7):x}" for _ in range(200)]
        w = [*w[: 3 * (i % 12)], f"{rnd.randrange(16**7):x}", *w[3 * (i % 12) + 1 :]]
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    docs.count()
    n = 16
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        before = tasks(spark)
        got = {r.doc_id: r.component_id for r in jaccard_join.linked_components(docs).collect()}
        taken = tasks(spark) - before
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
        docs.unpersist()
    assert got == {i: 100 if i >= 100 else i - i % 12 for i, _ in rows}
    assert taken < 110 * n, taken / n
