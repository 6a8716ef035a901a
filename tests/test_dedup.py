"""The sequential dedup against a loop: random keys, hot keys, long chains."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from dealforge.operators import dedup
from dealforge.plans import queries as plans


def loop(rows):
    hs, ks, kept = set(), set(), []
    for i, h, k in sorted(rows):
        if h not in hs and k not in ks:
            hs.add(h)
            ks.add(k)
            kept.append(i)
    return kept


def matched(spark, rows):
    df = spark.createDataFrame(rows, "id long, h string, k string").withColumn("o", F.struct("id"))
    return sorted(r.id for r in dedup.first_matching(df).collect())


@pytest.mark.parametrize("n,hs,ks", [(300, 40, 40), (300, 200, 200), (400, 3, 300), (200, 1, 200), (1, 1, 1)])
def test_random_keys(spark, n, hs, ks):
    rnd = random.Random(n + hs)
    ids = rnd.sample(range(-(10**6), 10**6), n)
    rows = [(i, f"h{rnd.randrange(hs)}", f"k{rnd.randrange(ks)}") for i in ids]
    rows = [*{(h, k): (i, h, k) for i, h, k in sorted(rows, reverse=True)}.values()]  # each pair of keys once
    assert matched(spark, rows) == loop(rows)


def test_hot_key(spark):
    """A third of the rows under one hash, and chains beside it."""
    rows = [(3 * i, "hot", f"k{i}") for i in range(1000)] + [(3 * i + 1, f"h{i}", f"k{i}") for i in range(1000)] + [(3 * i + 2, f"h{i}", f"k{i + 1}") for i in range(1000)]
    assert matched(spark, rows) == loop(rows)


def test_long_chain(spark, monkeypatch):
    """100,000 rows, each of which meets the one before it: few rounds, and no Python worker."""
    n = 100_000
    rounds = []
    for name in ("_simple_round", "_chain_round"):
        f = getattr(dedup, name)
        monkeypatch.setattr(dedup, name, lambda rows, f=f, name=name: rounds.append(name) or f(rows))
    i = F.col("id")
    rows = spark.range(n).select("id", F.concat(F.lit("h"), F.floor(i / 2)).alias("h"), F.concat(F.lit("k"), F.floor((i + 1) / 2)).alias("k"), F.struct("id").alias("o"))
    got = dedup.first_matching(rows)
    assert got.agg(F.count("*"), F.sum(i % 2), F.max("id")).first()[:] == (n // 2, 0, n - 2)
    assert rounds == ["_simple_round", "_chain_round"]
    assert "Python" not in got._jdf.queryExecution().toString() and "Pandas" not in got._jdf.queryExecution().toString()


def test_deals(spark):
    """Keys as deals have them; a null semantic key equals nothing; nothing in gives nothing out."""
    kind = "id string, n int, dedup_hash string, acquiring_entity string, states array<string>, acquisition_date date, facility_count int"
    rows = [
        ("a", 1, "x", "Hill", ["VA"], None, 1), ("b", 2, "y", "Hill", ["VA"], None, 1), ("c", 3, "y", "Oak", ["VA"], None, 2), ("d", 0, "z", "Oak", ["VA"], None, 2), ("e", 9, "x", None, None, None, None),
        ("f", 4, "w", None, None, None, None), ("g", 5, "v", None, None, None, None), ("h", 6, "w", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, kind)
    keys = [r._k for r in df.select(dedup.semantic_key(*(F.col(c) for c in ("acquiring_entity", "states", "acquisition_date", "facility_count"))).alias("_k")).collect()]
    want = loop([((n, i), h, k or f"null {h}") for (i, n, h, *_), k in zip(rows, keys, strict=True)])
    assert sorted(r.id for r in dedup.greedy_unique(df, ["n"]).collect()) == sorted(i for _, i in want)
    assert dedup.greedy_unique(df.limit(0), ["n"]).count() == 0


def test_coarse_deals_of_the_sql_keep_empty_states():
    """A deal without states has an empty list in the SQL too, not a list of one null, whose key would equal nothing."""
    duckdb = pytest.importorskip("duckdb")
    deals = "SELECT 1 AS id, 1 AS article_id, 'a' AS seller_entity, []::VARCHAR[] AS states, DATE '1997-05-05' AS acquisition_date, 1 AS facility_count"
    assert duckdb.sql(f"WITH deals AS ({deals}), c AS ({plans._COARSE}) SELECT states, {plans._SEMANTIC} FROM c").fetchall() == [([], "a||1997-01-01|1")]
