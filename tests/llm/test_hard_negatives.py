"""Hard negatives against brute force, the oracle and edge rows."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from dealforge.llm import hard_negatives, queries

VECTORS = "vec_id long, embedding array<float>, label int, id long, v string, kind int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def frame(spark, rows):
    return spark.createDataFrame([(i, e, lb, 1, "x", 2) for i, e, lb in rows], VECTORS)


def brute(rows):
    v = {}
    for i, e, lb in rows:
        if i is not None and lb is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            e = [math.floor(256 * float(np.float32(x))) for x in e]
            v[i] = min(v.get(i, (e, lb)), (e, lb))
    out = []
    for a, (va, la) in v.items():
        if a % 100:
            continue
        score = {i: sum(x * y for x, y in zip(va, vb, strict=False)) for i, (vb, _) in v.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if v[i][1] == la][:5]:
            fit = [i for i in order if v[i][1] != la and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(fit[:10], 1)]
    return sorted(out)


def mined(spark, rows, **how):
    df = hard_negatives.mine(hard_negatives.usable(frame(spark, rows)), F.col("vec_id") % 100 == 0, **how)
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


def random_rows(seed, n=400, dim=11, labels=3, spread=1.0):
    rnd = random.Random(seed)
    centre = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(labels)]
    out = []
    for i in range(n):
        lb = 0 if rnd.random() < 0.5 else rnd.randrange(labels)  # half of the rows in one label
        base = centre[rnd.randrange(labels)]
        out.append((i * 20, [round(b + spread * rnd.gauss(0, 1), 1) * 0.25 for b in base], lb))
    return out + [(7 * 20 + 1, out[7][1], 1), (7 * 20 + 2, out[7][1], 2)]  # ties


@pytest.mark.parametrize("block", [25, 16384])
def test_against_brute_force(spark, block):
    for seed in (1, 2):
        rows = random_rows(seed)
        want = brute(rows)
        assert len(want) > 100
        assert mined(spark, rows, block=block) == want


def test_sample_floors_are_safe(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SAMPLE_ROWS", 30)
    rows = random_rows(5)
    assert mined(spark, rows, block=50) == brute(rows)


def test_query_against_oracle(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.execute(hard_negatives.ORACLE).fetchall())
    assert want and sorted(map(tuple, queries.op12_hard_negatives(spark, sf).collect())) == want


def test_edges(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []  # no anchor
    big = 100 * (2**53 // 100 + 1)
    rows = [
        (big, [1.0, 0.5], 1), (big + 1, [1.0, 0.25], 1), (big + 2, [0.5, 0.5], 2), (big + 3, [0.5], 2), (big + 4, [float("nan"), 1.0], 2), (big + 5, [None, 1.0], 2),
        (big + 6, None, 2), (big + 7, [1.0, 1.0], None), (None, [1.0, 1.0], 2), (big + 8, [float("inf"), 1.0], 2), (big + 2, [0.5, 0.5], 2), (big + 9, [], 2), (0, [], 1), (100, [0.0, 0.0], 2), (200, [-1.0, -1.0], 2),
    ]
    want = brute(rows)
    assert any(r[0] == big for r in want) and any(r[0] == 0 for r in want)
    assert mined(spark, rows) == want
    with pytest.raises(ValueError, match="too large"):
        mined(spark, [(0, [1e20], 1)])


def test_lists_are_read_in_part():
    """Where norms fall off, the lists give a part of their entries, and few pairs are completed."""
    rnd = np.random.default_rng(1)
    x = np.floor(256 * rnd.normal(size=(4000, 64)) * 0.8 ** np.arange(64) * rnd.gamma(1, 1, size=(4000, 1)))
    ids, labels = np.arange(4000), rnd.integers(0, 4, 4000)
    index = hard_negatives.Index(ids, labels, x)
    q = x[:20]
    scores = q @ x.T
    scores[np.arange(20), np.arange(20)] = -np.inf
    top = np.sort(np.where(labels[None] == labels[:20, None], -np.inf, scores), axis=1)[:, ::-1]
    low, high, floor = np.full((20, 1), -1e9), np.full((20, 1), 1e9), top[:, 30:31]
    row, _, col, score, part = hard_negatives.fill(index, ids[:20], labels[:20], q, low, high, floor, 10, False)
    for i in range(20):
        assert sorted(score[row == i])[::-1] == top[i, :10].tolist()
    assert part.entries < 0.5 * 4000 * 8 and part.completed < 0.2 * 20 * 4000
