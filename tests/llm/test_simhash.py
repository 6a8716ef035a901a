"""SimHash components against brute force: random, planted and edge rows."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dealforge.llm import simhash_dedup

DOCS = "doc_id long, text string, lang string, fp string, id long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = {i: brute_fingerprint(t) for i, t in rows}
    low = {i: i for i in fps}
    moved = True
    while moved:
        moved = False
        for i in fps:
            for j in fps:
                if low[j] < low[i] and (fps[i] ^ fps[j]).bit_count() <= 4:
                    low[i], moved = low[j], True
    return {i: (f"{fps[i]:016x}", low[i]) for i in fps}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 7) for i, t in rows], DOCS)


def result(df):
    rows = df.collect()
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    return {r.doc_id: (r.fingerprint, r.component_id) for r in rows}


def test_against_brute_force(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 400))) for _ in range(60)]
    for t in texts[:12]:
        for _ in range(6):  # near copies
            w = t.split(" ")
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            texts.append((" " if rnd.random() < 0.5 else "\n").join(w).upper())
    texts += ["", None, " \t ", "one", "one two three", "One  two\x0bthree", "É é", "a\x1cb", "x y z w v " * 3000, "tie", "tie"]
    ids = rnd.sample(range(-500, 5000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    want = brute(rows)
    assert len({c for _, c in want.values()}) < len(rows) - 30
    assert result(simhash_dedup.linked_components(frame(spark, rows))) == want
    assert result(simhash_dedup.linked_components(frame(spark, rows), block=5)) == want


def test_hash_is_sparks(spark):
    text = "einz zwei ßdrei 四"
    want = spark.range(1).select(F.hex(F.xxhash64(F.lit(text)))).first()[0].lower().rjust(16, "0")
    assert f"{simhash_dedup.fingerprint(text.encode()):016x}" == want


@pytest.mark.parametrize("radius", [0, 1, 4, 7])
def test_links_at_every_radius(spark, radius):
    """Chains and balls of bit changes: all links within the radius, none beyond it, whatever the blocks."""
    rnd = np.random.default_rng(radius)
    fps = [int(x) for x in rnd.integers(0, 1 << 64, 40, dtype=np.uint64)]
    for f in fps[:30]:
        for n in (1, radius, radius + 1, radius + 2):
            g = f
            for b in rnd.choice(64, n, replace=False):
                g ^= 1 << int(b)
            fps.append(g)
    fps = sorted(set(fps))
    rows = [(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)]
    low = list(range(len(fps)))
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius]
    for _ in fps:
        for i, j in near:
            low[i] = low[j] = min(low[i], low[j])
    for block in (3, 1 << 16):
        links = simhash_dedup.near_links(spark.createDataFrame(rows, "fp long, id long"), radius=radius, block=block)
        found = {r.id: r.component for r in simhash_dedup.components(links).collect()}
        assert [found.get(i, i) for i in range(len(fps))] == low


def test_family_gives_no_pairs(spark):
    """A family within one ball: links by members, not by pairs."""
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)})
    rows = [(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)]
    links = simhash_dedup.near_links(spark.createDataFrame(rows, "fp long, id long"), radius=4).cache()
    assert links.count() < 40 * len(fps)
    assert {r.component for r in simhash_dedup.components(links).collect()} == {0}


def test_edges(spark):
    nothing = simhash_dedup.linked_components(frame(spark, []))
    assert nothing.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")] and nothing.count() == 0
    big = 2**53
    rows = [(None, "null id"), (big + 1, "same text here"), (big + 3, "same text here"), (2**63 - 1, None), (-5, "  "), (-5, "  ")]
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash_dedup.linked_components(frame(spark, rows)).collect())
    fp = f"{brute_fingerprint('same text here'):016x}"
    assert got == [(-5, "0" * 16, -5), (-5, "0" * 16, -5), (big + 1, fp, big + 1), (big + 3, fp, big + 1), (2**63 - 1, "0" * 16, -5)]
