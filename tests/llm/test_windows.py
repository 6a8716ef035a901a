"""Byte and word dedup against brute force, on texts full of repeats."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from dealforge.llm import debruijn_dedup, suffix_dedup, windows

DOCS = "doc_id long, text string, lang string, body string, key string"


def documents(seed: int, words: bool) -> list[tuple]:
    rnd = random.Random(seed)
    vocab = ["a", "be", "sea", "dune", "é", "noun", "über", "x y", "stone"]
    passage = " ".join(rnd.choice(vocab) for _ in range(130))
    rows = []
    for i in range(60):
        parts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 120)))]
        if i % 3 == 0:
            a, b = sorted(rnd.sample(range(len(passage)), 2))
            parts.insert(rnd.randint(0, 1), passage[a:b])
        if i % 7 == 0:
            parts.append(passage)
        if i % 11 == 0:
            parts.append("ab" * rnd.randint(10, 60))
        rows.append((i * 3 % 61, ("\t" if words else "\n").join(parts), "en", "clash", "clash"))
    rows += [(100, None, "en", None, None), (101, "", None, None, None), (102, " \n\t", None, None, None), (103, passage * 40, "en", None, None)]
    rows += [(104, passage, "en", None, None)] * 3 + [(104, passage + " end", "en", None, None), (None, passage, "en", None, None)]
    return rows


def order(i):
    return (1 << 63) - 1 if i is None else i


def covered(rows, split, n):
    """Units of each row and whether each goes."""
    units = [split(r[1] or "") for r in rows]
    first = {}
    for r, u in zip(rows, units):
        for k in range(len(u) - n + 1):
            w = u[k : k + n] if isinstance(u, bytes) else tuple(u[k : k + n])
            first[w] = min(first.get(w, order(r[0])), order(r[0]))
    for r, u in zip(rows, units):
        gone = [False] * len(u)
        for k in range(len(u) - n + 1):
            w = u[k : k + n] if isinstance(u, bytes) else tuple(u[k : k + n])
            if first[w] < order(r[0]):
                gone[k : k + n] = [True] * n
        yield r[0], u, gone


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed):
    rows = documents(seed, False)
    want = sorted(
        (str(i), len(u), sum(g), sum(x and (k == 0 or not g[k - 1]) for k, x in enumerate(g)), hashlib.sha256(bytes(b for b, x in zip(u, g) if not x)).hexdigest())
        for i, u, g in covered(rows, str.encode, 50)
    )
    got = suffix_dedup.digests(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert sum(w[2] for w in want) > 1000


def test_bytes_texts_and_empty_table(spark):
    rows = [(1, "x" * 20 + "passage " * 9), (2, "y" * 5 + "passage " * 9)]
    got = {r.doc_id: r for r in suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert bytes(got[1].kept).decode() == rows[0][1] and bytes(got[2].kept) == b"y" * 5 and [tuple(s) for s in got[2].spans] == [(5, 77)]
    assert suffix_dedup.digests(spark.createDataFrame([], DOCS)).collect() == []


def test_hot_gram_is_exact(spark):
    # one gram with more differing segments in a batch than are listed
    rows = [(i, f"{i:04d}" + "q" * 30 + f"{i // 2:04d}" + "z" * 20) for i in range(400)]
    want = sorted((str(i), len(u), sum(g)) for i, u, g in covered(rows, str.encode, 50))
    got = suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in got) == want


@pytest.mark.parametrize("seed", [3, 4])
def test_words(spark, seed):
    rows = documents(seed, True)
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    want = sorted((str(i), len(u), sum(g), hashlib.sha256(" ".join(x for x, y in zip(u, g) if not y).encode()).hexdigest()) for i, u, g in covered(rows, split, 50))
    got = debruijn_dedup.digests(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert sum(w[2] for w in want) > 500


def test_words_texts_and_empty_table(spark):
    p = " ".join(f"w{i}" for i in range(50))
    got = {r.doc_id: r for r in debruijn_dedup.deduplicate(spark.createDataFrame([(1, p), (2, "new " + p + " end")], "doc_id long, text string")).collect()}
    assert got[1].kept == p and got[2].kept == "new end" and [tuple(s) for s in got[2].spans] == [(1, 51)]
    assert debruijn_dedup.digests(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("length", [32, 50, 100])
def test_window_ids_tell_every_two_flipped_bits_apart(length):
    """All windows that differ from one text in one or two bits, at every distance, have ids of their own."""
    rng = np.random.default_rng(length)
    text = rng.integers(0, 256, length, dtype=np.uint8)
    bits = np.unpackbits(text)
    n = 8 * length
    a, b = np.triu_indices(n)  # equal places: one bit flipped
    seen, second = set(), set()
    for at in range(0, len(a), 20_000):
        rows = np.repeat(bits[None, :], len(a[at : at + 20_000]), axis=0)
        place = np.arange(len(rows))
        rows[place, a[at : at + 20_000]] ^= 1
        other = a[at : at + 20_000] != b[at : at + 20_000]
        rows[place[other], b[at : at + 20_000][other]] ^= 1
        data = np.packbits(rows, axis=1).ravel()
        _, ids, check = windows.scan_bytes(data, length, 24)
        # every window that stands alone in its row
        seen.update(ids[::length].tolist())
        second.update(check[::length].tolist())
    assert len(seen) == len(second) == len(a)


def test_grams_tell_flipped_bits_apart():
    text = np.frombuffer(b"TnC5ybXnB yqo1nooY012345", np.uint8)
    bits, n = np.unpackbits(text), 8 * len(text)
    a, b = np.triu_indices(n, 1)
    rows = np.repeat(bits[None, :], len(a), axis=0)
    rows[np.arange(len(a)), a] ^= 1
    rows[np.arange(len(a)), b] ^= 1
    low = windows.scan_bytes(np.packbits(rows, axis=1).ravel(), 24, 24)[0][::24]
    assert len(set(low.tolist())) == len(a)


def test_bytes_differing_in_two_high_bits_stay(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(300):
        t = [rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(50)]
        u = list(t)
        u[7], u[15] = u[7].swapcase(), u[15].swapcase()
        rows += [(len(rows), "".join(t)), (len(rows) + 1, "".join(u))]
    got = suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.filter("n_removed > 0").count() == 0


def test_spans_and_words_at_their_sources(spark):
    """Pieces that go on at one source become one span; a span whose words aren't its source's is told apart."""
    p = [f"w{i}" for i in range(90)]
    texts = {1: p, 2: ["new", *p[:70]], 3: [*p[:30], "other", *p[31:]]}
    rows = debruijn_dedup.rows_of(spark.createDataFrame([(i, "  ".join(t)) for i, t in texts.items()], "doc_id long, text string"))
    row = {r.key: r.row for r in rows.collect()}
    pack = lambda first, n: first << 32 | n
    pieces = [(2, row[2], pack(1, 4), (1, row[1], pack(0, 4))), (2, row[2], pack(5, 3), (1, row[1], pack(4, 3))), (2, row[2], pack(9, 2), (1, row[1], pack(8, 2))), (3, row[3], pack(0, 5), (1, row[1], pack(0, 5))), (3, row[3], pack(31, 9), (1, row[1], pack(31, 9)))]
    found = debruijn_dedup.spans(spark.createDataFrame(pieces, "key long, row long, at long, source struct<key: long, row: long, at: long>"))
    assert sorted((r.key, r.first, r.n, r.sfirst) for r in found.collect()) == [(2, 1, 7, 0), (2, 9, 2, 8), (3, 0, 5, 0), (3, 31, 9, 31)]
    got = debruijn_dedup.compared(rows, found, 50).collect()
    assert sorted((r.key, r.first, r.same) for r in got) == [(2, 1, True), (2, 9, True), (3, 0, False), (3, 31, True)]
