"""Cross-tokenizer alignment against a brute-force version in plain Python."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from dealforge.llm import token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, batch string, n long, pair long"


def byte_of():
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(other)}


def tokens(text):
    """(id, start, end) of both tokenizers' tokens, or nothing."""
    a, sp, byte = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_of()
    a.encode_special_tokens = True
    want = (" " + (text or "")).encode()
    sides = []
    for ids, raw in (
        (a.encode(" " + (text or ""), add_special_tokens=False).ids, lambda i: bytes(byte[c] for c in a.id_to_token(i))),
        (sp.encode(text or ""), lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()),
    ):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + len(raw(i))))
            at = out[-1][2]
        if not text or b"".join(map(raw, ids)) != want:
            return [], []
        sides.append(out)
    return sides


def brute(rows):
    both = [(i, *tokens(t)) for i, t in rows]
    links = [[(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] for _, a, b in both]
    count = Counter(p for some in links for p in some)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for (i, a, b), some in zip(both, links, strict=True):
        ends, low, groups = sorted({x[2] for x in a} & {y[2] for y in b}), 0, []
        for e in ends:
            groups.append(",".join(str(x[0]) for x in a if low < x[2] <= e) + "|" + ",".join(str(y[0]) for y in b if low < y[2] <= e))
            low = e
        text = ";".join(groups)
        out.append((i, len(a), len(b), len(ends), len(some), sum(count[p] == most[p[1]] for p in some), sum(count[p] for p in some), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str)


def texts():
    rnd = random.Random(11)
    parts = ["the", "tion", "Über", " ", "  ", "\n", "é", "😀", "12345", "'s", ".", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "\x00", "ﬁ", "　", "\t", "日本", "don't", " \x1c "]
    out = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(120)]
    return out + ["", None, " ", "a", "▁", "x▁y", "same same", "same same", "﻿", "é", "word " * 300, "a" * 700, "\n\n  \n"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_against_brute_force(spark):
    rows = list(enumerate(texts()))
    df = token_alignment.alignment_digests(frame(spark, rows).repartition(3), A, B)
    assert df.columns == COLUMNS
    assert sorted(map(tuple, df.collect()), key=str) == brute(rows)


def test_small_batches_and_pieces(spark):
    """Counts are merged over batches, and cut texts give what whole ones do."""
    rows = list(enumerate(texts() + [" ".join(x for x in texts() if x and "▁" not in x)]))
    aligned = token_alignment.align(frame(spark, rows).repartition(2), A, B, keep_groups=True, batch_chars=300, piece_chars=40)
    n_b = sentencepiece.SentencePieceProcessor(model_file=B).get_piece_size()
    got = token_alignment.scored(aligned, n_b).collect()
    assert aligned.filter("counted IS NOT NULL").count() > 10
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == brute(rows)
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got if r.groups)
    told = {(r.a_id, r.b_id): r.n for r in token_alignment.pair_counts(aligned, n_b).collect()}
    assert sum(told.values()) == sum(r.n_links for r in got)


def test_pieces():
    text = "ab  cd e\nf gh " + "x" * 50 + " y"
    for size in (1, 3, 10, 1000):
        cut = token_alignment.pieces(text, size)
        assert "".join(cut) == " " + text and all(p[0] == " " and not p[1:2].isspace() for p in cut)


def test_quick_encoding_is_the_same():
    t = token_alignment.Tokenizers(open(A).read(), open(B, "rb").read())
    assert t.quick
    rnd = random.Random(2)
    odd = [chr(c) for c in range(0x250)] + list("''  \n\n\t12 aAzZ")
    some = [" " + "".join(rnd.choice(odd) for _ in range(rnd.randint(0, 60))) for _ in range(3000)] + [" " + x for x in texts() if x] + [" " + "ab" * 2000, " " * 3000 + "x"]
    assert t._encode_a(some) == [e.ids for e in t.a.encode_batch(some, add_special_tokens=False)]


def test_edges(spark):
    assert token_alignment.alignment_digests(frame(spark, []), A, B).count() == 0
    rows = [(None, "a text"), (2**53 + 1, "a text"), (2**63 - 1, None), (-1, ""), (-1, "")]
    got = sorted(map(tuple, token_alignment.alignment_digests(frame(spark, rows), A, B).collect()), key=str)
    assert got == brute(rows)
