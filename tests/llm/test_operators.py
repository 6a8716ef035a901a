"""The other corpus operators against brute force, exact round trips and edge rows."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import resource
import tracemalloc
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from dealforge.llm import common, components, decontaminate, jaccard_join, kneser_ney, language_id, line_dedup, pivot_search, sentencepiece_codec, shared_files, warc

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = ["", " ", None, "a", "  two  spaces ", "▁marker▁", "line\nbreak\r\n\tx", "<s></s><unk><0x0A>", "é😀　x\x00y", "word " * 5000]


def frame(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)], schema)


# SentencePiece


def test_sentencepiece_is_exact(spark):
    rnd = random.Random(1)
    pieces = ["the", "tion", " ", "  ", "\n", "é", "▁", "😀", "12", ".", "<s>", "ﬁ", "\t", "\r"]
    texts = EDGE + ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, t in enumerate(texts):
        ids = sp.encode(t or "", add_eos=True)
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentencepiece_codec.roundtrip_digests(frame(spark, texts), MODEL).collect()}
    assert got == want
    both = {r.doc_id: (r.n_tokens, list(r.token_ids), r.text) for r in sentencepiece_codec.encode_and_decode(frame(spark, texts[:20]), MODEL).collect()}
    assert both == {i: (len(x), x, sp.decode(x)) for i, x in ((i, sp.encode(t or "", add_eos=True)) for i, t in enumerate(texts[:20]))}
    assert sentencepiece_codec.roundtrip_digests(frame(spark, []), MODEL).collect() == []


# WARC


def test_warc_round_trip(spark):
    big = "<html>" + "é" * 300
    rows = [(5, "http://x/é?a=1", big), (3, None, big), (9, "http://y", big), (1, "http://s", "small"), (2, "http://s2", "small"), (4, "http://n", None), (6, "u", ""), (None, "u", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to, r.payload_digest) for r in warc.archive_roundtrip(df).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    kind = {3: ("response", None), 5: ("revisit", 3), 9: ("revisit", 3)}
    assert got == {i: (len((t or "").encode()), *kind.get(i, ("response", None)), sha(t)) for i, _, t in rows if i is not None}
    assert warc.archive_roundtrip(df.limit(0)).collect() == []
    to = common.fresh_dir(spark, "warc-test")
    assert warc.write_archives(warc.mark_revisits(df), to, archive_bytes=500).agg(F.sum("n_records")).first()[0] == 7
    back = {r.page_id: (r.url, r.payload) for r in warc.read_archives(spark, to, with_payload=True).collect()}
    assert bytes(back[3][1]).decode() == big and back[5][1] is None and back[3][0] is None and back[4] == ("http://n", b"")


def test_warc_keeps_other_payloads_of_a_page_id(spark):
    a, b = "<html>" + "a" * 200, "<html>" + "b" * 200
    df = spark.createDataFrame([(1, "u", a), (2, "u", a), (2, "u", b), (2, "u", "small"), (3, "u", b)], "page_id long, url string, html string")
    to = common.fresh_dir(spark, "warc-ids")
    assert warc.write_archives(warc.mark_revisits(df), to).agg(F.sum("n_records")).first()[0] == 5
    got = sorted((r.page_id, r.refers_to or 0, bytes(r.payload or b"").decode()) for r in warc.read_archives(spark, to, with_payload=True).collect())
    assert got == sorted([(1, 0, a), (2, 1, ""), (2, 0, b), (2, 0, "small"), (3, 2, "")])


def test_warc_reads_only_what_was_written(spark):
    """Several archives a task, clashing columns, and an archive that a lost task left behind."""
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * 30, "clash", i) for i in range(80)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, refers_to long")
    assert sorted(r.page_id for r in warc.archive_roundtrip(df, archive_bytes=700).collect()) == list(range(80))
    to = common.fresh_dir(spark, "warc-stale")
    written = common.cut(warc.write_archives(warc.mark_revisits(df), to, archive_bytes=700))
    assert written.count() > 8 and written.count() > written.rdd.getNumPartitions()
    warc.write_archives(warc.mark_revisits(df), to).collect()
    back = warc.read_written(written, to, with_payload=True).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in back) == [(i, t) for i, _, t, *_ in rows]
    assert warc.read_archives(spark, to).count() == 160


def test_warc_errors():
    good = warc.record(7, "http://x", b"body", hashlib.sha256(b"body").digest(), None)
    assert warc.parse_record(good)["page_id"] == 7
    for bad in (good.replace(b"body", b"bodx"), good[:-1], good.replace(b"WARC/1.1", b"HTTP/1.1"), good + b"x"):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    two = warc.member(good) + warc.member(good)
    assert len(list(warc.inflate_members(memoryview(two), step=7))) == 2
    with pytest.raises(warc.WarcError):
        list(warc.inflate_members(memoryview(two[:-3])))
    assert warc.parse_record(warc.record(-5, None, b"", hashlib.sha256(b"").digest(), -6))["refers_to"] == -6


# Exact top-k


@pytest.mark.parametrize("cands,asks,known", [(8192, 1024, 1 << 16), (40, 3, 1 << 16), (40, 3, 0)])
def test_top_k(spark, monkeypatch, cands, asks, known):
    monkeypatch.setattr(pivot_search, "CANDIDATE_BLOCK", cands)
    monkeypatch.setattr(pivot_search, "QUERY_BLOCK", asks)
    monkeypatch.setattr(pivot_search, "KNOWN_BLOCKS", known)
    monkeypatch.setattr(pivot_search, "STEP", 16)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, []), (405, [2.0, -1.0])]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "vec_id long, embedding array<float>, score int, v string")
    v = {i: np.floor(64 * np.array(np.float32(x), float)) for i, x in rows if x is not None and all(y is not None and math.isfinite(y) for y in x)}
    pad = {i: np.pad(x, (0, 8 - len(x))) for i, x in v.items()}
    want = set()
    for q in (i for i in pad if i % 20 == 0):
        best = sorted((-int(pad[q] @ x), i) for i, x in pad.items() if i != q)[:20]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    got = {tuple(r) for r in pivot_search.top_k(pivot_search.usable(df), F.col("vec_id") % 20 == 0).collect()}
    assert got == want
    few = pivot_search.usable(df.filter("vec_id IN (0, 1, 20)"))
    assert pivot_search.top_k(few, F.col("vec_id") % 20 == 0).count() == 4
    assert pivot_search.top_k(few.limit(0), F.lit(True)).collect() == []


def test_bounds_leave_out_candidates_and_blocks():
    """Clustered vectors: most scores, and most pairs of blocks, are never evaluated, and none is missed."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(8, 16)) * 40
    x = np.rint(np.concatenate([c + rng.normal(size=(300, 16)) for c in centre]))
    x *= 50 / np.sqrt((x**2).sum(1, keepdims=True))
    x, pivots = np.rint(x * 8), np.rint(centre * 50 / np.sqrt((centre**2).sum(1, keepdims=True)) * 8)
    side = lambda at: {"ids": at, "v": x[at], "far": pivot_search._distances(x[at], pivots), "sq": (x[at] ** 2).sum(1)}
    parts = [side(np.arange(300 * i, 300 * i + 300)) for i in range(8)]
    q = side(np.arange(0, 300, 20))
    own = np.sort(x[q["ids"]] @ parts[0]["v"].T, axis=1)[:, -21]
    known = {"block": np.arange(8), "sq": np.array([p["sq"].max() for p in parts]), "lo": np.stack([p["far"].min(0) for p in parts]), "hi": np.stack([p["far"].max(0) for p in parts])}
    assert pivot_search._reachable({"lo": q["far"].min(0), "hi": q["far"].max(0), "sq": q["sq"].max(), "floor": own.min()}, known).tolist() == [0]
    whole = side(np.arange(len(x)))
    got, evaluated = pivot_search._search(q | {"seed": np.full(len(q["ids"]), -np.inf)}, whole, 20, True)
    assert evaluated < 0.3 * len(q["ids"]) * len(x)
    for i in q["ids"]:
        s = x @ x[i]
        s[i] = -np.inf
        assert got[got.query_id == i].vec_id.tolist() == np.lexsort((np.arange(len(x)), -s))[:20].tolist()


# Kneser-Ney


def test_kneser_ney_equals_counts(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["the", "The", "cat", "sat", "on", "a", "mat\n", "É", f"w{rnd.randrange(40)}"]) for _ in range(rnd.randint(0, 60))) for _ in range(120)] + EDGE[:5]
    got = {r.doc_id: r for r in kneser_ney.held_out_scores(frame(spark, texts)).collect()}
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    docs = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + ["\0"] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    c, bi = Counter(), Counter()
    for i, w in docs.items():
        if not held[i]:
            c.update(w)
            bi.update(zip(["\1", *w], w))
    n, v = sum(c.values()), len(c)
    ctx, follow, left = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
    for (a, b), m in bi.items():
        ctx[a] += m
        follow[a][min(m, 3) - 1] += 1
        left[b] += 1
    d = lambda xs: kneser_ney._discounts([sum(x == i for x in xs) for i in (1, 2, 3, 4)])
    d2, d1 = d(bi.values()), d(left.values())
    spare = sum(d1[min(x, 3) - 1] for x in left.values()) / len(bi)

    def p(a, b):
        one = (left[b] - d1[min(left[b], 3) - 1] if left[b] else 0) / len(bi) + spare / (v + 1)
        if not ctx[a]:
            return one
        return (bi[a, b] - d2[min(bi[a, b], 3) - 1] if bi[a, b] else 0) / ctx[a] + sum(x * y for x, y in zip(d2, follow[a])) / ctx[a] * one

    assert abs(sum(p("the", b) for b in c) + p("the", "\2") - 1) < 1e-9
    for i, w in docs.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(a, b)) for a, b in zip(["\1", *w], w)), rel_tol=1e-9)


def test_kneser_ney_maps_few_files(spark, monkeypatch):
    """Many buckets under a low limit of descriptors; clashing columns; a folder that isn't local files."""
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice("abcdefgh") + rnd.choice("xyz") for _ in range(40)), "clash", 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out string, score double")
    want = {r.doc_id: r.score for r in kneser_ney.held_out_scores(df).collect()}
    monkeypatch.setattr(kneser_ney, "BUCKET_BYTES", 10)
    part = df.filter("crc32(cast(doc_id as string)) % 7 <> 2")
    model = kneser_ney.train(part)
    assert model.n_buckets > 300
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    texts = [r[1].encode() for r in rows]
    monkeypatch.setattr(kneser_ney, "OPEN", 8)
    try:
        resource.setrlimit(resource.RLIMIT_NOFILE, (len(os.listdir("/proc/self/fd")) + 20, hard))
        got = model.score(texts)["score"]
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
    assert len(model._open) == 8 and np.allclose(got, [want[i] for i in range(len(rows))], rtol=1e-9)
    model._open.clear()
    monkeypatch.setattr(shared_files.SharedFiles, "local", False, raising=False)
    monkeypatch.setattr(shared_files.SharedFiles, "__setattr__", lambda self, k, v: k == "local" or object.__setattr__(self, k, v))
    assert np.allclose(model.score(texts)["score"], got, rtol=0)


def test_kneser_ney_without_documents(spark):
    assert kneser_ney.held_out_scores(frame(spark, [])).collect() == []


# Language ID

SAMPLES = {"en": "the cat and the dog went to the house with a friend of mine ", "fr": "le chat et la souris sont dans la maison avec une amie très chère ", "de": "der hund und die katze gehen über die straße zu dem schönen haus "}


def test_language_id(spark):
    rows = [(n * 10 + i, SAMPLES[l] * (1 + i % 4), l, f"s{n}", 1) for n, l in enumerate(SAMPLES) for i in range(10)]
    model = language_id.fit(spark.createDataFrame(rows, DOCS))
    pages = [(1, "https://a.example.fr/x", f'<html lang="fr-FR"><script>the the the</script><p>{SAMPLES["fr"]}</p></html>'), (2, None, SAMPLES["en"]), (3, "http://h.de", None), (4, "http://h.de", '<html lang="de">12345 !!!</html>'),
             (5, "x", "zzqx kkvw 漢字 ыва " * 30), (6, "http://b.example.de/", f"<html lang=de>{SAMPLES['de'] * 3}</html>"), (6, "http://b.example.de/", f"<html lang=de>{SAMPLES['de'] * 3}</html>")]
    got = sorted((r.page_id, r.lang, r.declared, r.host) for r in language_id.identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect())
    assert got == [(1, "fr", "fr", "a.example.fr"), (2, "en", None, ""), (3, "und", None, "h.de"), (4, "und", "de", "h.de"), (5, "und", None, ""), (6, "de", "de", "b.example.de"), (6, "de", "de", "b.example.de")]
    docs = spark.createDataFrame([*rows, (100, None, "en", "s", 0), (101, "qqxz " * 50, "en", "s0", 0), (None, SAMPLES["en"], None, None, None)], DOCS)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in language_id.keep_identified(docs, model).collect()) == [-1, *range(30)]
    assert language_id.identify_documents(docs.limit(0), model).collect() == []


@pytest.mark.parametrize("limit", [500_000, 0])
def test_posteriors_equal_sums(spark, monkeypatch, limit):
    """All evidence added up in plain Python, row by row; columns with clashing names don't matter."""
    monkeypatch.setattr(language_id, "BROADCAST_ROWS", limit)
    rnd = random.Random(12)
    rows = [(n * 10 + i, SAMPLES[l] * (1 + i % 4), l, f"s{n}", 1) for n, l in enumerate(SAMPLES) for i in range(10)]
    model = language_id.fit(spark.createDataFrame(rows, DOCS))
    langs, k = model.langs, len(model.langs)
    pages = []
    for i in range(90):
        l = rnd.choice([*SAMPLES])
        words = SAMPLES[l].split() if rnd.random() < 0.9 else ["zq", "xxk", "42"]
        body = " ".join(rnd.choices(words, k=rnd.randint(0, 6)))
        tag = rnd.choice([f'<html lang="{l}">', "<html>", '<html lang="xx">'])
        pages.append((i, rnd.choice([None, "http://a.one.fr/x", "http://b.one.fr/", "https://two.de:80/?q", "http://c.three.fr"]), tag + body, "clash", 0.5))
    got = {r.page_id: r for r in language_id.identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string, lang string, posterior double"), model).collect()}

    def softmax(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    like, own, key, declared = {}, {}, {}, {}
    for i, url, page, *_ in pages:
        t = language_id.trigrams(language_id.visible_text(page))
        like[i] = [min(1, language_id.EVIDENCE / max(len(t), 1)) * sum(float(model.table[x, j]) for x in t) for j in range(k)]
        own[i] = softmax([x + math.log(0.999 / (k - 1) if j < k - 1 else 0.001) for j, x in enumerate(like[i])])
        host = re.sub(r"^\w+://|[:/?].*$", "", url or "")
        labels = host.split(".")
        key[i] = (labels[-1], ".".join(labels[-2:]), host)
        said = re.search('lang="(..)"', page)
        declared[i] = "" if not said else said[1] if said[1] in langs else "other"
    values = ["", "other", *langs[:-1]]
    table = [[0.5 + sum(own[i][j] for i in own if declared[i] == v) for j in range(k)] for v in values]
    total = [sum(o[j] for o in own.values()) for j in range(k)]
    for i in own:
        prior = [(x + language_id.PULL / k) / (sum(total) + language_id.PULL) for x in total]
        for level in (1, 2, 3):
            others = [sum(own[x][j] for x in own if key[x][:level] == key[i][:level] and x != i) for j in range(k)]
            prior = [(x + language_id.PULL * p) / (sum(others) + language_id.PULL) for x, p in zip(others, prior)]
        says = [table[values.index(declared[i])][j] / sum(row[j] for row in table) for j in range(k)]
        post = softmax([x + math.log(p + language_id.UND_PRIOR / k) + math.log(s) for x, p, s in zip(like[i], prior, says)])
        letters = len(language_id.trigrams(language_id.visible_text(pages[i][2])))
        if not letters:
            post = softmax([-50.0] * (k - 1) + [0.0])
        r = got[i]
        assert r.n_trigrams == letters and abs(r.posterior - max(post)) < 1.01e-6
        assert r.lang == langs[post.index(max(post))] and (r.declared or "") == declared[i] and r.host == key[i][2]


def test_rejected_documents_go(spark):
    """Unknown languages and rows whose text contradicts their label go, clean rows stay."""
    import corpus_pipeline

    rows = [(n * 10 + i, SAMPLES[l] * (1 + i % 4), l, f"s{i}", 1) for n, l in enumerate(SAMPLES) for i in range(10)]
    bad = [(100, "qqxz wvkj jjqz " * 40, "en", "s0", 0), (101, "12 34 --", "en", "s1", 0), (102, SAMPLES["de"] * 3, "fr", "s2", 0), (103, "漢字仮名交じり文" * 20, "en", "s3", 0)]
    mixed = [(200, SAMPLES["de"] * 5 + SAMPLES["fr"] * 3, "fr", "s4", 0), (201, "die", "en", "s4", 0)]
    kept = corpus_pipeline.language_id(spark, spark.createDataFrame(rows + bad + mixed, DOCS), "")
    assert sorted(r.doc_id for r in kept.collect()) == [*range(30), 200, 201]


def test_host_prior_decides_short_texts(spark):
    rows = [(n * 10 + i, SAMPLES[l] * 3, l, f"s{n}", 1) for n, l in enumerate(SAMPLES) for i in range(10)]
    docs = spark.createDataFrame([*rows, (200, "te", None, "s1", 2), (201, "te", None, "s2", 2)], DOCS)
    got = {r.doc_id: r.lang for r in language_id.identify_documents(docs, language_id.fit(docs)).collect()}
    assert got[200] == "fr" and got[201] == "de"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.filter("doc_id % 2 = 0"))
    other = docs.filter("doc_id % 2 = 1").withColumn("truth", F.col("lang")).withColumn("lang", F.lit(None).cast("string"))
    got = language_id.identify_documents(other, model).join(other.select("doc_id", "truth"), "doc_id")
    assert got.filter("lang = truth").count() >= 0.99 * got.count()


def test_language_id_fits_every_label(spark):
    rnd = random.Random(9)
    words = {f"l{i:02d}": ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for i in range(70)}
    rows = [(i, " ".join(rnd.choices(words[name], k=40)), name, "s", 1) for i, name in enumerate([*words] * 3)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.fit(docs)
    assert model.langs == [*words, language_id.UND]
    assert language_id.fit(docs.limit(0)).langs == [language_id.UND]
    got = {r.doc_id: r.lang for r in language_id.identify_documents(docs.withColumn("lang", F.lit(None).cast("string")), model).collect()}
    assert got == {i: name for i, _, name, *_ in rows}


# Line dedup


def test_line_dedup_cases(spark):
    w = "one two three four five six seven eight nine"
    rows = [(1, f"{w}\n\nShort line.\n{w} ten"), (2, f"  ONE two three four five six seven eight NINE\nshort LINE.\nshort line"), (3, f"{w.replace('five', 'FIFE')}\nnew\n"), (4, f"{w.replace('three ', '')}\nzero {w}"),
            (5, f"{w.replace('two', 'x').replace('six', 'y')}"), (6, None), (7, ""), (8, "dup\ndup\ndup"), (None, "dup")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_equal, r.n_near, r.n_chars) for r in line_dedup.deduplicate(spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_chars int")).collect()}
    assert got == {
        1: (f"{w}\n\nShort line.", 4, 0, 1, 9), 2: ("short line", 3, 2, 0, 9), 3: ("new\n", 3, 0, 1, 9), 4: ("", 2, 0, 2, 9), 5: (rows[4][1], 1, 0, 0, 9), 6: (None, 0, 0, 0, 9), 7: ("", 1, 0, 0, 9), 8: ("dup", 3, 2, 0, 9), None: ("", 1, 1, 0, 9),
    }
    kept = line_dedup.keep_new_lines(spark.createDataFrame([(*r, "en", "s", 9) for r in rows], DOCS))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id: r.n_chars for r in kept.collect()} == {1: len(w) + 13, 2: 10, 3: 4, 5: len(rows[4][1]), 6: None, 7: 0, 8: 3}
    assert line_dedup.deduplicate(frame(spark, [])).collect() == []


def test_line_dedup_clashing_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a\nb", 5), (1, "a\nb", 5), (2, "b\nc", 5)], "doc_id long, text string, n_lines int")
    assert sorted(tuple(r) for r in line_dedup.deduplicate(df).collect()) == [(1, "a\nb", 2, 0, 0), (1, "a\nb", 2, 0, 0), (2, "c", 2, 1, 0)]


@pytest.mark.parametrize("limit", [0, 500_000])
def test_line_dedup_random(spark, limit, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", limit)
    rnd = random.Random(6)
    lines = [[rnd.choice("abc") for _ in range(rnd.randint(8, 10))] for _ in range(60)]
    rows = [(i, "\n".join(" ".join(rnd.choice(lines)) if rnd.random() < 0.5 else " ".join(rnd.choice("abc") for _ in range(rnd.randint(7, 11))) for _ in range(5))) for i in range(60)]

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 8:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    seen, want = [], {}
    for i, t in rows:
        kept = []
        for line in t.split("\n"):
            x = line.split()
            if not any(x == y or near(x, y) for y in seen):
                kept.append(line)
            seen.append(x)
        want[i] = "\n".join(kept)
    got = {r.doc_id: r.text for r in line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_line_dedup_short_lines(spark):
    """Short lines, scripts without spaces and moved spaces, against all pairs compared."""
    rnd = random.Random(16)
    lines = ["anat with by of nteres atre are.", "anat with by of lyhaes atre are.", "線路は続くよどこまでも野を越え山越え", "線路は続くよどこまでも野を越え谷越え", "😀" * 30, "😀" * 31, "one note book of eight words and no more", "one notebook of eight words and no more",
             "Chapter headline", "Chapter headlines", "Chapterhead line", "abcdefg", "abcdefh", "=" * 40, "=" * 41, "ab cd efgh i", "a b c d e f g h i", "abcdefghx"]
    lines += ["".join(rnd.choice("ab ") for _ in range(rnd.randint(5, 22))) for _ in range(120)]
    rnd.shuffle(lines)
    rows = [(i, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(len(lines) // 3)]

    def one(a, b, least):
        a, b = sorted((a, b), key=len)
        if len(a) < least or len(b) - len(a) > 1:
            return False
        return sum(x != y for x, y in zip(a, b)) <= 1 if len(a) == len(b) else any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    def near(a, b):
        x, y = "".join(a), "".join(b)
        return one(a, b, 4) or x == y and len(x) >= 8 or max(len(a), len(b)) < 8 and one(x, y, 8)

    seen, want = [], {}
    for i, t in rows:
        words = [x.split() for x in t.split("\n")]
        want[i] = []
        for line, x in zip(t.split("\n"), words):
            if not x or not any(x == y or near(x, y) for y in seen):
                want[i].append(line)
            seen.append(x)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.deduplicate(df, min_words=4, min_chars=8).collect()}
    assert got == {i: "\n".join(x) for i, x in want.items()}
    assert sum(map(len, want.values())) < len(line_dedup.deduplicate(df).agg(F.array_join(F.collect_list("text"), "\n")).first()[0].split("\n"))


def test_pipeline_drops_near_copies_of_short_lines(spark):
    import corpus_pipeline

    rows = [(1, "anat with by of nteres atre are.\nkept", "en", "s", 0), (2, "anat with by of lyhaes atre are.\nother", "en", "s", 0), (3, "线路一直延伸到任何地方\nmore", "zh", "s", 0), (4, "线路一直延伸到任何地力\nlast", "zh", "s", 0)]
    got = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert got == {1: rows[0][1], 2: "other", 3: rows[2][1], 4: "last"}


# Jaccard join


def brute(rows, n, t):
    sets, by = {}, defaultdict(set)
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = frozenset(zip(*(w[k:] for k in range(n)))) if len(w) >= n else frozenset([tuple(w)] if w else [])
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("n,t,block,limit", [(3, Fraction(9, 10), 1024, 500_000), (5, Fraction(4, 5), 8, 0)])
def test_jaccard(spark, n, t, block, limit, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    rnd = random.Random(7)
    rows = []
    for base in range(12):
        w = [f"w{rnd.randrange(500)}" for _ in range(rnd.choice([3, 9, 12, 30, 80, 200, 700]))]
        for _ in range(rnd.choice([1, 3, 25])):
            x = list(w)
            for _ in range(rnd.randint(0, max(1, len(x) // 40))):
                x[rnd.randrange(len(x))] = f"n{rnd.randrange(9)}"
            rows.append((len(rows), " ".join(x).upper() if base % 2 else " ".join(x)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "two words"), (904, "Two  words"), (905, "one"), (906, "x " * 3000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked_components(spark.createDataFrame(rows, "doc_id long, text string"), n=n, threshold=t).collect()}
    want = brute(rows, n, t)
    assert got == want and sum(c != i for i, (_, c) in want.items()) > 10
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), n=n, threshold=t)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i)


@pytest.mark.parametrize("t", [Fraction(1, 2), Fraction(4, 5), Fraction(9, 10)])
def test_r_tree_leaves_out_no_link(t):
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 1 << 62, rng.integers(3, 300), dtype=np.uint64)) for _ in range(40)]
    sets = [np.unique(np.concatenate([rng.permutation(b)[: max(1, int(len(b) * rng.uniform(0.6, 1)))], rng.integers(0, 1 << 62, rng.integers(0, 9), dtype=np.uint64)])) for b in base for _ in range(25)]
    cell = jaccard_join.Cell(list(range(len(sets))), sets, t)
    tree = jaccard_join.RTree(cell.point, cell.size, t)
    row, at = tree.near(cell.point, cell.size)
    got = set(zip(row.tolist(), at.tolist()))
    want = {(i, j) for i in range(len(sets)) for j in range(i // 25 * 25, i // 25 * 25 + 25) if cell._verify(i, j)}
    assert len(tree.layers) == 3 and want <= got and len(want) > 1000
    assert len(got) < 0.5 * len(sets) ** 2
    top = list(range(len(sets)))
    for a, b in cell.links(np.arange(len(sets)), np.arange(len(sets))):
        top = [top[a] if x == top[b] else x for x in top]
    assert all((top[i] == top[j]) for i, j in want)


def test_jaccard_edges(spark):
    df = spark.createDataFrame([(2, "a b c d", 1), (1, "a b c d", 1), (1, "a b c d", 1), (None, "a b c d", 1)], "doc_id long, text string, component_id int")
    assert sorted(tuple(r) for r in jaccard_join.linked_components(df).collect()) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert jaccard_join.linked_components(df.limit(0)).collect() == []


def test_jaccard_low_threshold(spark):
    w = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(w[:8])), (2, " ".join(w[:16])), (3, " ".join(w[20:26])), (4, " ".join(w[20:38])), (5, " ".join(w[40:43]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked_components(spark.createDataFrame(rows, "doc_id long, text string"), n=1, threshold=Fraction(1, 3)).collect()}
    assert got == brute(rows, 1, Fraction(1, 3)) and got[2] == (16, 1) and got[4] == (18, 3)
    assert jaccard_join.one_of_each(spark.createDataFrame(rows[:2], "doc_id long, text string"), n=1, threshold=Fraction(1, 2)).count() == 1


def test_jaccard_different_texts_of_a_doc_id(spark):
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join(a[:-1])), (8, " ".join(b[:-1]))]
    got = sorted((r.doc_id, r.component_id) for r in jaccard_join.linked_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(5, 5), (5, 5), (7, 5), (8, 5)]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 75), (200, 201)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 75: 50, 100: 50, 200: 200, 201: 200}


# Decontamination


def edits(p: bytes, t: bytes) -> int:
    row = np.zeros(len(t) + 1, int)
    chars, j = np.frombuffer(t, np.uint8), np.arange(len(t) + 1)
    for i, c in enumerate(p, 1):
        new = np.concatenate([[i], np.minimum(row[:-1] + (chars != c), row[1:] + 1)])
        row = np.minimum.accumulate(new - j) + j
    return int(row.min())


def word(rnd):
    return "".join(rnd.choice("etaoin") for _ in range(rnd.randint(2, 7)))


@pytest.mark.parametrize("rate,min_bytes,block_bytes,hits", [(0.1, 8, 4 << 20, 1 << 20), (0.1, 1, 200, 5), (0.25, 3, 4 << 20, 100)])
def test_leaks_equal_alignment(spark, monkeypatch, rate, min_bytes, block_bytes, hits):
    monkeypatch.setattr(decontaminate, "HITS", hits)
    rnd = random.Random(8)
    items = [(i, " ".join(word(rnd) for _ in range(rnd.randint(3, 30)))) for i in range(12)] + [(50, None), (51, "tiny"), (52, ""), (53, "Same, passage of words!"), (54, "same passage of words"), (55, "ten bytes!"), (56, "Q"), (57, "fifteen letters"), (58, "ni ni ni ni ni ni ni ni ni")]
    docs = []
    for i in range(50):
        body = " ".join(word(rnd) for _ in range(rnd.randint(0, 80)))
        x = list(rnd.choice(items[:12] + items[-4:])[1])
        for _ in range(rnd.randint(0, len(x) // 7)):
            k = rnd.randrange(len(x))
            x[k : k + 1] = rnd.choice([[], ["z"], [x[k], "q"]])
        k = rnd.randint(0, len(body))
        docs.append((i, body[:k] + "".join(x).upper() + body[k:]))
    docs += [(90, None), (91, ""), (92, "SAME passage --- of words"), (92, "SAME passage --- of words"), (93, "filler " * 1000 + items[0][1]), (94, "ni " * 300)]
    want = {}
    for i, t in docs:
        for j, p in items:
            p, d = decontaminate.normal(p or ""), decontaminate.normal(t or "")
            if len(p) >= min_bytes and t is not None:
                e = edits(p, d)
                if e <= decontaminate.budget(len(p), rate):
                    want[i, j] = e
    dd, bb = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(dd, bb, rate=rate, min_bytes=min_bytes, block_bytes=block_bytes).collect()
    assert {(r.doc_id, r.item_id): r.n_edits for r in got} == want and len(want) > 15 and sum(r.doc_id == 92 for r in got) >= 4
    assert len(got) == len(want) + sum(i == 92 for i, _ in want)


def test_decontaminate_rows(spark, monkeypatch):
    dd = spark.createDataFrame([(1, "x " * 9 + "the wanted passage of a benchmark"), (2, "clean"), (3, None), (None, "the wanted passage of a benchmark")], "doc_id long, text string")
    bb = spark.createDataFrame([(7, "The wanted passage, of a benchmark.")], "item_id long, text string")
    for limit in (100_000, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in decontaminate.decontaminate(dd, bb).collect()) == [-1, 2, 3]
    assert decontaminate.leaks(dd, bb.limit(0)).collect() == [] and decontaminate.leaks(dd.limit(0), bb).collect() == []
    assert len(list(decontaminate.blocks(bb.union(bb).union(bb), 40, 8))) == 3


def test_leaks_among_many_short_texts_and_items():
    """More pairs of texts and items than 32 bits can number, in one part."""
    items = [b"%08d" % i for i in range(300_000)]
    texts = [b"zz"] * 9999 + [b"x %08d y" % 299_999]
    assert [(t, x, e) for t, x, _, e in decontaminate.Block(list(range(len(items))), items, 0.1).search(texts)] == [(9999, 299_999, 0)]


def test_leaks_in_repetitive_texts_are_bounded():
    tracemalloc.start()
    block = decontaminate.Block([1, 2, 3], [b"a" * 5_000, b"ab" * 300, b"a" * 400 + b"z" + b"a" * 400], 0.1)
    got = block.search([b"a" * 200_000, b"ab" * 50_000, b"a" * 300 + b"zz" + b"a" * 420])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(t, x): e for t, x, _, e in got}.items() >= {(0, 0): 0, (1, 1): 0, (0, 2): 1}.items()
    assert peak < 600 << 20
