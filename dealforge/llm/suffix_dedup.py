"""Suffix-array dedup of bytes by bucket-pointer refinement over Spark.

A full sort of all suffixes isn't needed to find strings of ``length`` bytes
that repeat: it is enough to refine the buckets of the suffix array to that
depth. A bucket id stands for the first bytes of a suffix. Ids of depth 8
are refined by the ids of suffixes 8 later to depth 16, those again to 32,
and so on to ``length``: each round reuses what the one before it made.
Buckets that hold a single suffix need no more refinement, so only those
that repeat are dealt out by Spark, in three rounds of ever longer strings:

1. ids of 24-byte grams: the least of the 27 grams of a window names it;
2. segments, that is runs of windows with the same least gram;
3. single windows of ``length`` bytes, for segments that share their gram
   but differ, as at the ends of a repeated passage.

In each round a batch of documents sends its distinct ids with the least
doc_id that it knows, so that a hot string is one entry a batch, and gets
back one status an entry. Texts are shuffled once; the later rounds reuse
that exchange.

Ids of buckets are made from the bytes by the batch itself and are not ranks
that Spark hands out: a rank for every suffix would be eight bytes out and
back for each byte of text. So equal ids are checked by a second id of other
arithmetic: windows agree in 96 bits, segments in 96 bits and their gram.

Null and empty texts have no bytes. Repeated rows and ties of doc_id are
separate documents, none smaller than the other. A null doc_id counts as
larger than all others. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import answer, gather, layout, rows
from .windows import covered, mix, ranges, scan_bytes, segments

GRAM = 24
#: Bytes of text in a batch, and bytes of text whose ids meet in one bucket group.
BATCH_BYTES, BUCKET_BYTES = 2 << 20, 16 << 20
#: Differing segments of one gram that a batch lists; with more it says only that the gram is hot, and its windows are compared.
LISTED = 64
NO_ID = np.iinfo(np.int64).max
_HOT = np.iinfo(np.int64).min
_LOW = np.uint64(0xFFFFFFFF)


class Batch:
    """The documents of one batch, and what the rounds have told about them."""

    def __init__(self, docs: pd.DataFrame, told: pd.DataFrame | None, n_buckets: int, length: int) -> None:
        texts = docs["body"].tolist()
        self.ids = docs["key"].to_numpy(np.int64)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.n_buckets, self.length = np.uint64(n_buckets), length
        self.asked = told is not None
        self.told = {} if told is None else {k: g.sort_values("bucket")["status"].tolist() for k, g in told.groupby("round")}

    @cached_property
    def parts(self) -> tuple:
        """first, n, key, s, check, doc of each segment; the key holds bucket and gram."""
        # before anything was told only the grams count
        low, self.windows, second = scan_bytes(self.data, self.length, GRAM, want_windows=self.asked)
        doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)[: len(low)]
        valid = np.arange(len(low)) + self.length <= np.repeat(self.ends, self.sizes)[: len(low)]
        first, n, h, *sums = segments(low, doc, valid, *((self.windows, second) if self.asked else ()))
        s, check = sums or (None, None)
        h = mix(h)  # a least value is small; spread it again
        if self.asked:
            self.second, check = _top(second), _top(check)
        return first, n, ((h >> np.uint64(32)) % self.n_buckets << np.uint64(32)) | (h & _LOW), s, check, self.ids[doc[first]]

    def status(self, k: int) -> np.ndarray:
        return np.concatenate([np.frombuffer(x, np.int8) for x in self.told[k]]) if self.told.get(k) else np.empty(0, np.int8)

    # round 1: grams
    @cached_property
    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.unique(self.parts[2], return_inverse=True, return_counts=True)

    # round 2: segments of grams that repeat
    @cached_property
    def repeated(self) -> dict:
        _, inverse, counts = self.grams
        first, n, key, s, check, doc = self.parts
        take = np.flatnonzero(((self.status(1) > 0) | (counts > 1))[inverse])
        order = take[np.lexsort((doc[take], check[take], s[take], key[take]))]
        key, s, check, doc = key[order], s[order], check[order], doc[order]
        new_key, new = _starts(key), _starts(key, s, check)
        at = np.flatnonzero(new)  # the least doc of each distinct segment
        group = np.cumsum(new) - 1
        key_of = np.cumsum(new_key)[at] - 1
        hot = np.bincount(key_of, minlength=1)[key_of] > LISTED if len(at) else np.empty(0, bool)
        sent = ~hot | np.concatenate([[True], key_of[1:] != key_of[:-1]])[: len(at)]
        return {"first": first[order], "n": n[order], "doc": doc, "least": doc[at][group], "group": group, "key": key[at], "s": s[at], "check": check[at], "d": doc[at], "hot": hot, "sent": sent, "key_of": key_of}

    # round 3: windows of segments that differ under one gram
    @cached_property
    def open(self) -> dict:
        r = self.repeated
        told = self.status(2)
        entry = np.cumsum(r["sent"]) - 1  # a hot gram's segments share its one entry
        of_group = told[entry] if len(told) else np.empty(0, np.int8)
        seg = of_group[r["group"]] if len(of_group) else np.empty(0, np.int8)
        later = r["doc"] > r["least"]
        take = (seg >= 2) & ~later
        at, doc = ranges(r["first"][take], r["n"][take]), np.repeat(r["doc"][take], r["n"][take])
        # sent by bucket, then ids
        bucket = (mix(self.windows[at]) >> np.uint64(32)) % self.n_buckets
        order = np.lexsort((doc, self.second[at], self.windows[at], bucket))
        at, doc, bucket = at[order], doc[order], bucket[order]
        w, check = self.windows[at], self.second[at]
        new = _starts(w, check)
        lead = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        return {"whole": (seg == 1) | later, "at": at, "doc": doc, "group": group, "w": w[lead], "check": check[lead], "d": doc[lead], "bucket": bucket[lead].astype(np.int64)}

    def removed(self) -> np.ndarray:
        """Whether each byte of the batch goes."""
        r, o = self.repeated, self.open
        starts = [ranges(r["first"][o["whole"]], r["n"][o["whole"]])]
        if len(o["w"]):
            starts.append(o["at"][(self.status(3) > 0)[o["group"]] | (o["doc"] > o["d"][o["group"]])])
        return covered(np.concatenate(starts), self.length, len(self.data))


def _planes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low and high halves of doc_ids; the high ones shrink to nothing when compressed."""
    return (ids & 0xFFFFFFFF).astype(np.uint32), (ids >> 32).astype(np.int32)


def _top(ids: np.ndarray) -> np.ndarray:
    return (ids >> np.uint64(32)).astype(np.uint32)


def _starts(*cols: np.ndarray) -> np.ndarray:
    """Where a new run of equal values begins in sorted columns."""
    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return new


def _same(*cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the columns (the first counts most), and group numbers in that order."""
    order = np.lexsort(cols[::-1])
    return order, np.cumsum(_starts(*(c[order] for c in cols))) - 1


def _round1(df: pd.DataFrame) -> pd.DataFrame:
    low, splits = gather(df, low=np.uint32)
    _, inverse, n = np.unique(low, return_inverse=True, return_counts=True)
    return answer(df, 1, n[inverse] > 1, splits)


def _ids(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return lo.astype(np.int64) | (hi.astype(np.int64) << 32)


def _round2(df: pd.DataFrame) -> pd.DataFrame:
    """0: known here alone; 1: also in a smaller document; 2: compare the windows."""
    low, s, check, lo, hi, splits = gather(df, low=np.uint32, s=np.uint64, check=np.uint32, d_lo=np.uint32, d_hi=np.int32)
    d = _ids(lo, hi)
    order, group = _same(low, s, check)
    least = np.full(group[-1] + 1, NO_ID)
    np.minimum.at(least, group, d[order])
    distinct = np.unique(np.stack([low[order].astype(np.uint64), group.astype(np.uint64)]), axis=1)[0]
    grams, kinds = np.unique(distinct, return_counts=True)
    at = np.searchsorted(grams, low.astype(np.uint64))
    hot = np.zeros(len(grams), bool)
    hot[at[d == _HOT]] = True
    status = np.zeros(len(d), np.int8)
    status[order] = np.where(d[order] > least[group], 1, 0)
    status[(status == 0) & (kinds[at] > 1)] = 2
    status[hot[at]] = 2
    return answer(df, 2, status, splits)


def _round3(df: pd.DataFrame) -> pd.DataFrame:
    w, check, lo, hi, splits = gather(df, w=np.uint64, check=np.uint32, d_lo=np.uint32, d_hi=np.int32)
    d = _ids(lo, hi)
    order, group = _same(w, check)
    least = np.full(group[-1] + 1, NO_ID)
    np.minimum.at(least, group, d[order])
    status = np.zeros(len(d), np.int8)
    status[order] = d[order] > least[group]
    return answer(df, 3, status, splits)


def repeated_bytes(docs: DataFrame, finish: Callable[[Batch, np.ndarray, pd.DataFrame], pd.DataFrame], schema: str, *, length: int = 50) -> DataFrame:
    """Run the rounds; ``finish`` gets each batch, its removed bytes and its rows (doc_id, key, body)."""
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} at least")
    spark = docs.sparkSession
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    base = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("key"), body.alias("body"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_batches, n_buckets = layout(spark, total, BATCH_BYTES, BUCKET_BYTES)
    # The text is part of the hash: many rows with one doc_id don't meet in one batch.
    by_batch = base.withColumn("batch", F.pmod(F.xxhash64("key", "body"), F.lit(n_batches))).groupBy("batch")
    told = "batch long, round int, bucket long, status binary"

    def send1(df: pd.DataFrame) -> pd.DataFrame:
        u = Batch(df, None, n_buckets, length).grams[0]
        return rows(df["batch"].iloc[0], u >> np.uint64(32), low=(u & _LOW).astype(np.uint32))

    def send2(df: pd.DataFrame, so_far: pd.DataFrame) -> pd.DataFrame:
        if not len(df):
            return pd.DataFrame({"batch": [], "bucket": [], "low": [], "s": [], "check": [], "d_lo": [], "d_hi": []})
        r = Batch(df, so_far, n_buckets, length).repeated
        t = r["sent"]
        lo, hi = _planes(np.where(r["hot"], _HOT, r["d"])[t])
        s, check = np.where(r["hot"], np.uint64(0), r["s"])[t], np.where(r["hot"], np.uint32(0), r["check"])[t]
        return rows(df["batch"].iloc[0], r["key"][t] >> np.uint64(32), low=(r["key"][t] & _LOW).astype(np.uint32), s=s, check=check, d_lo=lo, d_hi=hi)

    def send3(df: pd.DataFrame, so_far: pd.DataFrame) -> pd.DataFrame:
        if not len(df):
            return pd.DataFrame({"batch": [], "bucket": [], "w": [], "check": [], "d_lo": [], "d_hi": []})
        o = Batch(df, so_far, n_buckets, length).open
        lo, hi = _planes(o["d"])
        return rows(df["batch"].iloc[0], o["bucket"], w=o["w"], check=o["check"], d_lo=lo, d_hi=hi)

    names = [x.split()[0] for x in schema.split(",")]

    def last(df: pd.DataFrame, so_far: pd.DataFrame) -> pd.DataFrame:
        if not len(df):
            return pd.DataFrame({n: [] for n in names})
        b = Batch(df, so_far, n_buckets, length)
        return finish(b, b.removed(), df)

    first = by_batch.applyInPandas(send1, "batch long, bucket long, low binary").groupBy("bucket").applyInPandas(_round1, told)
    with_docs = lambda so_far, f, kind: by_batch.cogroup(so_far.groupBy("batch")).applyInPandas(f, kind)
    second = with_docs(first, send2, "batch long, bucket long, low binary, s binary, check binary, d_lo binary, d_hi binary").groupBy("bucket").applyInPandas(_round2, told)
    third = with_docs(first.union(second), send3, "batch long, bucket long, w binary, check binary, d_lo binary, d_hi binary").groupBy("bucket").applyInPandas(_round3, told)
    # ids go as text: with a null among them pandas would make them doubles
    done = with_docs(first.union(second).union(third), last, schema.replace("doc_id long", "doc_id string"))
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))


def _kept(b: Batch, gone: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for end, n in zip(b.ends, b.sizes, strict=True):
        yield b.data[end - n : end], gone[end - n : end]


def _spans(gone: np.ndarray) -> np.ndarray:
    """start and end of each maximal removed run."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    return edge.reshape(-1, 2)


def digests(docs: DataFrame, *, length: int = 50) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def finish(b: Batch, gone: np.ndarray, df: pd.DataFrame) -> pd.DataFrame:
        rows = [(len(x), int(g.sum()), len(_spans(g)), hashlib.sha256(x[~g].tobytes()).hexdigest()) for x, g in _kept(b, gone)]
        out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
        out.insert(0, "doc_id", df["doc_id"].to_numpy())
        return out

    return repeated_bytes(docs, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length=length)


def deduplicate(docs: DataFrame, *, length: int = 50) -> DataFrame:
    """Per document: doc_id, kept (binary), spans (start and end bytes removed)."""

    def finish(b: Batch, gone: np.ndarray, df: pd.DataFrame) -> pd.DataFrame:
        rows = [(x[~g].tobytes(), [{"start": int(p), "end": int(q)} for p, q in _spans(g)]) for x, g in _kept(b, gone)]
        out = pd.DataFrame(rows, columns=["kept", "spans"])
        out.insert(0, "doc_id", df["doc_id"].to_numpy())
        return out

    return repeated_bytes(docs, finish, "doc_id long, kept binary, spans array<struct<start: long, end: long>>", length=length)


ORACLE = """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    k AS (SELECT doc_id, k, length(h) // 2 AS n, substr(h, 512 * k + 1, 610) AS s FROM (SELECT *, unnest(range((length(h) + 511) // 512)) AS k FROM d)),
    p AS (SELECT doc_id, 256 * k + j AS i, substr(s, 2 * j + 1, 2) AS byte, substr(s, 2 * j + 1, 100) AS w FROM (SELECT *, unnest(range(least(256, n - 256 * k))) AS j FROM k)),
    m AS (SELECT w, min(doc_id) AS low FROM p WHERE length(w) = 100 GROUP BY w HAVING min(doc_id) < max(doc_id)),
    c AS (SELECT doc_id, i, byte, max(m.low < doc_id) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS TRUE AS gone FROM p LEFT JOIN m USING (w)),
    s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM c)
    SELECT d.doc_id, length(any_value(h)) // 2 AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, sha256(unhex(coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), ''))) AS kept_sha256
    FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""
