"""Substring dedup of words by compacting a De Bruijn graph in Spark.

Edges are runs of ``k`` words (k = 50), neighbours overlapping in k - 1. A
document is a path; it is cut into *pieces*, runs of edges with the same
least 8-word gram, so that a passage gives the same inner pieces wherever it
stands. Joins then compact the graph:

1. equal pieces become one path, with the coordinates (document, first edge)
   of its first source; a piece whose document is larger repeats;
2. pieces that follow each other in their document and at their sources are
   one nonbranching path, a *span* of any length;
3. the words of every span are compared with those at its source's
   coordinates, as 128-bit digests of the words themselves;
4. where several paths share a gram the graph may branch inside a piece, and
   the same holds for a span whose words differ from its source's: such
   edges are dealt out one by one, and equal edges are joined again.

Grouping is by content ids with partial sums, and each join is between many
rows and one row a content, so Spark can split a hot content by rows. Null
and empty texts have no words. Repeated rows and ties of doc_id are
documents none of which is smaller. A null doc_id counts as larger than all
others. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut
from .windows import covered, mix, pair, ranges, segments, sliding_min
from .words import SPACE, WordArrays, parts

GRAM = 8
NO_ID = np.iinfo(np.int64).max


class Words(WordArrays):
    """The words of some texts with the ids of their grams and edges."""

    def __init__(self, texts: list[bytes], k: int) -> None:
        super().__init__(texts)
        self.k = k

    @cached_property
    def grams(self) -> np.ndarray:
        return pair(pair(pair(self.ids, 1), 2), 4)

    @cached_property
    def edges(self) -> np.ndarray:
        ids, depth = self.grams, GRAM
        while depth * 2 <= self.k:
            ids, depth = pair(ids, depth), depth * 2
        return pair(ids, self.k - depth) if depth < self.k else ids

    def joined(self, words: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Some words with a space after each, and where each begins, the last one's end included."""
        size = self.end[words] - self.start[words] + 1
        out = self.data[ranges(self.start[words], size)]
        return np.where(SPACE[out], np.uint8(32), out).tobytes(), np.concatenate([[0], np.cumsum(size)])

    def edge_valid(self, k: int) -> np.ndarray:
        n = len(self.edges)
        return np.arange(n) + k <= self.last[self.text_of[:n]]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _pack(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """First edge and number of edges as one number."""
    return (first.astype(np.int64) << 32) | n.astype(np.int64)


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return at >> 32, at & 0xFFFFFFFF


def _pieces(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts(batches):
            w = Words(b["body"].tolist(), k)
            if not len(w.edges):
                continue
            n = len(w.edges)
            first, size, h, s = segments(sliding_min(w.grams, k - GRAM + 1)[:n], w.text_of[:n], w.edge_valid(k), w.edges)
            t = w.text_of[first]
            yield pd.DataFrame({"key": b["key"].to_numpy()[t], "row": b["row"].to_numpy()[t], "h": _signed(mix(h)), "s": _signed(s), "at": _pack(first - w.first[t], size)})

    return run


def _edges(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts(batches):
            w = Words(b["body"].tolist(), k)
            got = [np.unique(ranges(*_unpack(np.asarray(x, np.int64)))) for x in b["pieces"]]
            t = np.repeat(np.arange(len(b)), list(map(len, got)))
            at = np.concatenate(got)
            yield pd.DataFrame({"key": b["key"].to_numpy()[t], "row": b["row"].to_numpy()[t], "e": _signed(w.edges[at + w.first[t]]), "at": _pack(at, np.ones(len(at)))})

    return run


def _digests(k: int):
    """Rows with lists first and n of runs of edges: each run with a digest of its words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts(batches):
            w = Words(b["body"].tolist(), k)
            words, at = w.joined(np.arange(len(w.start)))
            more = [c for c in ("skey", "srow", "sfirst") if c in b]
            size = b["first"].str.len().to_numpy()
            t = np.repeat(np.arange(len(b)), size)
            out = {c: np.concatenate(b[c].to_numpy()) for c in ("first", "n", *more)}
            low = out["first"] + w.first[t]
            digest = [hashlib.blake2b(words[at[i] : at[j]], digest_size=16).digest() for i, j in zip(low, low + out["n"] + k - 1, strict=True)]
            yield pd.DataFrame({"key": b["key"].to_numpy()[t], "row": b["row"].to_numpy()[t], **out, "digest": digest})

    return run


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id (as text, as pandas would make numbers beside nulls doubles), key (doc_id, or a largest value), row (a hash of the text) and body."""
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body"))
    return base.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("doc_id", F.lit(int(NO_ID))).alias("key"), F.xxhash64("body").alias("row"), "body")


def _first(at: Column) -> Column:
    return F.shiftright(at, 32)


def _size(at: Column) -> Column:
    return at.bitwiseAND(F.lit(0xFFFFFFFF))


def spans(pieces: DataFrame) -> DataFrame:
    """key, row, first, n, skey, srow, sfirst: pieces (key, row, at, source) that follow each other in the document and at their sources, as one."""
    c = F.col
    by_place = W.partitionBy("key", "row").orderBy("at")
    p = pieces.select("key", "row", "at", _first(c("at")).alias("first"), _size(c("at")).alias("n"), c("source.key").alias("skey"), c("source.row").alias("srow"), _first(c("source.at")).alias("sfirst"))
    before = F.lag(F.struct("first", "n", "skey", "srow", "sfirst")).over(by_place)
    p = p.withColumn("before", before)
    follows = (c("before.first") + c("before.n") == c("first")) & (c("before.sfirst") + c("before.n") == c("sfirst")) & (c("before.skey") == c("skey")) & (c("before.srow") == c("srow"))
    p = p.withColumn("span", F.sum(F.when(follows, 0).otherwise(1)).over(by_place.rowsBetween(W.unboundedPreceding, 0)))
    return p.groupBy("key", "row", "span").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.first("skey").alias("skey"), F.first("srow").alias("srow"), F.min("sfirst").alias("sfirst")).drop("span")


def compared(rows: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``found`` spans with same: whether their words are those at the source's coordinates."""
    schema = "key long, row long, first long, n long, skey long, srow long, sfirst long, digest binary"
    x = F.sort_array(F.collect_list(F.struct("first", "n", "skey", "srow", "sfirst"))).alias("x")
    asked = found.groupBy("key", "row").agg(x).select("key", "row", *(F.col(f"x.{c}").alias(c) for c in ("first", "n", "skey", "srow", "sfirst")))
    own = rows.join(asked.hint("merge"), ["key", "row"]).mapInPandas(_digests(k), schema)
    # each place at a source once, however many spans point there
    places = found.select(F.col("skey").alias("key"), F.col("srow").alias("row"), F.col("sfirst").alias("first"), "n").distinct()
    places = places.groupBy("key", "row").agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("x")).select("key", "row", F.col("x.first").alias("first"), F.col("x.n").alias("n"))
    there = rows.join(places.hint("merge"), ["key", "row"]).mapInPandas(_digests(k), "key long, row long, first long, n long, digest binary")
    there = there.groupBy(F.col("key").alias("skey"), F.col("row").alias("srow"), F.col("first").alias("sfirst"), "n").agg(F.first("digest").alias("said"))
    return own.join(there.hint("merge"), ["skey", "srow", "sfirst", "n"]).select("key", "row", "first", "n", "skey", "srow", "sfirst", (F.col("digest") == F.col("said")).alias("same"))


def repeated_edges(rows: DataFrame, k: int = 50) -> DataFrame:
    """key, row, gone: packed (first edge, number of edges) of the edges that also start in a smaller document.

    ``rows`` keeps all its columns wherever it is joined, so that its texts
    are shuffled once and that exchange is used again.
    """
    if k < 2 * GRAM:
        raise ValueError(f"k must be {2 * GRAM} at least")
    pieces = rows.select("key", "row", "body").mapInPandas(_pieces(k), "key long, row long, h long, s long, at long")
    # a row a gram: is there one path or are there several, and where is the first source?
    grams = pieces.groupBy("h").agg(F.min("s").alias("s0"), F.max("s").alias("s1"), F.min(F.struct("key", "row", "at")).alias("source"), F.max("key").alias("last"))
    grams = cut(grams.filter("s0 < s1 OR source.key < last").select("h", "s0", "s1", "source"))
    known = pieces.join(grams.hint("merge"), "h")
    unlike = (F.col("s0") != F.col("s1")) | ((F.col("s") == F.col("s0")) & (_size(F.col("at")) != _size(F.col("source.at"))))
    # stored, as several branches of the plan go on from it
    known = cut(known.select("h", "s", "key", "row", "at", "source", unlike.alias("branches")).filter("branches OR key > source.key"))
    forked = known.filter("branches").select("h", "s", "key", "row", "at")
    paths = forked.groupBy("h", "s").agg(F.min(F.struct("key", "row", "at")).alias("source"))
    whole = (F.col("key") > F.col("source.key")) & (_size(F.col("at")) == _size(F.col("source.at")))
    forked = cut(forked.join(paths.hint("merge"), ["h", "s"]).select("key", "row", "at", "source", whole.alias("whole")))
    checked = compared(rows, spans(known.filter("NOT branches").select("key", "row", "at", "source").union(forked.filter("whole").drop("whole"))), k)
    packed = lambda key, row, first: (F.col(key).alias("key"), F.col(row).alias("row"), F.shiftleft(F.col(first), 32).bitwiseOR(F.col("n")).alias("at"))
    own, source = packed("key", "row", "first"), packed("skey", "srow", "sfirst")
    unlike = checked.filter("NOT same")
    opened = forked.filter("NOT whole").select("key", "row", "at").union(unlike.select(*own)).union(unlike.select(*source))
    opened = opened.groupBy("key", "row").agg(F.collect_set("at").alias("pieces"))
    edges = rows.join(opened.hint("merge"), ["key", "row"]).mapInPandas(_edges(k), "key long, row long, e long, at long")
    first = edges.groupBy("e").agg(F.min("key").alias("source"), F.max("key").alias("last")).filter("last > source").select("e", "source")
    repeats = edges.join(first.hint("merge"), "e").filter("key > source").select("key", "row", "at")
    return checked.filter("same").select(*own).union(repeats).groupBy("key", "row").agg(F.collect_set("at").alias("gone"))


def _removed(b: pd.DataFrame, w: Words, k: int) -> np.ndarray:
    """Whether each word of the batch goes."""
    starts = [ranges(*_unpack(np.asarray(x, np.int64))) + f for x, f in zip(b["gone"], w.first, strict=True) if x is not None]
    return covered(np.concatenate(starts), k, len(w.start)) if starts else np.zeros(len(w.start), bool)


def _with_gone(docs: DataFrame, k: int) -> DataFrame:
    rows = rows_of(docs)
    return rows.join(repeated_edges(rows, k).hint("merge"), ["key", "row"], "left")


def _kept(b: pd.DataFrame, k: int) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Words, removed words, the kept words joined by one space, and whether each word goes."""
    w = Words(b["body"].tolist(), k)
    gone = _removed(b, w, k)
    kept = np.flatnonzero(~gone)
    out, begin = w.joined(kept)
    cut = begin[np.concatenate([[0], np.cumsum(~gone)])]
    for i, n in enumerate(w.counts):
        a, z = w.first[i], w.last[i]
        yield int(n), int(gone[a:z].sum()), out[cut[a] : cut[z]][:-1], gone[a:z]


def digests(docs: DataFrame, *, k: int = 50) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts(batches):
            rows = [(n, m, hashlib.sha256(x).hexdigest()) for n, m, x, _ in _kept(b, k)]
            out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    return _with_gone(docs, k).mapInPandas(run, "doc_id string, n_words long, n_removed long, kept_sha256 string").withColumn("doc_id", F.col("doc_id").cast("long"))


def deduplicate(docs: DataFrame, *, k: int = 50) -> DataFrame:
    """Per document: doc_id, kept (its words joined by spaces), spans (first and end word removed)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts(batches):
            rows = []
            for _, _, x, gone in _kept(b, k):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2)
                rows.append((x.decode(), [{"start": int(p), "end": int(q)} for p, q in edge]))
            out = pd.DataFrame(rows, columns=["kept", "spans"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    return _with_gone(docs, k).mapInPandas(run, "doc_id string, kept string, spans array<struct<start: long, end: long>>").withColumn("doc_id", F.col("doc_id").cast("long"))


ORACLE = """
    WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    p AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 49 <= len(ws) THEN array_to_string(ws[i:i + 49], ' ') END AS w FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM d)),
    m AS (SELECT w, min(doc_id) AS low FROM p WHERE w IS NOT NULL GROUP BY w HAVING min(doc_id) < max(doc_id)),
    c AS (SELECT doc_id, i, word, max(m.low < doc_id) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS TRUE AS gone FROM p LEFT JOIN m USING (w))
    SELECT d.doc_id, len(any_value(ws)) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id"""
