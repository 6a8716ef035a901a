"""Benchmark decontamination by the q-gram lemma and banded alignment.

A benchmark item of m bytes occurs in a document if some stretch of the
document is within k = floor(rate * m) edits of it. Such a stretch shares at
least m + 1 - q * (k + 1) q-grams with the item, all on k + 1 neighbouring
diagonals. Shared q-grams are counted in overlapping bands of 2 * (k + 1)
diagonals; bands that reach the bound are aligned within the band, and kept
if the alignment needs k edits at most. q is 8, or for short items the
largest number whose bound is one shared q-gram, so the bound never fails.

Both sides are compared in lower case with every run of other characters
than letters and digits as one space. Items of fewer than ``min_bytes`` such
bytes are found by chance all over, so by default (8) they aren't searched;
with ``min_bytes`` of 1 every item is. Null texts hold nothing and null items
aren't searched; empty documents hold nothing. Equal items are each reported,
repeated documents too. Documents are searched whole, however long. Extra
columns don't matter.

Memory is bounded for any text: grams that an item repeats are one entry for
each k + 1 offsets, shared grams are counted ``HITS`` at a time, and bands are
judged and dropped when the scan has passed them.

The benchmark is the stated query set: it goes through the driver in blocks
of ``BLOCK_BYTES`` at most, one held at a time. Several blocks are written to
the shared folder, and a task that has read ``HELD_BYTES`` of texts takes one
block after the other through them, so the documents are read once however
many there are. No document leaves its task before it is known to hold an
item.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_dir
from .shared_files import SharedFiles
from .windows import bytes8
from .words import parts

Q = 8
BLOCK_BYTES = 4 << 20
#: Bytes of texts that a task holds while it takes the blocks through them; a longer text is held alone.
HELD_BYTES = 32 << 20
#: Shared grams that are counted at a time, and cells of alignments that are filled at a time.
HITS, CELLS = 1 << 20, 1 << 20
_BITS = 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_OTHER = re.compile(r"[\W_]+")


def normal(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def budget(m: int, rate: float) -> int:
    """Edits allowed for an item of m bytes."""
    return int(rate * m)


def gram_size(m: int, rate: float) -> int:
    """The largest q up to ``Q`` for which an occurrence shares one q-gram at least."""
    return max(1, min(Q, m // (budget(m, rate) + 1)))


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """The q bytes from each position as one number."""
    if q == 8:
        return bytes8(data)
    n = max(0, len(data) - q + 1)
    out = np.zeros(n, np.uint64)
    for i in range(q):
        out |= data[i : i + n].astype(np.uint64) << np.uint64(8 * i)
    return out


def align(item: np.ndarray, texts: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Least edits of the item against a stretch of each row of ``texts``, above k: k + 1.

    Cell (i, d) stands for the first i bytes of the item and the row up to
    place i + d, d from 0 to the row's length less the item's. Only places
    low .. high of a row belong to its text.
    """
    n, width = len(texts), texts.shape[1] - len(item) + 1
    d, far = np.arange(width, dtype=np.int32), np.int32(k + 1)
    low, high = low[:, None], high[:, None]
    row = np.where((d >= low) & (d <= high), 0, far).astype(np.int32)
    for i in range(1, len(item) + 1):
        j = d + i
        new = np.where(j > low, row + (texts[:, i - 1 : i - 1 + width] != item[i - 1]), far).astype(np.int32)
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)  # the item's byte is left out of the text
        new = np.minimum.accumulate(new - d, axis=1) + d  # the text has bytes more
        row = np.where((j >= low) & (j <= high), np.minimum(new, far), far)
        if row.min() >= far:
            return np.full(n, far)
    return row.min(axis=1)


class Index:
    """Benchmark items of one gram size, ready to be looked for."""

    def __init__(self, places: list[int], items: list[bytes], rate: float, q: int) -> None:
        self.places, self.items, self.q = places, [np.frombuffer(x, np.uint8) for x in items], q
        self.m = np.array([len(x) for x in items], np.int64)
        self.k = np.array([budget(len(x), rate) for x in items], np.int64)
        self.least, self.width = self.m + 1 - q * (self.k + 1), self.k + 1
        gram = [grams(x, q) for x in self.items]
        item = np.repeat(np.arange(len(gram)), list(map(len, gram)))
        offset = np.concatenate([np.arange(len(g)) for g in gram])
        # offsets of a gram within one stretch of k + 1 are one entry: the least and the largest of them say which cells are met
        stretch, rest = offset // self.width[item], offset % self.width[item]
        gram = np.concatenate(gram)
        order = np.lexsort((stretch, item, gram))
        gram, item, stretch, rest = gram[order], item[order], stretch[order], rest[order]
        at = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (item[1:] != item[:-1]) | (stretch[1:] != stretch[:-1])]))
        self.rest_low, self.rest_high = np.minimum.reduceat(rest, at), np.maximum.reduceat(rest, at)
        self.item, self.stretch = item[at], stretch[at]
        self.gram, self.first = np.unique(gram[at], return_index=True)
        self.count = np.diff(np.append(self.first, len(at)))
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.gram * _MULT) >> np.uint64(64 - _BITS)] = True

    def _hits(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions in order and the entries that they share, some at a time; a position stays whole."""
        for a in range(0, len(data) - self.q + 1, 1 << 16):
            g = grams(data[a : a + (1 << 16) + self.q - 1], self.q)
            at = np.flatnonzero(self.seen[(g * _MULT) >> np.uint64(64 - _BITS)])
            where = np.minimum(np.searchsorted(self.gram, g[at]), len(self.gram) - 1)
            hit = self.gram[where] == g[at]
            at, where = at[hit] + a, where[hit]
            if not len(at):
                continue
            n = self.count[where]
            some = (np.cumsum(n) - 1) // HITS
            cuts = np.flatnonzero(np.diff(some)) + 1
            for pos, w, size in zip(np.split(at, cuts), np.split(where, cuts), np.split(n, cuts), strict=True):
                each = np.repeat(np.arange(len(pos)), size)
                yield pos[each], np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size) + self.first[w][each]

    def bands(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """item and first cell of each band that reaches its bound; a place may count twice, never less than once.

        Cell c of an item holds the diagonals from c * (k + 1) - m on, a band
        is a cell with shared grams and the one after it. What begins in an
        empty cell before is within the k diagonals that alignment adds.
        """
        key, n = np.empty(0, np.int64), np.empty(0, np.int64)
        out = [key]

        def judge(upto: int | None) -> None:
            nonlocal key, n
            item, cell = key >> 40, key & ((1 << 40) - 1)
            both = n.copy()
            both[:-1] += np.where(key[1:] == key[:-1] + 1, n[1:], 0)
            passed = np.ones(len(key), bool) if upto is None else (cell + 2) * self.width[item] <= upto
            out.append(key[passed & (both >= self.least[item])])
            key, n = key[~passed], n[~passed]

        for pos, entry in self._hits(data):
            item = self.item[entry]
            place, rest = np.divmod(pos + self.m[item], self.width[item])
            cell = (item << 40) | (place - self.stretch[entry])
            met = np.sort(np.concatenate([key, cell[rest >= self.rest_low[entry]], cell[rest < self.rest_high[entry]] - 1]))
            at = np.flatnonzero(np.concatenate([[True], met[1:] != met[:-1]]))
            count = np.diff(np.append(at, len(met)))
            if len(key):
                count[np.searchsorted(met[at], key)] += n - 1
            key, n = met[at], count
            judge(int(pos[-1]))
        judge(None)
        found = np.concatenate(out)
        return found >> 40, found & ((1 << 40) - 1)

    def search(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, place of the item, first byte at least, edits) of each item that a text of ``data`` holds."""
        item, cell = self.bands(data)
        for x in np.unique(item).tolist():
            m, k, w = int(self.m[x]), int(self.k[x]), int(self.width[x])
            raw, own = self.items[x].tobytes(), np.unique(grams(self.items[x], self.q), return_counts=True)
            found: dict[int, tuple[int, int]] = {}
            open_ = defaultdict(list)
            # an occurrence leaves the band of its shared grams by k diagonals at most
            length = m + 2 * w + 2 * k - 1
            for low in (cell[item == x] * w - m - k).tolist():
                t = int(np.searchsorted(start + size, max(low, 0), side="right"))
                while t < len(start) and start[t] < low + length:
                    begin, end = max(int(start[t]), low), min(int(start[t] + size[t]), low + length)
                    if end - begin >= m - k and found.get(t, (0, 1))[1]:
                        region = data[begin:end]
                        at = region.tobytes().find(raw)
                        if at >= 0:
                            found[t] = (begin + at, 0)
                        elif k and self._shares(region, own, int(self.least[x])):
                            open_[t].append((low, begin, end))
                    t += 1
            todo = [(t, *r) for t, regions in open_.items() if t not in found for r in regions]
            step = max(1, CELLS // length)
            for a in range(0, len(todo), step):
                some = todo[a : a + step]
                texts = np.zeros((len(some), length), np.uint8)
                for row, (_, low, begin, end) in zip(texts, some, strict=True):
                    row[begin - low : end - low] = data[begin:end]
                bounds = np.array([(begin - low, end - low) for _, low, begin, end in some], np.int32)
                for (t, _, begin, _), edits in zip(some, align(self.items[x], texts, bounds[:, 0], bounds[:, 1], k).tolist(), strict=True):
                    if edits <= k and edits < found.get(t, (0, k + 1))[1]:
                        found[t] = (begin, edits)
            for t, (begin, edits) in found.items():
                yield t, self.places[x], begin - int(start[t]), edits

    def _shares(self, region: np.ndarray, own: tuple[np.ndarray, np.ndarray], least: int) -> bool:
        """Whether places of the region, and of the item, that share a gram reach the bound."""
        gram, times = own
        there = grams(region, self.q)
        at = np.minimum(np.searchsorted(gram, there), len(gram) - 1)
        at = at[gram[at] == there]
        return len(at) >= least and int(times[np.unique(at)].sum()) >= least


class Block:
    """Some benchmark items, by the gram size that they need."""

    def __init__(self, ids: list[int], items: list[bytes], rate: float) -> None:
        self.ids = np.array(ids, np.int64)
        by_size = defaultdict(list)
        for place, x in enumerate(items):
            by_size[gram_size(len(x), rate)].append(place)
        self.indexes = [Index(at, [items[i] for i in at], rate, q) for q, at in by_size.items()]

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(text, item, first byte at least, edits) of each item that a text holds."""
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        start = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        return [hit for index in self.indexes for hit in index.search(data, start, size)]


#: The block that this worker looked with last.
_LAST: dict[str, Block] = {}


def blocks(benchmark: DataFrame, size: int, min_bytes: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Ids and normal forms of items, ``size`` bytes of them at a time."""
    ids, items, held = [], [], 0
    for r in benchmark.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        x = normal(r["text"])
        if len(x) >= max(min_bytes, 1):
            if items and held + len(x) > size:
                yield ids, items
                ids, items, held = [], [], 0
            ids.append(r["item_id"])
            items.append(x)
            held += len(x)
    if items:
        yield ids, items


def leaks(docs: DataFrame, benchmark: DataFrame, *, rate: float = 0.1, min_bytes: int = Q, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and item it holds: doc_id, item_id, n_edits, from_byte (of the normal form, at least)."""
    schema = "doc_id long, item_id long, n_edits int, from_byte long"
    # ids go as text: with a null among them pandas would make them doubles
    rows = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.encode("text", "UTF-8").alias("body"))

    def hits(name: str, load: Callable[[], tuple[list[int], list[bytes]]], held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _LAST:
            _LAST.clear()
            _LAST[name] = Block(*load(), rate)
        block = _LAST[name]
        for b in held:
            found = block.search([normal(x.decode("utf-8", "replace")) for x in b["body"]])
            doc = b["doc_id"].to_numpy()
            yield pd.DataFrame([(doc[t], block.ids[x], e, at) for t, x, at, e in found], columns=["doc_id", "item_id", "n_edits", "from_byte"])

    every = blocks(benchmark, block_bytes, min_bytes)
    first, second = next(every, None), next(every, None)
    if first is None:
        return docs.sparkSession.createDataFrame([], schema)
    name = uuid.uuid4().hex
    if second is None:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in parts(batches):
                yield from hits(name, lambda: first, [b])

    else:
        at, n = fresh_dir(docs.sparkSession, "benchmark"), 0
        for block in chain([first, second], every):
            SharedFiles(at).put(str(n), pickle.dumps(block))
            n += 1
        first = second = None

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            files, held, size = SharedFiles(at), [], 0

            def walk() -> Iterator[pd.DataFrame]:
                for i in range(n) if held else ():
                    yield from hits(f"{name}-{i}", lambda i=i: pickle.loads(files.read(str(i))), held)

            for b in parts(batches):
                held.append(b)
                size += int(b["body"].str.len().sum())
                if size >= HELD_BYTES:
                    yield from walk()
                    held, size = [], 0
            yield from walk()

    return rows.mapInPandas(run, schema.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))


#: Ids of leaking documents up to which they are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, rate: float = 0.1) -> DataFrame:
    """``docs`` without those that hold an item. Rows with a null doc_id stay."""
    gone = cut(leaks(docs, benchmark, rate=rate).select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "doc_id", "left_anti").select(docs.columns)
