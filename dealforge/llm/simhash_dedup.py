"""SimHash near-duplicates through vantage-point trees.

A document's fingerprint has a bit set where over half of its shingles'
64-bit hashes have it set. Fingerprints link at ``radius`` or fewer
differing bits; linked documents form components.

The bits are dealt into segments, so many that two linked fingerprints
differ in one bit of some segment at most. In each segment fixed vantage
points partition the values by Hamming distance: the rings in which a value
lies around the first ``SHARD_LEVELS`` points are its shard. By the triangle
inequality a value one bit away lies on the same or a neighbouring ring of
every point; a fingerprint is kept in its own shard and looked for in the
shards that a change of one bit can take it to. Within a shard a tree over
more vantage points leaves out the branches that the triangle bound rules
out, and what is left is compared in all bits. Nothing is approximate.

Equal fingerprints count once. Shards of many fingerprints are cut into
blocks, and each pair of blocks is looked at by itself. A task returns its
links as one row for each fingerprint that isn't the first of its kind
there, so a family of near copies gives no rows by pairs.

Null and empty texts and texts without words have the fingerprint zero,
linked like any other. A text of fewer words than a shingle has one shingle,
the whole sequence. Repeated rows are linked as equal fingerprints; rows of
one doc_id with different texts are linked each by its own. Rows with a null
doc_id take no part. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_or_merged
from .components import components
from .windows import mix, ranges

#: The seed of the shingles' hashes.
SEED = 42
#: Vantage points of a segment that make its shards, and those of the tree within a shard.
SHARD_LEVELS, TREE_LEVELS = 6, 4
#: Fingerprints of a shard, kept or looked for, that one block holds.
BLOCK = 1 << 16
#: Rows of a task's group, about.
GROUP_ROWS = 1 << 18
#: Hashes whose bits are counted together, fingerprints that go down a tree together, and candidates compared together.
COUNTED, ASKED, COMPARED = 1 << 16, 1 << 13, 1 << 20


def fingerprint(text: bytes, n: int = 4) -> int:
    """The SimHash of a text in UTF-8: its words in lower case (A-Z), shingles of n words with repeats."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    n = min(n, len(words))
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    first, last = start[: len(words) - n + 1], (start + size)[n - 1 :]
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(first), COUNTED):
        h = np.array([hashed(joined[a:z], SEED) for a, z in zip(first[i : i + COUNTED].tolist(), last[i : i + COUNTED].tolist(), strict=True)], "<u8")
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, n: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of the rows with a doc_id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(x, n) for x in b["body"]], np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(np.int64), "fp": fp.view(np.int64)})

    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body"))
    return rows.mapInPandas(run, "doc_id long, fp long")


class Rings:
    """Segments of the bits, vantage points in each, and the rings around them."""

    def __init__(self, radius: int) -> None:
        n = radius // 2 + 1  # one segment at least differs in radius // n <= 1 bits
        edge = np.arange(n + 1) * 64 // n
        self.bits = [np.uint64(1) << np.arange(a, z, dtype=np.uint64) for a, z in zip(edge[:-1], edge[1:], strict=True)]
        self.mask = np.array([x.sum(dtype=np.uint64) for x in self.bits], np.uint64)
        levels = SHARD_LEVELS + TREE_LEVELS
        self.point = mix(np.arange(1, n * levels + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(n, levels)

    def ring(self, fp: np.ndarray, segment: np.ndarray | int, level: int) -> np.ndarray:
        """Distance from the vantage point, in the segment."""
        return np.bitwise_count((fp ^ self.point[segment, level]) & self.mask[segment]).astype(np.int64)

    def shard(self, fp: np.ndarray, segment: int) -> np.ndarray:
        """The segment and the rings as one number; a ring is 64 at most."""
        out = np.full(fp.shape, segment, np.int64)
        for level in range(SHARD_LEVELS):
            out = out * 128 + self.ring(fp, segment, level)
        return out

    def visits(self, fp: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) of the shards with larger numbers that a change of one bit leads to, each once.

        Of two fingerprints in different shards, the one in the smaller shard looks for the other.
        """
        own = self.shard(fp, segment)
        near = np.sort(self.shard(fp[:, None] ^ self.bits[segment][None, :], segment), axis=1)
        new = np.concatenate([np.ones((len(fp), 1), bool), near[:, 1:] != near[:, :-1]], axis=1) & (near > own[:, None])
        row, col = np.nonzero(new)
        return row, near[row, col]


class VantageTree:
    """Fingerprints below roots (cells); a node's children are the rings around its level's vantage point."""

    def __init__(self, cell: np.ndarray, segment: np.ndarray, fp: np.ndarray, rings: Rings) -> None:
        self.rings = rings
        ring = [rings.ring(fp, segment, SHARD_LEVELS + i) for i in range(TREE_LEVELS)]
        self.order = np.lexsort((*ring[::-1], cell))
        self.layers = [np.unique(cell)]
        node = np.searchsorted(self.layers[0], cell[self.order])
        for r in ring:
            keys = node * 128 + r[self.order]
            layer, node = np.unique(keys, return_inverse=True)
            self.layers.append(layer)
        # the leaves' fingerprints are neighbours in self.order
        self.first = np.searchsorted(node, np.arange(len(self.layers[-1]) + 1))

    def near(self, cell: np.ndarray, segment: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row asked, place in the tree's input) that may be one bit apart in the segment, some at a time."""
        node = np.searchsorted(self.layers[0], cell)
        row = np.flatnonzero(self.layers[0][np.minimum(node, len(self.layers[0]) - 1)] == cell)
        node = node[row]
        for i, layer in enumerate(self.layers[1:]):
            at = node * 128 + self.rings.ring(fp[row], segment[row], SHARD_LEVELS + i)
            # ring - 1 of ring 0 is no ring of the node before it: rings end far below 127
            low, high = np.searchsorted(layer, at - 1), np.searchsorted(layer, at + 1, side="right")
            row, node = np.repeat(row, high - low), ranges(low, high - low)
        size = self.first[node + 1] - self.first[node]
        part = np.cumsum(size) // COMPARED
        edges = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[: len(part)]), len(part))
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            yield np.repeat(row[a:z], size[a:z]), self.order[ranges(self.first[node[a:z]], size[a:z])]


def _merge(top: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """top (the smallest known of each kind) after linking a with b."""
    while True:
        p, q = top[a], top[b]
        apart = p != q
        if not apart.any():
            return top
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(top, np.maximum(p, q), np.minimum(p, q))
        while (top[top] != top).any():
            top = top[top]


def _linked(df: pd.DataFrame, rings: Rings, radius: int) -> pd.DataFrame:
    """Links of a group's cells: a row (a, b) for each fingerprint's document that reaches a smaller one in them."""
    fp, ids = df["fp"].to_numpy().view(np.uint64), df["id"].to_numpy()
    segment = (df["shard"].to_numpy() >> (7 * SHARD_LEVELS)).astype(np.int64)
    cell = df.groupby(["shard", "h", "v"], sort=False).ngroup().to_numpy()
    kept, asks = np.flatnonzero(df["kept"].to_numpy()), np.flatnonzero(~df["kept"].to_numpy())
    home = df["home"].to_numpy()
    who, what = np.unique(ids, return_inverse=True)
    top = np.arange(len(who))
    if len(kept) and len(asks):
        tree = VantageTree(cell[kept], segment[kept], fp[kept], rings)
        for i in range(0, len(asks), ASKED):
            some = asks[i : i + ASKED]
            for row, at in tree.near(cell[some], segment[some], fp[some]):
                a, b = some[row], kept[at]
                # two of one shard meet twice there
                take = (np.bitwise_count(fp[a] ^ fp[b]) <= radius) & (~home[a] | (fp[a] < fp[b]))
                top = _merge(top, what[a[take]], what[b[take]])
    moved = np.flatnonzero(top != np.arange(len(top)))
    return pd.DataFrame({"a": who[moved], "b": who[top[moved]]})


def _places(distinct: DataFrame, rings: Rings) -> DataFrame:
    """shard, kept (else looked for), home (the fingerprint's own shard), fp, id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), ASKED):
                some = b[at : at + ASKED]
                fp, ids = some["fp"].to_numpy().view(np.uint64), some["id"].to_numpy()
                for s in range(len(rings.bits)):
                    own, all_rows = rings.shard(fp, s), np.arange(len(fp))
                    row, shard = rings.visits(fp, s)
                    rows = np.concatenate([all_rows, all_rows, row])
                    kept = np.arange(len(rows)) < len(fp)
                    home = np.arange(len(rows)) < 2 * len(fp)
                    yield pd.DataFrame({"shard": np.concatenate([own, own, shard]), "kept": kept, "home": home, "fp": fp[rows].view(np.int64), "id": ids[rows]})

    return distinct.mapInPandas(run, "shard long, kept boolean, home boolean, fp long, id long")


def near_links(distinct: DataFrame, *, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """``distinct`` has fp (each once) and id. Returns a, b: ids that reach each other by links, enough of them for all components."""
    rings = Rings(radius)
    placed = _places(distinct, rings)
    sizes = placed.groupBy("shard").agg(F.count(F.when(F.col("kept"), 1)).alias("h"), F.count(F.when(~F.col("kept"), 1)).alias("v"))
    sizes = cut(sizes.filter("h > 0").select("shard", F.ceil(F.col("h") / block).alias("hs"), F.ceil(F.col("v") / block).alias("vs"), (F.col("h") + F.col("v")).alias("n")))
    large = sizes.filter("hs > 1 OR vs > 1").select("shard", "hs", "vs")
    rows = sizes.agg(F.sum(F.col("n") * F.greatest("hs", "vs"))).first()[0] or 0
    one = F.lit(1).cast("long")
    sized = placed.join(small_or_merged(large), "shard", "left").withColumns({"hs": F.coalesce("hs", one), "vs": F.coalesce("vs", one)})
    # what is kept goes to one row of cells, what is looked for to one column
    mine = F.pmod(F.xxhash64("fp"), F.when(F.col("kept"), F.col("hs")).otherwise(F.col("vs")))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("kept"), F.col("vs")).otherwise(F.col("hs")) - 1)
    cells = sized.withColumns({"mine": mine, "other": others}).withColumn("other", F.explode("other"))
    cells = cells.select("shard", F.when(F.col("kept"), F.col("mine")).otherwise(F.col("other")).alias("h"), F.when(F.col("kept"), F.col("other")).otherwise(F.col("mine")).alias("v"), "kept", "home", "fp", "id")
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = F.pmod(F.xxhash64("shard", "h", "v"), F.lit(max(tasks, -(-rows // GROUP_ROWS))))
    return cells.groupBy(group.alias("g")).applyInPandas(lambda df: _linked(df, rings, radius), "a long, b long")


def linked_components(docs: DataFrame, *, n: int = 4, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reached by links, itself included)."""
    named = cut(fingerprints(docs, n=n))
    # the smallest doc_id stands for all of one fingerprint
    distinct = cut(named.groupBy("fp").agg(F.min("doc_id").alias("id")))
    reached = cut(components(near_links(distinct, radius=radius, block=block)))
    component = cut(distinct.join(small_or_merged(reached), "id", "left").select("fp", F.coalesce("component", "id").alias("component_id")))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return named.join(small_or_merged(component), "fp").select("doc_id", digits.alias("fingerprint"), "component_id")
