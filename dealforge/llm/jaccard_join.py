"""N-gram Jaccard join with R-trees over count vectors.

A document is the set of its distinct word n-grams, as 64-bit hashes. Tokens
are hashed into groups; the numbers of n-grams in each group are a point.
Two sets can't share more than the summed minima of their coordinates, so an
R-tree that keeps the largest coordinates of each node leaves out all nodes
that can't reach the overlap that the threshold asks for. What survives is
verified on the sets themselves.

Where Spark brings sets together: two linked sets of sizes a <= b differ in
D = a * (1 / t - 1) n-grams at most (t: the threshold). The n-grams of a set
are dealt by hash into more than D parts, so one part at least is the same
in both. Equal parts are found by hash; the smallest set that shares a part
leads the others, and all sets with one leader form a *cell*. The parts only
say which sets must meet: an R-tree joins those of a cell. At first a set
meets the smallest of its leaders only; cells that lie in one component after
that are done, so a family of near copies isn't sent once a cell. Large cells
are cut into blocks, and each pair of blocks is a task. Only links that join two components of a cell are returned, so a
cell of m sets gives fewer than m rows.

Equal sets count once. Null and empty texts, and texts without words, have
no n-grams and are linked with nothing. A text of fewer words than n has one
n-gram, the whole sequence. Repeated rows are linked as equal sets. Rows with
one doc_id and different texts are linked each by its own set; rows with a
null doc_id take no part. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import answer, gather, layout, rows
from .common import BROADCAST_ROWS, cut, small_or_merged
from .components import stars
from .windows import mix
from .words import WordArrays, parts

BATCH_BYTES, BUCKET_BYTES = 2 << 20, 16 << 20
#: Coordinates of a point, entries of an R-tree node, and sets of a block.
GROUPS, FAN, BLOCK = 128, 16, 1024
#: Sets that go down a tree together, and pairs of set and node that are compared at a time.
ASKED, PAIRS = 64, 4096
#: Bytes of sets that one group of cells and blocks holds, about; a cell's block stays whole.
GROUP_BYTES = 16 << 20
_LOW = np.uint64(0xFFFFFFFF)


def ngram_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text, words in lower case."""
    w = WordArrays(texts, lower=True)
    gram = w.ids
    for i in range(1, n):
        gram = mix(gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + w.ids[i:]) if len(gram) else gram
    out = []
    for a, z in zip(w.first, w.last, strict=True):
        if z - a >= n:
            out.append(np.unique(gram[a : z - n + 1]))
        elif z > a:
            x = np.array([z - a], np.uint64)
            for i in range(a, z):
                x = mix(x * np.uint64(3) ^ w.ids[i : i + 1])
            out.append(x)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name a set."""
    return int(mix(s).sum(dtype=np.uint64).astype(np.int64)), int(mix(s ^ np.uint64(0x5555555555555555)).sum(dtype=np.uint64).astype(np.int64))


class Parts:
    """How sets of each size are dealt into parts, for a threshold of num / den."""

    def __init__(self, threshold: Fraction) -> None:
        t = self.threshold = threshold
        self.differ = lambda a: int(a * (1 / t - 1))  # n-grams that two linked sets differ in, a: the smaller size
        self.low = [1]
        # sizes of class c: low[c] .. low[c + 1] - 1
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * 1.5)))

    def _of(self, c: int) -> tuple[int, int]:
        """Number of parts, and how many of them may be empty."""
        d = self.differ(self.low[c + 1] - 1)
        spare = 1 + int(np.ceil(2 * (d + 1) * np.exp(-self.low[c] / (d + 1))))
        return d + 1 + spare, spare

    def keys(self, s: np.ndarray) -> np.ndarray:
        """A key for each part of the set, in its class, and in all below where its partners may be."""
        n = len(s)
        c = int(np.searchsorted(self.low, n, side="right")) - 1
        out = []
        for k in range(c, -1, -1):
            if k != c and (self.differ(self.low[k + 1] - 1) < 1 or n > (self.low[k + 1] - 1) / self.threshold):
                break  # nor in the classes below
            if self.differ(n) < 1 and k == c and self.differ(self.low[k + 1] - 1) < 1:
                continue  # only equal sets can be linked
            p, spare = self._of(k)
            part = (mix(s + np.uint64(k)) % np.uint64(p)).astype(np.int64)
            size = np.bincount(part, minlength=p)
            order = np.argsort(part, kind="stable")
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(s[order] ^ np.uint64(0x77)), dtype=np.uint64)])
            at = np.cumsum(size)
            content = total[at] - total[at - size]
            # one part at least is the same and not empty, if not too many are empty
            take = size > 0 if (size == 0).sum() <= spare else np.ones(p, bool)
            place = np.uint64(k) * np.uint64(1 << 40) + np.arange(p, dtype=np.uint64)
            out.append(mix(mix(place) ^ (content + size.astype(np.uint64)))[take])
        return np.concatenate(out) if out else np.empty(0, np.uint64)


class RTree:
    """Points packed into nodes of ``FAN``, these into nodes again, up to one layer of ``FAN`` nodes at most.

    A node keeps the largest coordinates and the least and largest set size
    below it. The summed minima of its coordinates and a point's are at least
    the overlap with any set below, so a node is left out with all below it
    when they don't reach the overlap that its least set would need.
    """

    def __init__(self, point: np.ndarray, size: np.ndarray, threshold: Fraction) -> None:
        self.t = threshold
        # packed by size, then by the first coordinates, so that a node's points are near each other
        self.order = np.lexsort((point[:, 1], point[:, 0], size))
        point, size = point[self.order], size[self.order]
        self.layers = [(point, size, size)]
        while len(point) > FAN:
            at = np.arange(0, len(point), FAN)
            high, small, large = self.layers[-1]
            point = np.maximum.reduceat(high, at, axis=0)
            self.layers.append((point, np.minimum.reduceat(small, at), np.maximum.reduceat(large, at)))

    def _reach(self, layer: int, point: np.ndarray, size: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Which (row, node) may hold links."""
        high, small, large = self.layers[layer]
        num, den = self.t.numerator, self.t.denominator
        at = np.flatnonzero((small[node] * num <= size[row] * den) & (size[row] * num <= large[node] * den))
        f = self.t / (1 + self.t)  # least overlap: that share of both sizes, rounded up
        needs = -(-(size[row[at]] + np.minimum(small[node[at]], size[row[at]] * den // num)) * f.numerator // f.denominator)
        keep = [np.empty(0, np.int64)]
        for i in range(0, len(at), PAIRS):
            some = at[i : i + PAIRS]
            keep.append(some[np.minimum(high[node[some]], point[row[some]]).sum(1) >= needs[i : i + PAIRS]])
        return np.concatenate(keep)

    def near(self, point: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``point``, place in the tree's input) of all pairs that may be linked."""
        top = len(self.layers) - 1
        n = len(self.layers[top][1])
        row, node = np.repeat(np.arange(len(size)), n), np.tile(np.arange(n), len(size))
        for layer in range(top, -1, -1):
            keep = self._reach(layer, point, size, row, node)
            row, node = row[keep], node[keep]
            if layer:
                below = len(self.layers[layer - 1][1])
                row, node = np.repeat(row, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel()
                row, node = row[node < below], node[node < below]
        return row, self.order[node]


class Cell:
    """Joins the sets of a cell: an R-tree of their points, then the sets themselves. ``known``: their components so far."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], threshold: Fraction, known: np.ndarray | None = None) -> None:
        self.ids, self.sets, self.t = ids, sets, threshold
        self.size = np.array([len(s) for s in sets], np.int64)
        self.point = np.stack([np.bincount((mix(s) >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS) for s in sets]).astype(np.int32)
        first: dict[int, int] = {}
        self.top = list(range(len(ids))) if known is None else [first.setdefault(c, i) for i, c in enumerate(known.tolist())]

    def _find(self, x: int) -> int:
        while self.top[x] != x:
            self.top[x] = self.top[self.top[x]]
            x = self.top[x]
        return x

    def _verify(self, a: int, b: int) -> bool:
        both = len(np.intersect1d(self.sets[a], self.sets[b], assume_unique=True))
        return both * self.t.denominator >= self.t.numerator * (len(self.sets[a]) + len(self.sets[b]) - both)

    def links(self, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links between left and right (places in the cell) that join two components."""
        if not len(left) or not len(right):
            return
        tree = RTree(self.point[right], self.size[right], self.t)
        for i in range(0, len(left), ASKED):
            a = left[i : i + ASKED]
            row, at = tree.near(self.point[a], self.size[a])
            a, b = a[row], right[at]
            roots = np.array([self._find(x) for x in range(len(self.top))])
            apart = roots[a] != roots[b]
            for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
                p, q = self._find(x), self._find(y)
                if p != q and self._verify(x, y):
                    self.top[max(p, q)] = min(p, q)
                    yield self.ids[x], self.ids[y]


def _set_rows(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts(batches):
            sets = ngram_sets(b["body"].tolist(), n)
            prints = [fingerprint(s) for s in sets]
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "n": [len(s) for s in sets], "f1": [p for p, _ in prints], "f2": [p for _, p in prints]})

    return docs.mapInPandas(run, "doc_id long, n long, f1 long, f2 long")


class Batch:
    """The sets of a batch's documents, and their part keys."""

    def __init__(self, docs: pd.DataFrame, n: int, how: Parts, n_buckets: int) -> None:
        self.ids, self.sets, seen = [], [], {}
        ids = docs["doc_id"].to_numpy(np.int64)
        sets = ngram_sets(docs["body"].tolist(), n)
        for i in np.argsort(ids, kind="stable"):
            s = sets[i]
            if len(s) and seen.setdefault(fingerprint(s), ids[i]) == ids[i]:
                self.ids.append(int(ids[i]))
                self.sets.append(s)
        keys = [how.keys(s) for s in self.sets]
        self.of = np.repeat(np.arange(len(keys)), list(map(len, keys)))
        k = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        self.key = ((k >> np.uint64(32)) % np.uint64(n_buckets) << np.uint64(32)) | (k & _LOW)
        self.unique, self.inverse, self.count = np.unique(self.key, return_inverse=True, return_counts=True)


def linked_components(docs: DataFrame, *, n: int = 3, threshold: Fraction = Fraction(9, 10)) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reached by links).

    Two documents are linked if their sets' Jaccard similarity is ``threshold`` at least.
    """
    spark = docs.sparkSession
    how = Parts(Fraction(threshold))
    base = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_batches, n_buckets = layout(spark, total, BATCH_BYTES, BUCKET_BYTES)
    # the text is part of the hash: many rows with one doc_id don't meet in one batch
    batch = F.pmod(F.xxhash64("doc_id", "body"), F.lit(n_batches))
    by_batch = base.withColumn("batch", batch).groupBy("batch")

    # equal sets: the smallest doc_id stands for all
    named = cut(_set_rows(base, n))
    same = cut(named.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")).filter("copies > 1").select("f1", "f2", "n", "id"))
    named = named.join(small_or_merged(same), ["f1", "f2", "n"], "left").select("doc_id", "n", F.coalesce("id", "doc_id").alias("id"))

    # parts that more than one set has
    def send(df: pd.DataFrame) -> pd.DataFrame:
        b = Batch(df, n, how, n_buckets)
        return rows(df["batch"].iloc[0], b.unique >> np.uint64(32), low=(b.unique & _LOW).astype(np.uint32))

    def count(df: pd.DataFrame) -> pd.DataFrame:
        low, splits = gather(df, low=np.uint32)
        _, inverse, times = np.unique(low, return_inverse=True, return_counts=True)
        return answer(df, 1, times[inverse] > 1, splits)

    def members(df: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(df):
            return pd.DataFrame({"key": [], "f1": [], "f2": [], "id": [], "batch": [], "n": []})
        b = Batch(df, n, how, n_buckets)
        told = told.sort_values("bucket")["status"]
        repeated = np.concatenate([np.frombuffer(x, np.int8) for x in told]) > 0 if len(told) else np.zeros(0, bool)
        take = np.flatnonzero((repeated | (b.count > 1))[b.inverse])
        prints = np.array([fingerprint(s) for s in b.sets], np.int64).reshape(-1, 2)
        of, sizes = b.of[take], np.fromiter(map(len, b.sets), np.int64, len(b.sets))
        return pd.DataFrame({"key": b.key[take].view(np.int64), "f1": prints[of, 0], "f2": prints[of, 1], "id": np.array(b.ids, np.int64)[of], "batch": df["batch"].iloc[0], "n": sizes[of]})

    shared = by_batch.applyInPandas(send, "batch long, bucket long, low binary").groupBy("bucket").applyInPandas(count, "batch long, round int, bucket long, status binary")
    found = by_batch.cogroup(shared.groupBy("batch")).applyInPandas(members, "key long, f1 long, f2 long, id long, batch long, n long")
    # copies in other batches sent the same keys: the smallest doc_id of a set stays, with the batch that has it
    found = cut(found.groupBy("key", "f1", "f2").agg(F.min(F.struct("id", "batch")).alias("x"), F.first("n").alias("n")).select("key", "x.id", "x.batch", "f1", "n"))
    leaders = cut(found.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("c")).filter("c > 1").select("key", "lead"))
    cells = cut(found.join(leaders.hint("merge"), "key").select("lead", "id", "batch", "f1", "n").distinct())

    # most near copies are linked to the smallest of their leaders: one copy of each set tells
    followers = cells.groupBy("id", "f1").agg(F.min(F.struct("lead", "batch", "n")).alias("x")).select("id", "f1", "x.*").filter("id <> lead")
    sizes = small_or_merged(cut(followers.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))))
    whole = F.lit(0).cast("long")
    mine = followers.join(sizes, "lead").select("id", "batch", "f1", "n", "lead", F.pmod(F.xxhash64("id", "f1", "lead"), F.col("blocks")).alias("p"))
    heads = cells.filter("id = lead").join(sizes, "lead").select("id", "batch", "f1", "n", "lead", F.explode(F.sequence(whole, F.col("blocks") - 1)).alias("p"))
    star = mine.withColumn("own", F.lit(-1).cast("long")).unionByName(heads.withColumn("own", F.col("p"))).withColumns({"q": F.lit(-1).cast("long"), "c": F.col("id")})

    def fetch(df: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        if not len(df) or not len(want):
            return pd.DataFrame({"id": [], "lead": [], "p": [], "q": [], "own": [], "c": [], "grams": []})
        df = df[df["doc_id"].isin(want["id"])].drop_duplicates(["doc_id", "body"])
        # rows of one doc_id may hold different sets
        sets = {(i, fingerprint(s)[0]): s.tobytes() for i, s in zip(df["doc_id"], ngram_sets(df["body"].tolist(), n), strict=True)}
        return want[["id", "lead", "p", "q", "own", "c"]].assign(grams=[sets[x] for x in zip(want["id"], want["f1"], strict=True)])

    def join(df: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, p, q), cell in df.groupby(["lead", "p", "q"], sort=False):
            if len(cell) < 2:
                continue
            c = Cell(cell["id"].tolist(), [np.frombuffer(x, np.uint64) for x in cell["grams"]], how.threshold, cell["c"].to_numpy())
            own = cell["own"].to_numpy()
            out += c.links(np.flatnonzero(own == p), np.flatnonzero(own == q))
        return pd.DataFrame(out, columns=["a", "b"])

    def verified(asked: DataFrame) -> DataFrame:
        """Links of sets that are to meet: in (lead, p, q) those that are p's own meet those that are q's own; c: components known before."""
        # what is asked is worked out once for its ids and n-grams, and once more to be sent
        wanted = cut(asked.groupBy(F.col("id").alias("doc_id")).agg(F.sum("n").alias("grams")))
        n_ids, grams = wanted.agg(F.count("*"), F.sum("grams")).first()
        if not n_ids:
            return spark.createDataFrame([], "a long, b long")
        # few texts are wanted: they are picked before the shuffle
        few = base.join(F.broadcast(wanted.select("doc_id")), "doc_id", "left_semi") if n_ids <= BROADCAST_ROWS else base
        filled = few.withColumn("batch", batch).groupBy("batch").cogroup(asked.groupBy("batch")).applyInPandas(fetch, "id long, lead long, p long, q long, own long, c long, grams binary")
        n_groups = -(-8 * grams // GROUP_BYTES)
        group = F.pmod(F.xxhash64("lead", "p", "q"), F.lit(max(n_groups, n_batches)))
        return cut(filled.withColumn("g", group).groupBy("g").applyInPandas(join, "a long, b long"))

    first = verified(star)
    known = stars(first)

    # cells that lie in one component by now are done; of the others, blocks of large ones meet pairwise, and a block's number comes from a hash, so blocks are even
    told = cells.join(small_or_merged(known), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    open_ = cut(told.groupBy("lead").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.ceil(F.count("*") / BLOCK).alias("blocks")).filter("x < y").select("lead", "blocks"))
    placed = told.join(small_or_merged(open_), "lead").withColumn("own", F.pmod(F.xxhash64("id", "f1", "lead"), F.col("blocks")))
    pairs = placed.select("lead", "id", "batch", "f1", "n", "c", "own", F.explode(F.sequence(whole, F.col("blocks") - 1)).alias("other"))
    rest = verified(pairs.select("id", "batch", "f1", "n", "lead", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "c").distinct())
    reached = stars(known.select(F.col("id").alias("a"), F.col("component").alias("b")).union(rest))
    out = named.join(small_or_merged(reached), "id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def one_of_each(docs: DataFrame, *, n: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """``docs`` without those that reach a smaller doc_id by links. All rows of a kept doc_id stay, and rows with a null doc_id."""
    linked = linked_components(docs, n=n, threshold=threshold)
    gone = cut(linked.filter("component_id < doc_id").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct())
    return docs.join(small_or_merged(gone), "doc_id", "left_anti").select(docs.columns)


ORACLE = """
    WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    g AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN ws ELSE ws[i:i + 2] END AS g FROM (SELECT *, unnest(range(1, greatest(len(ws) - 2, least(len(ws), 1)) + 1)) AS i FROM t)),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))),
    r(id, low) AS (SELECT doc_id, doc_id FROM t UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.id WHERE r.low < e.b)
    SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, least(t.doc_id, c.low) AS component_id FROM t LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id, min(low) AS low FROM r GROUP BY id) c ON c.id = t.doc_id"""
