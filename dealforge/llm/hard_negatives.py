"""Hard-negative mining by threshold joins over a norm-bounded inverted index.

For each anchor: its best rows of the same label (positives), and for each of
these the best rows of other labels whose score lies in a window below the
positive's. Both are threshold joins: a block of rows is held as an inverted
index, and the anchors go past it in small groups.

The index has a posting list for each group of dimensions, its rows in the
order of their norm over these and all later dimensions. A row whose later
norm times the anchor's norm stays below the threshold needs no entry from
there on, so a list is read only as far as the bound leaves something open.
The entries read give partial scores; a pair whose partial score and the
product of both remaining norms stay below the threshold is left out, and
the others are completed. The threshold starts high and is lowered, the lists
being read on from where they were left, until the anchor's windows are full
or their floors reached. A floor is the window's own end, or the score that
enough rows of a sample of fixed size reach in it already.

Where Spark brings rows together: positives meet in blocks of one label (a
large label has several), negatives in blocks by hash of the id. A block's
rows are shuffled once and held by one task; anchors are sent to each block
and streamed past it, so neither grows with the number of anchors.

Rows with a null vec_id or label, a null vector, or a null or non-finite
component take no part. Shorter vectors count as padded with zeros. Of rows
with one vec_id the smallest vector, then the smallest label counts. Ties go
to the smaller vec_id. Extra columns are dropped. An empty table, or one
without anchors, gives an empty result. Vectors whose scores a double can't
hold exactly (a squared norm of 2**53 or more) raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, small_or_merged

#: Rows of the sample that dimensions' order and floors are taken from: those with the smallest hash of vec_id.
SAMPLE_ROWS = 2000
#: Rows of a block, and anchors that go past it together.
BLOCK, TOGETHER = 16_384, 128
#: Dimensions that share a posting list, and pairs that are completed together.
STEP, COMPLETED = 8, 1 << 16
#: How far down from a window's upper end to its floor the threshold is taken, one step after the other.
LOWERED = (0.125, 0.25, 0.5, 1.0)
_NONE = -(1 << 60)


def usable(vectors: DataFrame, scale: float = 256.0, *, label: Column | None = None) -> DataFrame:
    """vec_id, label, v: floor(scale * x) of every component as double. ``label``: in place of the column of that name."""
    at = F.col("label") if label is None else label
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), at.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e")).filter("vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL")
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # floor() of a double is a bigint, so whole numbers are cut off by hand to stay in double
    down = F.transform("e", lambda x: F.rint(x * scale) - F.when(F.rint(x * scale) > x * scale, 1.0).otherwise(0.0))
    return v.filter(finite).groupBy("vec_id").agg(F.min(F.struct(down.alias("v"), "label")).alias("x")).select("vec_id", "x.label", "x.v")


def _matrix(vs: pd.Series, order: np.ndarray) -> np.ndarray:
    """The vectors as rows, dimensions in ``order``."""
    out = np.zeros((len(vs), len(order)))
    for i, v in enumerate(vs):
        out[i, : len(v)] = v
    return out[:, order]


def _later_norms(x: np.ndarray) -> np.ndarray:
    """A column for each group of dimensions: the norm over it and all later ones; 0 at the end."""
    edges = np.arange(0, x.shape[1], STEP)
    sums = np.add.reduceat(x**2, edges, axis=1) if len(edges) else np.zeros((len(x), 0))
    return np.sqrt(np.concatenate([np.cumsum(sums[:, ::-1], axis=1)[:, ::-1], np.zeros((len(x), 1))], axis=1))


class Index:
    """The posting lists of a block."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.labels, self.x = ids, labels, x
        self.norms = _later_norms(x)
        self.lists = [np.argsort(-n, kind="stable") for n in self.norms.T[:-1]]
        self.listed = [-n[at] for n, at in zip(self.norms.T, self.lists, strict=False)]  # ascending


class Partial:
    """Partial scores of some anchors with a block, thresholds being lowered."""

    def __init__(self, index: Index, q: np.ndarray) -> None:
        self.index, self.q, self.norms = index, q, _later_norms(q)
        shape = len(q), len(index.ids)
        self.sums, self.known = np.zeros(shape), np.zeros(shape, bool)
        self.read = [0] * len(index.lists)  # entries read of each list
        self.depth = np.zeros(shape[1], np.int64)  # lists that have given the row's entries
        self.slack = 1e-9 * (1 + self.norms[:, :1] * index.norms[:, 0].max(initial=0.0))
        self.row, self.col, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.entries = self.completed = 0

    def lower(self, least: np.ndarray) -> None:
        """Afterwards row, col, score hold all pairs of ``least[row]`` or more, and some others. An anchor at infinity is done."""
        whole = self.norms[:, 0]
        live = np.flatnonzero(least < np.inf)
        if not len(live):
            return
        with np.errstate(divide="ignore", invalid="ignore"):
            theta = np.where(whole[live] > 0, (least[live] - self.slack[live, 0]) / whole[live], np.where(least[live] > 0, np.inf, -np.inf)).min()
        for g, (rows, listed) in enumerate(zip(self.index.lists, self.index.listed, strict=True)):
            to = int(np.searchsorted(listed, -theta, side="right"))
            new = rows[self.read[g] : to]
            if len(new):
                some = slice(g * STEP, (g + 1) * STEP)
                self.sums[:, new] += self.q[:, some] @ self.index.x[new, some].T
                self.depth[new], self.read[g] = g + 1, to
                self.entries += len(new)
        rest = self.index.norms[np.arange(len(self.depth)), self.depth]
        bound = self.sums[live] + self.norms[live][:, self.depth] * rest[None, :] + self.slack[live]
        row, col = np.nonzero((bound >= least[live][:, None]) & ~self.known[live])
        row = live[row]
        self.known[row, col] = True
        score = self.sums[row, col]
        open_ = np.flatnonzero(self.depth[col] < len(self.index.lists))
        for i in range(0, len(open_), COMPLETED):
            some = open_[i : i + COMPLETED]
            score[some] = np.einsum("ij,ij->i", self.q[row[some]], self.index.x[col[some]])
        self.completed += len(open_)
        self.row, self.col, self.score = np.append(self.row, row), np.append(self.col, col), np.append(self.score, score)


def _first(group: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each group's k best, ties to the smaller id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g) < k]


def _floors(scores: np.ndarray, fits: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """For each anchor and window the k-th best of the sample's scores in it, or its lower end."""
    out = low.copy()
    for w in range(low.shape[1]):
        inside = fits & (scores >= low[:, w : w + 1]) & (scores <= high[:, w : w + 1])
        if scores.shape[1] >= k:
            kth = -np.sort(np.where(inside, -scores, np.inf), axis=1)[:, k - 1]
            out[:, w] = np.where(np.isfinite(kth), kth, out[:, w])
    return out


def fill(index: Index, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, floor: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Partial]:
    """(anchor's row, window, row of the block, score) of the block's k best in each window, the floors being no higher than the k-th best of all blocks.

    low, high, floor: a row an anchor, a column a window; a window with
    high < low is empty.
    """
    part = Partial(index, q)
    # scores stay within the product of the norms
    most = np.floor(part.norms[:, 0] * index.norms[:, 0].max(initial=0.0) + 1)[:, None]
    empty = high < low
    top = np.where(empty, -np.inf, np.minimum(high, most)).max(1, initial=-np.inf)
    last = np.where(empty, np.inf, np.maximum(floor, -most)).min(1, initial=np.inf)
    done = (top < last) | empty.all(1)
    hits = [np.empty(0, np.int64)] * 3 + [np.empty(0)]
    for share in LOWERED:
        least = np.where(done, np.inf, np.ceil(top - share * (top - last)) if share < 1 else last)
        part.lower(least)
        keep = (part.score >= np.where(done, last, least)[part.row]) & ((labels[part.row] == index.labels[part.col]) == same) & (ids[part.row] != index.ids[part.col])
        row, col, score = part.row[keep], part.col[keep], part.score[keep]
        found = []
        full = np.zeros(low.shape, bool)
        for w in range(low.shape[1]):
            at = np.flatnonzero((score >= np.maximum(floor, low)[row, w]) & (score <= high[row, w]))
            at = at[_first(row[at], index.ids[col[at]], score[at], k)]
            full[:, w] = np.bincount(row[at], minlength=len(ids)) >= k
            found.append((row[at], np.full(len(at), w), col[at], score[at]))
        hits = [np.concatenate(x) for x in zip(*found, strict=True)] if found else hits
        # a full window has no better rows below the threshold, and an anchor's windows end together
        done |= (full | empty | (least[:, None] <= floor)).all(1)
        if done.all():
            break
    return *hits, part


_ROW = "grp long, part long, kind int, id long, label long, v array<double>, low array<double>, high array<double>"


def _join(rows: DataFrame, n_blocks: int, sample: pd.DataFrame, order: np.ndarray, k: int, same: bool) -> DataFrame:
    """``rows``: candidates (kind 0) and anchors with their windows (kind 1) by (grp, part). Returns the best of each block: anchor_id, w (number of the window), id, score."""
    s_ids, s_labels, s_x = sample["vec_id"].to_numpy(np.int64), sample["label"].to_numpy(np.int64), _matrix(sample["v"], order)

    def search(index: Index, asked: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for i in range(0, len(asked), TOGETHER):
            some = asked[i : i + TOGETHER]
            ids, labels, q = some["id"].to_numpy(np.int64), some["label"].to_numpy(np.int64), _matrix(some["v"], order)
            low, high = np.stack(some["low"].to_numpy()), np.stack(some["high"].to_numpy())
            fits = ((labels[:, None] == s_labels[None, :]) == same) & (ids[:, None] != s_ids[None, :])
            row, w, col, score, _ = fill(index, ids, labels, q, low, high, _floors(q @ s_x.T, fits, low, high, k), k, same)
            yield pd.DataFrame({"anchor_id": ids[row], "w": w.astype(np.int32), "id": index.ids[col], "score": np.rint(score).astype(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, index = None, [], None
        for b in batches:
            for (*key, kind), rows in b.groupby(["grp", "part", "kind"], sort=False):
                if key != at:
                    at, held, index = key, [], None
                if kind == 0:
                    held.append((rows["id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64), _matrix(rows["v"], order)))
                elif held:
                    index = index or Index(*map(np.concatenate, zip(*held, strict=True)))
                    yield from search(index, rows)

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a block's rows come first, then the anchors that go past it
    dealt = rows.repartition(max(tasks, min(n_blocks, 4096)), "grp", "part").sortWithinPartitions("grp", "part", "kind")
    return dealt.mapInPandas(run, "anchor_id long, w int, id long, score long")


def _best(hits: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best rows of each group, ranked; Spark limits each task's part of a group before the shuffle."""
    order = W.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, *, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, block: int = BLOCK) -> DataFrame:
    """``vectors`` as from ``usable``. Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Negatives have low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    spark = vectors.sparkSession
    rows = cut(vectors)
    n, n_anchors, dim, most = rows.agg(F.count("*"), F.count(F.when(is_anchor, 1)), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not n_anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if most >= 2.0**53:
        raise ValueError("components are too large for exact scores")
    # thinned by hash first, so that a task sends a few rows only
    thin = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 30)) < int(min(1.0, (2 * SAMPLE_ROWS + 100) / n) * (1 << 30)))
    sample = thin.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toPandas()
    order = np.argsort(-(_matrix(sample["v"], np.arange(dim)) ** 2).sum(0), kind="stable")
    array = lambda *x: F.array(*(F.lit(float(y)) for y in x))
    nothing = F.lit(None).cast("array<double>")

    def rows_of(df: DataFrame, grp: Column, part: Column, kind: int, lo: Column = nothing, hi: Column = nothing) -> DataFrame:
        return df.select(grp.cast("long").alias("grp"), part.cast("long").alias("part"), F.lit(kind).alias("kind"), F.col("vec_id").alias("id"), "label", "v", lo.alias("low"), hi.alias("high"))

    # positives: blocks of one label
    large = cut(rows.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("label", F.ceil(F.col("n") / block).alias("parts")))
    sized = rows.join(small_or_merged(large), "label", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    cands = rows_of(sized, F.col("label"), F.pmod(F.xxhash64("vec_id"), F.col("parts")), 0)
    asks = rows_of(sized.filter(is_anchor).withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))), F.col("label"), F.col("p"), 1, array(_NONE), array(-_NONE))
    n_blocks = -(-n // block)
    hits = _join(cands.unionByName(asks), n_blocks, sample, order, n_positives, True)
    positives = cut(_best(hits, n_positives, "anchor_id").select("anchor_id", F.struct("rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).alias("p")))
    # negatives: blocks by hash; an anchor has as many windows as positives
    windows = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    padded = lambda f, empty: F.transform(F.sequence(F.lit(0), F.lit(n_positives - 1)), lambda i: F.coalesce(f(F.get("ps", i)["positive_score"]), F.lit(float(empty))))
    upward = padded(lambda p: F.ceil(p * low / F.lit(100).cast("decimal(3,0)")).cast("double"), 1)
    downward = padded(lambda p: F.floor(p * high / F.lit(100).cast("decimal(3,0)")).cast("double"), 0)
    asked = rows.filter(is_anchor).join(windows.hint("merge"), F.col("vec_id") == F.col("anchor_id"))
    asks = rows_of(asked.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))), F.lit(0), F.col("b"), 1, upward, downward)
    cands = rows_of(rows, F.lit(0), F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)), 0)
    found = _best(_join(cands.unionByName(asks), n_blocks, sample, order, n_negatives, False), n_negatives, "anchor_id", "w")
    pos = positives.select("anchor_id", (F.col("p.rank") - 1).alias("w"), "p.positive_id", "p.positive_score")
    return found.join(pos, ["anchor_id", "w"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
    p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
    n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                 row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
          FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
