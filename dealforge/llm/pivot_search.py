"""Exact top-k inner products by pivot-table elimination.

Distances from every vector to a set of pivots are computed once and kept
beside the vectors. For a query the largest difference of pivot distances is
a lower bound on the distance to a candidate, hence
``(|x|^2 + |q|^2 - bound^2) / 2`` is an upper bound on their inner product.
Each query's candidates are evaluated in the order of its own bounds until
they fall below its k-th best score, so no score is missed.

Vectors are packed into blocks with those near the same pivot. A block keeps
its least and largest distance to each pivot, so pairs of blocks that can't
reach any floor are dropped before they meet.

Vectors that are null or hold null or non-finite components take no part.
Shorter vectors count as padded with zeros. Of rows with one vec_id the
smallest vector counts. Ties go to the smaller vec_id. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Rows from which the pivots and the first thresholds are taken: those with the smallest hash of vec_id among a thinned part.
SAMPLE_ROWS = 2000
N_PIVOTS = 32
#: Rows packed into one block, of candidates and of queries.
CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 1024
#: Candidates that a query evaluates between two looks at its stopping bound, and queries that go together.
STEP, TOGETHER = 256, 128
#: Blocks of candidates up to which their pivot distances (about half a kilobyte each) go through the driver; beyond it every pair of blocks meets.
KNOWN_BLOCKS = 1 << 16


def usable(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id, v: floor(scale * x) of every component as double."""
    v = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # floor() of a double is a bigint, so whole numbers are cut off by hand to stay in double
    down = F.transform("e", lambda x: F.rint(x * scale) - F.when(F.rint(x * scale) > x * scale, 1.0).otherwise(0.0))
    return v.filter(finite).select("vec_id", down.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice, from the row nearest to the mean."""
    at = [int(np.argmin(((sample - sample.mean(0)) ** 2).sum(1)))]
    far = ((sample - sample[at[0]]) ** 2).sum(1)
    while len(at) < min(n, len(sample)) and far.max() > 0:
        at.append(int(np.argmax(far)))
        far = np.minimum(far, ((sample - sample[at[-1]]) ** 2).sum(1))
    return sample[at]


def _matrix(vs: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(vs), dim))
    for i, v in enumerate(vs):
        out[i, : len(v)] = v
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d2, 0))


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, ties to the smaller id."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.searchsorted(query, query)
    take = np.arange(len(query)) - first < k
    return query[take], ids[take], scores[take]


def _bounds(q: dict, c: dict) -> np.ndarray:
    """Upper bounds of all inner products, a row a query."""
    out = np.zeros((len(q["ids"]), len(c["ids"])), np.float32)
    c_far, q_far = c["far"].T.astype(np.float32), q["far"].astype(np.float32)
    gap = np.empty_like(out)
    for p in range(len(c_far)):
        np.subtract(c_far[p][None, :], q_far[:, p][:, None], out=gap)
        np.abs(gap, out=gap)
        np.maximum(out, gap, out=out)
    np.multiply(out, out, out=out)
    np.subtract((c["sq"][None, :] + q["sq"][:, None]).astype(np.float32), out, out=out)
    # the bounds are single floats: the slack covers their rounding many times over
    return out / 2 + np.float32(1e-5 * (1 + c["sq"].max() + q["sq"].max()))


def _search(q: dict, c: dict, k: int, exact32: bool) -> tuple[pd.DataFrame, int]:
    """Best k of one candidate block for every query of one query block, and the number of scores evaluated.

    Every query goes through the candidates in the order of its own bounds,
    ``STEP`` at a time, and leaves when the next one is below its floor.
    """
    kind = np.float32 if exact32 else np.float64
    c_v, q_v, floor, evaluated = c["v"].astype(kind), q["v"].astype(kind), q["seed"].copy(), 0
    out = []
    for a in range(0, len(q["ids"]), TOGETHER):
        some = slice(a, a + TOGETHER)
        q_ids, least = q["ids"][some], floor[some]
        upper = _bounds({x: q[x][some] for x in ("ids", "far", "sq")}, c)
        order = np.argsort(-upper, axis=1)
        best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for at in range(0, order.shape[1], STEP):
            live = np.flatnonzero(np.take_along_axis(upper, order[:, at : at + 1], 1)[:, 0] >= least)
            if not len(live):
                break
            cand = order[live, at : at + STEP]
            scores = np.matmul(c_v[cand], q_v[some][live][:, :, None])[:, :, 0]
            evaluated += scores.size
            row, col = np.nonzero(scores >= least[live][:, None])
            who, what, score = live[row], c["ids"][cand[row, col]], scores[row, col].astype(float)
            other = what != q_ids[who]
            best = _best(np.concatenate([best[0], who[other]]), np.concatenate([best[1], what[other]]), np.concatenate([best[2], score[other]]), k)
            n = np.bincount(best[0], minlength=len(least))
            full = np.flatnonzero(n >= k)
            least[full] = np.maximum(least[full], best[2][np.cumsum(n)[full] - 1])
        out.append(pd.DataFrame({"query_id": q_ids[best[0]], "vec_id": best[1], "score": np.rint(best[2]).astype(np.int64)}))
    return pd.concat(out, ignore_index=True), evaluated


def _reachable(q: dict, known: dict) -> np.ndarray:
    """Candidate blocks whose best possible score reaches the least floor of a query block, the best first.

    q: lo, hi (distances to the pivots), sq (largest square norm), floor;
    known: the same of all candidate blocks, and their numbers.
    """
    gap = np.maximum(np.maximum(known["lo"] - q["hi"], q["lo"] - known["hi"]), 0.0).max(1)
    upper = (known["sq"] + q["sq"] - gap**2) / 2 + 1e-5 * (1 + known["sq"] + q["sq"])
    take = np.flatnonzero(upper >= q["floor"])
    return known["block"][take[np.argsort(-upper[take])]]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, *, n_pivots: int = N_PIVOTS) -> DataFrame:
    """For each row of ``usable`` vectors that ``is_query`` holds for: query_id, rank, vec_id, score.

    Blocks of queries are sent to the blocks of candidates that they can't do
    without, and go past them one after the other. A sample of fixed size comes to the
    driver, to choose pivots.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n, n_q, dim, most = vectors.agg(F.count("*"), F.count(F.when(is_query, 1)), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not n_q:
        return empty
    # partial sums stay below the largest square norm, so whole numbers stay exact
    if most >= 2.0**53:
        raise ValueError("components are too large for exact scores")
    # thinned by hash first, so that a task sends a few rows only
    thin = vectors.filter(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 30)) < int(min(1.0, (2 * SAMPLE_ROWS + 100) / n) * (1 << 30)))
    sample = thin.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toPandas()
    if not len(sample):
        sample = vectors.limit(SAMPLE_ROWS).toPandas()
    s_ids, s_v = sample["vec_id"].to_numpy(), _matrix(sample["v"], dim)
    pivots = _pivots(s_v, n_pivots)
    def numbered(rows: DataFrame, total: int, size: int) -> DataFrame:
        """Rows with block: the nearest of the first pivots, as many as blocks are needed, and a part of its rows by hash where the sample says that they are many."""
        centres = pivots[: max(1, total // size)]
        share = np.bincount(_distances(s_v, centres).argmin(1), minlength=len(centres)) / len(s_v)
        n_parts = np.maximum(1, np.ceil(share * total / size)).astype(np.int64)
        first = np.cumsum(n_parts) - n_parts

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                near = _distances(_matrix(b["v"], dim), centres).argmin(1)
                yield b.assign(block=first[near] + b["h"].to_numpy() % n_parts[near]).drop(columns="h")

        return rows.withColumn("h", F.xxhash64("vec_id")).mapInPandas(run, "vec_id long, v array<double>, block long")

    def pack(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("vec_id")
        x = _matrix(df["v"], dim)
        far = _distances(x, pivots)
        return pd.DataFrame({"block": [df["block"].iloc[0]], "ids": [df["vec_id"].to_numpy(np.int64).tobytes()], "v": [x.tobytes()], "far": [far.tobytes()], "lo": [far.min(0).tobytes()], "hi": [far.max(0).tobytes()], "sq": [float((x**2).sum(1).max())]})

    def seeded(df: pd.DataFrame) -> pd.DataFrame:
        """Also the k-th best score over the sample, a floor of the final k-th best."""
        out, x, ids = pack(df), _matrix(df.sort_values("vec_id")["v"], dim), np.sort(df["vec_id"].to_numpy(np.int64))
        scores = x @ s_v.T
        scores[ids[:, None] == s_ids[None, :]] = -np.inf
        seed = np.sort(scores, axis=1)[:, -k] if len(s_ids) >= k else np.full(len(ids), -np.inf)
        return out.assign(seed=[seed.tobytes()])

    read = lambda b, shape=-1: np.frombuffer(b).reshape(shape)
    schema = "block long, ids binary, v binary, far binary, lo binary, hi binary, sq double"
    cands = cut(numbered(vectors, n, CANDIDATE_BLOCK).groupBy("block").applyInPandas(pack, schema))
    asks = numbered(vectors.filter(is_query), n_q, QUERY_BLOCK).groupBy("block").applyInPandas(seeded, schema + ", seed binary")
    met = cands.select("block", "lo", "hi", "sq") if n <= KNOWN_BLOCKS * CANDIDATE_BLOCK else cands.select("block", F.lit(None).cast("binary").alias("lo"), F.lit(None).cast("binary").alias("hi"), "sq")
    blocks = met.toPandas()
    known = {"block": blocks["block"].to_numpy(np.int64), "sq": blocks["sq"].to_numpy()}
    if n <= KNOWN_BLOCKS * CANDIDATE_BLOCK:
        known |= {x: np.stack([read(b) for b in blocks[x]]) for x in ("lo", "hi")}

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            floors = [float(read(s).min()) for s in b["seed"]]
            if "lo" in known:
                to = [_reachable({"lo": read(lo), "hi": read(hi), "sq": sq, "floor": f}, known) for lo, hi, sq, f in zip(b["lo"], b["hi"], b["sq"], floors, strict=True)]
            else:
                to = [known["block"]] * len(b)
            yield pd.DataFrame({"q_ids": b["ids"], "q_v": b["v"], "q_far": b["far"], "q_seed": b["seed"], "to": to})

    asked = asks.mapInPandas(choose, "q_ids binary, q_v binary, q_far binary, q_seed binary, to array<long>")
    asked = asked.select(F.explode("to").alias("block"), F.lit(1).alias("kind"), F.col("q_ids").alias("ids"), F.col("q_v").alias("v"), F.col("q_far").alias("far"), F.col("q_seed").alias("seed"))
    rows = cands.select("block", F.lit(0).alias("kind"), "ids", "v", "far", F.lit(None).cast("binary").alias("seed")).unionByName(asked)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each block of candidates is held while the queries that need it go past."""
        at, held = None, None
        for b in batches:
            for r in b.itertuples():
                v = read(r.v, (-1, dim))
                side = {"ids": np.frombuffer(r.ids, np.int64), "v": v, "far": read(r.far, (len(v), -1)), "sq": (v**2).sum(1)}
                if r.kind == 0:
                    at, held = r.block, side
                elif r.block == at:
                    yield _search(side | {"seed": read(r.seed)}, held, k, most < 2.0**24)[0]

    # a block of candidates is shuffled once; the queries, fewer, once for each block that they can't do without
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(int(max(tasks, min(len(known["block"]), 4096))), "block").sortWithinPartitions("block", "kind")
    hits = dealt.mapInPandas(search, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
