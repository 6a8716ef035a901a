"""Interpolated modified Kneser-Ney bigrams, counted in Spark, looked up in mapped files.

Counting: each task counts its own bigrams in arrays; Spark deals the
distinct ones out by their first word, very frequent first words being
spread over all buckets by their second word. A bucket sums the counts and
writes its part of the model: sorted 64-bit bigram hashes and their counts.
What it learns of words (count, followers seen once, twice, more often, and
distinct words before) goes on to buckets by word, which write sorted word
hashes with these numbers. Only sums of fixed size reach the driver.

Scoring: workers map the files of the shared folder into memory, ``OPEN`` at
most at a time, and look up the distinct bigrams of some documents at a time.
Where files of that folder can't be mapped (an object store), a worker maps a
nameless copy of each file that it needs.

    P(v | u) = max(c(u v) - D, 0) / c(u) + left-over(u) * P(v)
    P(v)     = max(b(v) - D', 0) / B     + left-over'   * 1 / (V + 1)

c are counts, b(v) the distinct words before v, B the distinct bigrams, V the
distinct tokens; D and D' are the three discounts of each order. After a
word that training has not seen, P(v) is used. Sums over all known words and
one unknown word are 1.

Null and empty texts are the end token alone. Without training documents
every token has probability 1 / (V + 1) = 1. Repeated rows count as often as
they stand there. Extra columns are dropped.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_before, as_text, fresh_dir, text_schema
from .shared_files import SharedFiles
from .windows import mix, pair
from .words import WordArrays, parts

#: Ids of the end of a text and of its beginning (a context, not a token).
END, BEGIN = np.uint64(0x454E44), np.uint64(0x424547494E)
#: Tokens that a task counts before it sends what it has.
FLUSH_TOKENS = 2_000_000
BUCKET_BYTES = 16 << 20
#: Text that is scored together: equal bigrams in it are looked up once.
SCORE_BYTES = 4 << 20
#: Files of the model that a worker holds mapped; each takes one descriptor.
OPEN = 128
#: Rows, about, from which very frequent first words are guessed. This only spreads work; counts are of all rows.
HOT_SAMPLE = 2000


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every token of the texts: the one before, itself, and its text's number."""
    w = WordArrays(texts, lower=True)
    n = w.counts + 1
    end = np.cumsum(n) - 1
    v = np.empty(int(n.sum()), np.uint64)
    is_word = np.ones(len(v), bool)
    is_word[end] = False
    v[is_word], v[end] = w.ids, END
    u = np.empty_like(v)
    u[1:] = v[:-1]
    u[end - n + 1] = BEGIN
    return u, v, np.repeat(np.arange(len(texts)), n)


def _bucket(u: np.ndarray, v: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    by = np.where(np.isin(u, hot), pair_ids(u, v), mix(u))
    return ((mix(by) >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def pair_ids(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix(mix(u) * np.uint64(3) + v)


def _group(*cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort(cols[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in cols:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    return order, np.flatnonzero(new)


def _save(folder: str, kind: str, bucket: int, keys: np.ndarray, values: np.ndarray) -> None:
    """One file a bucket: the number of keys and the bytes of a value, the sorted keys, and a row of values a key."""
    head = np.array([len(keys), values.dtype.itemsize], np.int64)
    SharedFiles(folder).put(f"{kind}-{bucket}.bin", head, keys, values)


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many have count 1, 2, 3 and 4; 0.5, 1, 1.5 where too few are known."""
    if min(n) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05 * i), float(i)) for i in (1, 2, 3))


_UNSIGNED = {np.dtype(k).itemsize: k for k in (np.uint8, np.uint16, np.uint32, np.uint64)}


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(next(k for k in _UNSIGNED.values() if not x.size or x.max() <= np.iinfo(k).max))


@dataclass
class Model:
    """Where the arrays are and the sums that scoring needs."""

    folder: str
    n_buckets: int
    hot: np.ndarray
    tokens: int
    vocabulary: int
    documents: int
    bigrams: int
    d2: tuple
    d1: tuple
    left_over: float
    _open: OrderedDict = field(default_factory=OrderedDict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": OrderedDict()}

    def _map(self, name: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Keys and values of a file; that not used for longest is closed when there are too many."""
        if name not in self._open:
            raw = SharedFiles(self.folder).map(f"{name}.bin")
            if raw is not None:
                n, wide = raw[:16].view(np.int64).tolist()
                raw = raw[16 : 16 + 8 * n].view(np.uint64), raw[16 + 8 * n :].view(_UNSIGNED[wide])
            self._open[name] = raw
            if len(self._open) > OPEN:
                self._open.popitem(last=False)
        self._open.move_to_end(name)
        return self._open[name]

    def _look(self, kind: str, keys: np.ndarray, bucket: np.ndarray, width: int) -> np.ndarray:
        """Numbers of the keys, zeros for those not there. Keys are sorted within a bucket."""
        out = np.zeros((len(keys), width), np.int64)
        order = np.argsort(bucket, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0])[: len(order)])
        for some in np.split(order, at[1:]) if len(order) else []:
            have = self._map(f"{kind}-{bucket[some[0]]}")
            if have is None or not len(have[0]):
                continue
            where = np.minimum(np.searchsorted(have[0], keys[some]), len(have[0]) - 1)
            hit = have[0][where] == keys[some]
            out[some[hit]] = have[1].reshape(-1, width)[where[hit]]
        return out

    def words(self, ids: np.ndarray) -> np.ndarray:
        """count, followers seen once, twice, more often, distinct words before."""
        return self._look("word", ids, ((mix(ids) >> np.uint64(32)) % np.uint64(self.n_buckets)).astype(np.int64), 5)

    def score(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        u, v, text = tokens(texts)
        order, first = _group(u, v)
        group = np.empty(len(order), np.int64)
        group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        du, dv = u[order[first]], v[order[first]]
        vocab, at = np.unique(np.concatenate([du, dv]), return_inverse=True)
        info = self.words(vocab)
        iu, iv = info[at[: len(du)]], info[at[len(du) :]]
        keys, bucket = pair_ids(du, dv), _bucket(du, dv, self.hot, self.n_buckets)
        sort = np.lexsort((keys, bucket))
        c = np.zeros(len(keys), np.int64)
        c[sort] = self._look("pair", keys[sort], bucket[sort], 1)[:, 0]
        cut = lambda n, d: np.where(n > 0, n - np.choose(np.minimum(n, 3), (0.0, *d)), 0.0)
        base_v = 1.0 / (self.vocabulary + 1)
        p1 = cut(iv[:, 4], self.d1) / max(self.bigrams, 1) + self.left_over * base_v
        total = np.maximum(iu[:, 0], 1)
        p2 = cut(c, self.d2) / total + (iu[:, 1:4] @ np.array(self.d2)) / total * p1
        p = np.log10(np.where(iu[:, 0] > 0, p2, p1))
        count = np.where(dv == END, self.documents, np.where(iv[:, 4] > 0, iv[:, 0], 0))
        base = np.log10((count + 1) / (self.tokens + self.vocabulary + 1))
        n = np.bincount(text, minlength=len(texts))
        add = lambda x: np.bincount(text, weights=x[group], minlength=len(texts))
        return {"n_tokens": n, "n_known": add(count > 0).astype(np.int64), "base_score": add(base), "score": add(p)}


def _send(b: dict, **cols: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows of arrays, one a bucket; everything is sorted by bucket."""
    bucket = b["bucket"]
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(bucket)])
    to = np.append(at[1:], len(bucket))
    yield pd.DataFrame({"bucket": bucket[at]} | {k: [x[i:j].tobytes() for i, j in zip(at, to, strict=True)] for k, x in cols.items()})


def train(docs: DataFrame) -> Model:
    """Count ``docs`` and write the model into a new folder below the shared one."""
    spark = docs.sparkSession
    folder = fresh_dir(spark, "kneser-ney")
    rows = docs.select(F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body"), F.xxhash64("doc_id").alias("h"))
    total, n_docs = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    total = total or 0
    n_buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))

    def first_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts(batches):
            u, n = np.unique(tokens(b["body"].tolist())[0], return_counts=True)
            most = np.argsort(-n)[: 4 * n_buckets]
            yield pd.DataFrame({"u": u.view(np.int64)[most], "n": n[most]})

    # Words with more than a quarter of a bucket's fair share are spread; there can be 4 * n_buckets of them at most.
    share = int(HOT_SAMPLE / max(n_docs, 1) * (1 << 30)) + 1
    sample = rows.filter(F.pmod("h", F.lit(1 << 30)) < share).select("body").mapInPandas(first_words, "u long, n long").groupBy("u").agg(F.sum("n").alias("n"))
    often = sample.orderBy(F.col("n").desc(), "u").limit(4 * n_buckets).toPandas()
    seen = sample.agg(F.sum("n")).first()[0] or 1
    hot = np.sort(often["u"].to_numpy(np.int64)[(often["n"] * 4 * n_buckets > seen).to_numpy()].view(np.uint64))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pd.DataFrame]:
            u, v = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            # a large array goes as soon as it isn't needed
            order = np.lexsort((v, u))
            u, v = u[order], v[order]
            del order
            first = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])]))
            n = np.diff(np.append(first, len(u)))
            u, v = u[first], v[first]
            bucket = _bucket(u, v, hot, n_buckets)
            order = np.argsort(bucket, kind="stable")  # within a bucket still by u, v
            u, v, n, bucket = u[order], v[order], n[order], bucket[order]
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            out = {"bucket": [], "u": [], "runs": [], "v": [], "n": []}
            for i, j in zip(at, np.append(at[1:], len(bucket)), strict=True):
                new = np.flatnonzero(np.concatenate([[True], u[i + 1 : j] != u[i : j - 1]]))
                out["bucket"].append(bucket[i])
                out["u"].append(u[i:j][new].tobytes())
                out["runs"].append(np.diff(np.append(new, j - i)).astype(np.uint32).tobytes())
                out["v"].append(v[i:j].tobytes())
                out["n"].append(n[i:j].astype(np.uint32).tobytes())
            yield pd.DataFrame(out)

        n = 0
        for b in parts(batches):
            held.append(tokens(b["body"].tolist())[:2])
            n += len(held[-1][0])
            if n >= FLUSH_TOKENS:
                yield from flush()
                n = 0
        if held:
            yield from flush()

    def pairs(df: pd.DataFrame) -> pd.DataFrame:
        get = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in df[c]])
        u, v, n = np.repeat(get("u", np.uint64), get("runs", np.uint32)), get("v", np.uint64), get("n", np.uint32).astype(np.int64)
        order, first = _group(u, v)
        n = np.add.reduceat(n[order], first)
        u, v = u[order[first]], v[order[first]]
        del order, first
        keys = pair_ids(u, v)
        order, b = np.argsort(keys), df["bucket"].iloc[0]
        _save(folder, "pair", b, keys[order], _narrow(n[order]))
        new = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))  # u is sorted
        by_u = lambda x: np.add.reduceat(x.astype(np.int64), new)
        before, n_before = np.unique(v, return_counts=True)
        zero = np.zeros(len(before), np.int64)
        words = np.concatenate([u[new], before])
        cols = [np.concatenate([x, zero]) for x in (by_u(n), by_u(n == 1), by_u(n == 2), by_u(n > 2))] + [np.concatenate([np.zeros(len(new), np.int64), n_before])]
        words, at = np.unique(words, return_inverse=True)
        cols = [np.bincount(at, weights=x, minlength=len(words)).astype(np.int64) for x in cols]
        bucket = ((mix(words) >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sums = np.array([int(n.sum()), len(n), *(int((n == i).sum()) for i in (1, 2, 3, 4))], np.int64)
        out = next(_send({"bucket": bucket[order]}, word=words[order], **{f"x{i}": x[order].astype(np.uint32) if x.max() < 2**32 else x[order] for i, x in enumerate(cols)}))
        return out.assign(sums=[sums.tobytes()] + [b""] * (len(out) - 1))

    def words(df: pd.DataFrame) -> pd.DataFrame:
        w = np.concatenate([np.frombuffer(x, np.uint64) for x in df["word"]])
        wide = [np.concatenate([np.frombuffer(x, np.uint32 if len(x) * 2 == len(k) else np.int64).astype(np.int64) for x, k in zip(df[f"x{i}"], df["word"], strict=True)]) for i in range(5)]
        w, at = np.unique(w, return_inverse=True)
        table = np.stack([np.bincount(at, weights=x, minlength=len(w)).astype(np.int64) for x in wide], axis=1)
        _save(folder, "word", df["bucket"].iloc[0], w, _narrow(table))
        left = table[:, 4]
        sums = np.sum([np.frombuffer(x, np.int64) for x in df["sums"] if len(x)] or [np.zeros(6, np.int64)], axis=0)
        return pd.DataFrame([[*map(int, sums), int((left > 0).sum()), *(int((left == i).sum()) for i in (1, 2, 3, 4))]], columns=names)

    names = ["tokens", "bigrams", "p1", "p2", "p3", "p4", "vocabulary", "w1", "w2", "w3", "w4"]
    counted = rows.select("body").mapInPandas(count, "bucket long, u binary, runs binary, v binary, n binary")
    told = counted.groupBy("bucket").applyInPandas(pairs, "bucket long, word binary, x0 binary, x1 binary, x2 binary, x3 binary, x4 binary, sums binary")
    made = told.groupBy("bucket").applyInPandas(words, ", ".join(f"{n} long" for n in names)).agg(*(F.sum(n).alias(n) for n in names)).first()
    x = {n: made[n] or 0 for n in names}
    d1 = _discounts([x["w1"], x["w2"], x["w3"], x["w4"]])
    more = x["vocabulary"] - x["w1"] - x["w2"]
    left_over = (d1[0] * x["w1"] + d1[1] * x["w2"] + d1[2] * more) / x["bigrams"] if x["bigrams"] else 1.0
    return Model(folder, n_buckets, hot, x["tokens"], x["vocabulary"], n_docs, x["bigrams"], _discounts([x["p1"], x["p2"], x["p3"], x["p4"]]), d1, left_over)


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` columns and n_tokens, n_known, base_score, score (log10) of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts(batches, SCORE_BYTES):
            yield b[list(keep)].reset_index(drop=True).assign(**model.score(b["body"].tolist()))

    kept = docs.select(*keep)
    schema = text_schema(kept.schema).add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double")
    rows = as_text(docs.select(*keep, F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body")))
    return as_before(rows.mapInPandas(run, schema), kept.schema)


def held_out_scores(docs: DataFrame, *, folds: int = 7, held: int = 2) -> DataFrame:
    """Learn from documents outside the held-out fold, score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    The fold is crc32(doc_id as text) mod ``folds``; a null doc_id is in training.
    """
    part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False)).alias("held_out"))
    model = train(part.filter(~F.col("held_out")))
    out = score(part, model, "doc_id", "held_out").withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
