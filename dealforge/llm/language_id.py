"""Language identification by fusing text, markup, address and host evidence.

Text gives a likelihood per language from hashed letter trigrams. The
declared language gives one from a table of P(declared | language). The
prior is hierarchical: that of a host is smoothed toward its registered
domain, that toward the address suffix, and that toward all rows. All counts
are sums of the text's posteriors, grouped in Spark; a row's own share is
taken out of them before they count as its prior.

An extra class ``und`` holds a uniform likelihood, so that texts of no known
language, and texts without letters (null and empty ones too), come out as
``und``; without labelled rows every text does. A null address or declaration counts as a value of its own.
Repeated rows each get a result. Extra columns are dropped by ``identify``.
"""

from __future__ import annotations

import html as htmllib
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, small_or_merged

UND = "und"
FEATURES = 1 << 16
#: Labelled rows per language that the text model is fitted on, those with the smallest hash.
FIT_ROWS = 500
#: Trigrams whose evidence counts in full; more add no certainty, as they depend on each other.
EVIDENCE = 60.0
#: Trigrams of a stretch, in which a claimed language is looked for.
STRETCH = 20
#: Pseudo-counts that each level of the host hierarchy takes from the level above.
PULL = 4.0
UND_PRIOR = 1e-3
_MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.I | re.S)


def visible_text(page: str) -> str:
    return htmllib.unescape(_MARKUP.sub(" ", page))


#: Letters, and marks, which belong to the letters before them; no planes beyond these have any.
_LETTER = np.array([unicodedata.category(chr(i))[0] in "LM" for i in range(4 << 16)])


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams of lower-cased letters with their marks, and single spaces between them."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    cp = np.concatenate([[32], np.where(_LETTER[np.minimum(cp, len(_LETTER) - 1)], cp, 32), [32]]).astype(np.uint32)
    cp = cp[np.concatenate([[True], (cp[1:] != 32) | (cp[:-1] != 32)])]
    if len(cp) < 3:
        return np.empty(0, np.uint32)
    a, b, c = cp[:-2], cp[1:-1], cp[2:]
    return ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F) >> np.uint32(16)


#: What a count weighs against the one that every feature has from the start.
WEIGHT = 50.0


class TextModel:
    """log P(trigram | language), languages in ``langs``, ``und`` last.

    ``counts``: of each trigram (a row) in each language; ``sampled``: the key
    hashes of the rows they are from, whose own counts don't speak for them.
    """

    def __init__(self, langs: list[str], counts: np.ndarray, sampled: set[int]) -> None:
        self.langs, self.sampled = [*langs, UND], sampled
        self.weights = np.ones((FEATURES, len(langs) + 1), np.float32)
        self.weights[:, : len(langs)] += np.float32(WEIGHT) * counts.astype(np.float32)
        self.total = self.weights.sum(0, dtype=np.float64)
        self.table = np.log(self.weights / self.total).astype(np.float32)

    def loglik(self, text: str, own: str | None = None, claimed: str = "") -> tuple[np.ndarray, int, bool]:
        """Log likelihood of each language, the number of trigrams, and whether any stretch of the text is in the claimed language.

        ``own``: the language that the text was counted for in the fit. Texts
        of less than ``EVIDENCE`` trigrams are too short to deny a claim.
        """
        t = trigrams(text)
        each = self.table[t]
        out, denied = each.sum(0, dtype=np.float64), False
        if len(t) >= EVIDENCE and claimed in self.langs[:-1] and out.argmax() != self.langs.index(claimed):
            stretches = np.add.reduceat(each, np.arange(0, len(t) - STRETCH + 1, STRETCH), axis=0)
            denied = not (stretches.argmax(1) == self.langs.index(claimed)).any()
        if own in self.langs[:-1] and len(t):
            i = self.langs.index(own)
            each, n = np.unique(t, return_counts=True)
            left = np.maximum(self.weights[each, i] - WEIGHT * n, 1.0)
            out[i] = (n * np.log(left / max(self.total[i] - WEIGHT * len(t), FEATURES))).sum()
        return out, len(t), not denied


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = FIT_ROWS) -> TextModel:
    """Fit on at most ``rows`` labelled rows of each language; the table has ``FEATURES`` numbers a language."""
    named = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.col(lang) != UND)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key).alias("h"))
    sizes = named.groupBy("lang").agg(F.count("*").alias("n"))
    # Large languages are thinned by hash to some four times the rows before the smallest hashes are taken, so what is sorted has a fixed size.
    share = F.floor(F.lit(float((4 * rows + 1000) << 30)) / F.col("n")) + 1
    thinned = named.join(F.broadcast(sizes), "lang").filter(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < share).drop("n")
    first = W.partitionBy("lang").orderBy("h")
    sample = thinned.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= rows)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, g in b.groupby("lang"):
                n = np.bincount(np.concatenate([trigrams(x) for x in g["text"]]), minlength=FEATURES)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"lang": name, "f": at.astype(np.int64), "n": n[at], "row": False})
                # which rows these counts are from
                yield pd.DataFrame({"lang": name, "f": g["h"].to_numpy(), "n": 1, "row": True})

    told = sample.select("lang", "text", "h").mapInPandas(count, "lang string, f long, n long, row boolean").groupBy("row", "lang", "f").agg(F.sum("n").alias("n")).toPandas()
    counts = told[~told["row"].astype(bool)]
    langs = sorted(told["lang"].unique())
    table = np.zeros((FEATURES, len(langs)))
    for i, name in enumerate(langs):
        own = counts[counts["lang"] == name]
        table[own["f"].to_numpy(np.int64), i] = own["n"].to_numpy()
    return TextModel(langs, table, set(told["f"][told["row"].astype(bool)].tolist()))


def address(url: Column) -> dict[str, Column]:
    """host, domain (its last two labels) and suffix (its last label) of a URL."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    labels = F.split(host, r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    return {"host": host, "domain": domain, "suffix": F.element_at(labels, -1)}


def declared_in_markup(page: Column) -> Column:
    """The primary tag of the html element's lang attribute, or null."""
    found = F.regexp_extract(page, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,8})", 1)
    return F.nullif(F.lower(found), F.lit(""))


def _softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _matrix(arrays: pd.Series) -> np.ndarray:
    return np.stack(arrays.to_numpy())


class Fusion:
    """What all rows have told: the declarations' table and the languages' shares."""

    def __init__(self, langs: list[str], declared: dict[str, list[float]]) -> None:
        self.langs, k = langs, len(langs)
        self.values = ["", "other", *langs[:-1]]
        counts = np.array([declared.get(v, [0.0] * k) for v in self.values]) + 0.5
        self.says = np.log(counts / counts.sum(0))
        total = np.sum([*declared.values()], axis=0) if declared else np.zeros(k)
        self.whole = (total + PULL / k) / (total.sum() + PULL)

    def posterior(self, b: pd.DataFrame) -> np.ndarray:
        """A row of b (like, own, declared, n_trigrams, and the sums n_suffix, n_domain, n_host): P(language | all evidence)."""
        own, prior = _matrix(b["own"]), self.whole[None, :]
        for level in ("n_suffix", "n_domain", "n_host"):
            others = np.maximum(_matrix(b[level]) - own, 0.0)  # without the row's own share
            prior = (others + PULL * prior) / (others.sum(1, keepdims=True) + PULL)
        says = self.says[[self.values.index(x) for x in b["declared"]]]
        p = _matrix(b["like"]) + np.log(prior + UND_PRIOR / len(self.langs)) + says
        # without a single letter nothing but und can be meant
        p[(b["n_trigrams"] == 0).to_numpy()] = [-50.0] * (len(self.langs) - 1) + [0.0]
        return _softmax(p)


def identify(rows: DataFrame, model: TextModel, *, markup: bool = False) -> DataFrame:
    """``rows`` has id, text, declared, host, domain, suffix, and key (a hash as in ``fit``, or null). Returns id, lang, posterior, text_lang, declared, host, n_trigrams, claim_found.

    claim_found: false if no stretch of the text is in the declared language.
    Rows that the model was fitted on are judged without their own counts.
    ``markup``: the text is HTML, and its visible part counts. The rows'
    likelihoods are cut to the shared folder; hosts are grouped with partial
    sums, and joined back by broadcast if they are few, else by a join that
    Spark may split at a hot host.
    """
    langs, k = model.langs, len(model.langs)
    start = np.array([math.log((1 - UND_PRIOR) / (k - 1))] * (k - 1) + [math.log(UND_PRIOR)] if k > 1 else [0.0])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [said if key is not None and int(key) in model.sampled else None for key, said in zip(b["key"], b["said"], strict=True)]
            got = [model.loglik(visible_text(x) if markup else x, o, said) for x, o, said in zip(b["text"], own, b["declared"], strict=True)]
            n = np.array([n for _, n, _ in got], np.int64)
            like = np.array([ll for ll, *_ in got]).reshape(-1, k) * np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None]
            yield b.drop(columns=["text", "key", "said"]).assign(n_trigrams=n, like=list(like), own=list(_softmax(like + start)), claim_found=[c for *_, c in got])

    known = langs[:-1]
    named = F.when(F.col("declared").isNull(), "").when(F.lower("declared").isin(known), F.lower("declared")).otherwise("other")
    # ids and keys go as text: with a null among them pandas would make them doubles
    base = rows.select(F.col("id").cast("string").alias("id"), F.col("key").cast("string").alias("key"), F.col("declared").alias("said"), *(F.coalesce(x, F.lit("")).alias(x) for x in ("host", "domain", "suffix")), named.alias("declared"), F.coalesce("text", F.lit("")).alias("text"))
    liked = cut(base.mapInPandas(score, "id string, host string, domain string, suffix string, declared string, n_trigrams long, like array<double>, own array<double>, claim_found boolean"))

    sums = [F.sum(F.col("own")[i]).alias(f"n{i}") for i in range(k)]

    def grouped(name: str, *by: str) -> DataFrame:
        return liked.groupBy(*by).agg(*sums).select(*by, F.array(*(F.col(f"n{i}") for i in range(k))).alias(name))

    # declared x language: at most (languages + 2) rows
    fusion = Fusion(langs, {r["declared"]: r["n"] for r in grouped("n", "declared").collect()})
    levels = grouped("n_host", "suffix", "domain", "host").join(grouped("n_domain", "suffix", "domain").hint("merge"), ["suffix", "domain"]).join(grouped("n_suffix", "suffix").hint("merge"), "suffix")
    # a row of three arrays counts as so many rows of a few numbers
    joined = liked.join(small_or_merged(cut(levels), BROADCAST_ROWS // (1 + k)), ["suffix", "domain", "host"])

    def fuse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            post = fusion.posterior(b)
            text_lang = np.where(b["n_trigrams"] > 0, _matrix(b["own"]).argmax(1), k - 1)
            declared = b["declared"].where(b["declared"] != "", None)
            out = {"id": b["id"], "lang": [langs[i] for i in post.argmax(1)], "posterior": np.round(post.max(1), 6), "text_lang": [langs[i] for i in text_lang], "declared": declared, "host": b["host"], "n_trigrams": b["n_trigrams"], "claim_found": b["claim_found"]}
            yield pd.DataFrame(out)

    fused = joined.mapInPandas(fuse, "id string, lang string, posterior double, text_lang string, declared string, host string, n_trigrams long, claim_found boolean")
    return fused.withColumn("id", F.col("id").cast("long"))


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.lit(None).cast("long").alias("key"), F.col("html").alias("text"), declared_in_markup(F.col("html")).alias("declared"), *(c.alias(n) for n, c in address(F.col("url")).items()))
    return identify(rows, model, markup=True).withColumnRenamed("id", "page_id")


def identify_documents(docs: DataFrame, model: TextModel) -> DataFrame:
    """Documents: the language column is the declaration, the source is the host."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("doc_id").alias("key"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.col("source").alias("domain"), F.lit("").alias("suffix"))
    return identify(rows, model).withColumnRenamed("id", "doc_id")


def keep_identified(docs: DataFrame, model: TextModel, *, min_posterior: float = 0.5) -> DataFrame:
    """``docs`` without those whose language is ``und``, less likely than ``min_posterior``, or another one than they claim, all through.

    Documents that are in several languages, the claimed one among them, stay,
    and rows with a null doc_id.
    """
    found = identify_documents(docs, model)
    rejected = found.filter((F.col("lang") == UND) | (F.col("posterior") < min_posterior) | ~F.col("claim_found") & (F.col("declared") != F.col("lang")))
    gone = cut(rejected.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct())
    return docs.join(small_or_merged(gone), "doc_id", "left_anti").select(docs.columns)
