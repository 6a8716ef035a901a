"""One run from landed articles to new deals, their matches and the state of the articles.

The extractor is the dear part and isn't sure to answer alike twice, so its
replies (``extract.replies``) are stored first, then the new deals made from them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import dedup, extract, match

NO_TEXT = "No article text available"


class Run(NamedTuple):
    articles: DataFrame
    deals: DataFrame
    matches: DataFrame


def new_deals(answered: DataFrame, stored: DataFrame, *, model: str = "plug-in") -> DataFrame:
    """Deals of the replies that neither the stored ones nor earlier ones of the run hold, by article and order.

    Hashes are of the names as they came, semantic keys of display names. A
    deal that a stored one rules out takes no key.
    """
    rows = extract.replied_deals(answered, model=model)
    rows = rows.withColumn("id", F.concat_ws("-", F.col("article_id").cast("string"), F.col("ord").cast("string")))
    first = extract.normalized(dedup.batch_dedup(rows, ["ord"]))
    fresh = dedup.semantic_conflicts(dedup.not_stored(first, stored), stored)
    return dedup.greedy_unique(fresh, ["article_id", "ord"])


def article_state(articles: DataFrame, answered: DataFrame) -> DataFrame:
    """The articles of a run, all done; those without text and those whose extraction failed have an error."""
    known = answered.filter("error IS NOT NULL").select("id", F.col("error").alias("_error"))
    bare = F.coalesce(F.col("raw_text"), F.lit("")) == ""
    error = F.when(bare, NO_TEXT).otherwise(F.col("_error"))
    kept = [c for c in articles.columns if c not in ("extraction_done", "extraction_error")]
    return articles.join(known, "id", "left").select(*kept, F.lit(True).alias("extraction_done"), error.alias("extraction_error"))


def with_text(articles: DataFrame, texts: DataFrame) -> DataFrame:
    """Articles without text get that of ``texts`` (id, raw_text; each id once)."""
    t = texts.select("id", F.col("raw_text").alias("_text"))
    own = F.when(F.col("raw_text") != "", F.col("raw_text"))
    return articles.join(t, "id", "left").select(*(F.coalesce(own, F.col("_text")).alias(c) if c == "raw_text" else F.col(c) for c in articles.columns))


def run(articles: DataFrame, answered: DataFrame, deals: DataFrame, owners: DataFrame, facilities: DataFrame, as_of: Column, *, counts: Observation | None = None) -> Run:
    """The new deals with stage, confidence and recheck date, their matches with flags, and the articles' state.

    ``deals`` are those of ``new_deals``, written and read again: matching goes
    through them several times. ``counts`` gets n_stored and n_confirmed when
    the deals are written.
    """
    found, stages = match.recheck(deals, owners, facilities, as_of)
    out = deals.drop("confidence").join(stages.drop("best_score"), "id")
    if counts:
        out = out.observe(counts, F.count(F.lit(1)).alias("n_stored"), F.count_if(F.col("stage") == "confirmed").alias("n_confirmed"))
    return Run(article_state(articles, answered), out, found)
