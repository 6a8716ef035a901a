"""Article text: from HTML, and the gates before extraction."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import ACQUISITION_STEMS, ARTICLE_TAGS, MAX_CHARS, MAX_PAGE_CHARS, MIN_CHARS, MIN_WORDS
from .clean import stripped, word_count


class _Text(HTMLParser):
    def __init__(self, skip: set[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.depth, self.out = skip, 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.skip

    def handle_endtag(self, tag):
        if tag in self.skip and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.out.append(data.strip())


def html_text(page: Column, tags: list[str] = ARTICLE_TAGS, most: int = MAX_PAGE_CHARS) -> Column:
    """The text outside ``tags``, a line for each piece, cut to ``most`` characters; null if there is none."""
    skip = set(tags)

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            if x is None:
                return None
            p = _Text(skip)
            p.feed(x)
            p.close()
            return "\n".join(p.out)[:most] or None

        return pages.map(one)

    return run(page)


def about_acquisitions(text: Column) -> Column:
    """Whether one of the stems occurs anywhere, in any case."""
    return F.lower(text).rlike("|".join(ACQUISITION_STEMS))


def text_gate(articles: DataFrame, text: str = "text") -> DataFrame:
    """Articles long enough to extract from, with n_words, truncated (few words) and the text cut to size."""
    kept = articles.filter(F.length(stripped(F.col(text))) >= MIN_CHARS).withColumn("n_words", word_count(F.col(text)))
    return kept.withColumn("truncated", F.col("n_words") < MIN_WORDS).withColumn(text, F.left(F.col(text), F.lit(MAX_CHARS)))
