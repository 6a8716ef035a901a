"""Fuzzy scores of a deal's names against registry names."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Share of common words below which no score reaches the match threshold: (0.70 - 0.3) / 0.7 is 0.571.
WORD_FLOOR = 0.57


def name_words(c: Column) -> Column:
    """Distinct words of more than two letters, in capitals."""
    return F.array_distinct(F.filter(F.split(F.upper(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: F.length(w) > 2))


def word_score(a: Column, b: Column) -> Column:
    """Share of a's words that b has; 0 if a has none."""
    words = name_words(a)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words, name_words(b))), F.size(words)), F.lit(0.0))


def is_substring(name: Column, owner: Column) -> Column:
    """Either name holds the other; an empty owner is held by every name."""
    n, o = F.upper(name), F.upper(F.coalesce(owner, F.lit("")))
    return F.contains(n, o) | F.contains(o, n)


#: Characters counted one by one in ``letters``; all others count together.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 "


def letters(c: Column) -> Column:
    """How often each of ``_LETTERS`` is in the text in capitals, and how often any other character; null where a character isn't ASCII, as capitals may differ there."""
    u = F.upper(c)
    counts = F.transform(F.array(*map(F.lit, _LETTERS)), lambda x: F.length(u) - F.length(F.replace(u, x)))
    every = F.concat(counts, F.array(F.length(u) - F.aggregate(counts, F.lit(0), lambda n, x: n + x)))
    return F.when(u.rlike(r"^[\x00-\x7F]*$"), every)


def most_score(word: Column, a: Column, b: Column) -> Column:
    """A bound on the score before it is cut off: word score and letters of both. Matching runs can't have more characters than both texts share."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda n, y: n + y)
    shared = total(F.zip_with(a, b, lambda x, y: F.least(x, y)))
    return (word * 0.7 + F.coalesce(2 * shared / (total(a) + total(b)), F.lit(1.0)) * 0.3) * 100


@F.pandas_udf(T.IntegerType())
def fuzzy_score(name: pd.Series, target: pd.Series) -> pd.Series:
    """0 to 100 from common words (0.7) and matching character runs (0.3), cut off to a whole number."""

    def one(a: str | None, b: str | None) -> int:
        if not a or not b:
            return 0
        a, b = a.upper(), b.upper()
        mine = {w for w in a.split() if len(w) > 2}
        if not mine:
            return 0
        common = len(mine & {w for w in b.split() if len(w) > 2}) / len(mine)
        return int((common * 0.7 + SequenceMatcher(None, a, b).ratio() * 0.3) * 100)

    return pd.Series([one(a, b) for a, b in zip(name, target, strict=True)], dtype="int32")


#: Fields that names come from.
FIELDS = ["acquiring_entity", "operator_names", "facility_names", "seller_entity"]


def search_names(acquirer: Column, operators: Column, facilities: Column, seller: Column) -> Column:
    """(name, field) in the order in which they are tried; empty names are left out."""
    pair = lambda n, f: F.struct(n.alias("name"), F.lit(f).alias("field"))
    many = lambda arr, f: F.transform(F.coalesce(arr, F.array().cast("array<string>")), lambda n: pair(n, f))
    every = F.concat(F.array(pair(acquirer, "acquiring_entity")), many(operators, "operator_names"), many(facilities, "facility_names"), F.array(pair(seller, "seller_entity")))
    return F.filter(every, lambda x: F.coalesce(x["name"], F.lit("")) != "")


def stage_of(best: Column) -> tuple[Column, Column]:
    """stage and confidence from the best match score; null: no match."""
    stage = F.when(best >= 85, "confirmed").when(best >= 70, "pending_cms").otherwise("detected")
    return stage, F.when(best >= 85, "high").when(best >= 70, "partial")


def recheck_date(stage: Column, as_of: Column, days: int = 7) -> Column:
    return F.when(stage.isin("detected", "pending_cms"), F.date_add(as_of, days))


def policy_flags(sff: Column, candidate: Column, stars: Column, staffing: Column) -> Column:
    low = lambda c: (c >= 1) & (c <= 2) | (c < 0)  # noqa: E731  zero counts as not rated
    return F.array_compact(
        F.array(
            F.when(sff, "Special Focus Facility"),
            F.when(candidate, "SFF Candidate"),
            F.when(low(stars), F.concat(F.lit("Low quality rating ("), stars.cast("string"), F.lit("★)"))),
            F.when(low(staffing), "Low staffing rating"),
        )
    )
