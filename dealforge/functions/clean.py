"""Cleaning of extracted fields: bad values become null, never errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import UNKNOWN_WORDS

_BLANKS = " \t\n\r\f\v"


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def clean_str(c: Column) -> Column:
    """Stripped; null if empty or a word for unknown."""
    s = stripped(c)
    return F.when((s != "") & ~F.lower(s).isin(UNKNOWN_WORDS), s)


def clean_list(c: Column) -> Column:
    """Stripped items without blanks; null gives an empty array."""
    return F.coalesce(F.filter(F.transform(c, stripped), lambda x: x != ""), F.array().cast("array<string>"))


def clean_list_variant(v: Column) -> Column:
    """A JSON value that is a list of strings or one string."""
    items = F.try_variant_get(v, "$", "array<string>")
    one = F.try_variant_get(v, "$", "string")
    return clean_list(F.coalesce(items, F.when(F.schema_of_variant(v) == "STRING", F.array(one))))


def clean_states(c: Column) -> Column:
    """The first two letters in capitals of every item of two or more."""
    return F.transform(F.filter(clean_list(c), lambda s: F.length(s) >= 2), lambda s: F.left(F.upper(s), F.lit(2)))


def clean_int(c: Column) -> Column:
    """A whole number in text; text with a fraction gives null."""
    return F.when(stripped(c).rlike(r"^[+-]?[0-9]+$"), stripped(c).try_cast("int"))


def clean_float(c: Column) -> Column:
    return stripped(c).try_cast("double")


def clean_date_text(c: Column) -> Column:
    """The text itself if it looks like YYYY-MM-DD, valid day or not."""
    s = stripped(c)
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s)


def clean_date(c: Column) -> Column:
    return clean_date_text(c).try_cast("date")


def date_before_t(c: Column) -> Column:
    """The date of a timestamp text, that is what stands before its T."""
    return F.split_part(c, F.lit("T"), F.lit(1)).try_cast("date")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def has_content(texts: list[Column], lists: list[Column]) -> Column:
    """Whether any field names an entity or a place, judged before cleaning (the word "null" counts)."""
    given = [F.coalesce(c, F.lit("")) != "" for c in texts] + [F.coalesce(F.size(c), F.lit(0)) > 0 for c in lists]
    return reduce(lambda a, b: a | b, given)
