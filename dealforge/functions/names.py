"""Display names of legal entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DISPLAY_NAMES, LOWER_WORDS, NAME_SUFFIXES
from .clean import stripped

_TAIL = ".,;"


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it: Spark repeats expressions within branches."""
    return F.transform(F.array(c), f)[0]


def title_case(c: Column) -> Column:
    """Capitalised words; a first word of up to three letters in capitals, small words small."""

    def word(w: Column, i: Column) -> Column:
        capital = F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 1 << 20)))
        short = (F.length(w) <= 3) & w.rlike(r"^\p{L}+$")
        first = F.when(short, F.upper(w)).otherwise(capital)
        later = F.when(F.lower(w).isin(LOWER_WORDS), F.lower(w)).otherwise(capital)
        return F.when(i == 0, first).otherwise(later)

    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, word), " ")


def entity_name(c: Column) -> Column:
    """A readable name: known names by table, legal suffixes off, capitals eased. Null and empty stay."""
    name = F.rtrim(stripped(c), F.lit(_TAIL))
    for suffix in NAME_SUFFIXES:
        name = stripped(F.rtrim(stripped(F.regexp_replace(name, "(?i)" + suffix, "")), F.lit(_TAIL)))

    def eased(n: Column) -> Column:
        shouted = (F.upper(n) == n) & (F.lower(n) != n)
        return stripped(F.regexp_replace(F.when(shouted, title_case(n)).otherwise(n), r"\s+", " "))

    name = _once(_once(name, eased), lambda n: F.nullif(n, F.lit("")))
    known = F.create_map(*(F.lit(x) for kv in DISPLAY_NAMES.items() for x in kv))
    return F.when(F.coalesce(c, F.lit("")) == "", c).otherwise(F.coalesce(F.try_element_at(known, F.upper(stripped(c))), name, c))
