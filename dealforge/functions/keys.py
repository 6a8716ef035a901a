"""The stable hash by which one deal reported twice is known."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import GENERIC_OPERATORS, KEY_SUFFIXES
from .clean import stripped


def acquirer_key(c: Column) -> Column:
    """In capitals, suffixes cut out wherever they stand, in their order."""
    name = stripped(F.upper(F.coalesce(c, F.lit(""))))
    return stripped(reduce(lambda n, s: F.replace(n, F.lit(s), F.lit("")), KEY_SUFFIXES, name))


def states_key(c: Column) -> Column:
    return F.coalesce(F.array_join(F.array_sort(F.transform(c, F.upper)), ","), F.lit(""))


def value_key(c: Column) -> Column:
    """Tens of millions, halves to even; null and zero are empty."""
    tens = F.rint(c.cast("double") / 10) * 10
    return F.coalesce(F.when(c != 0, tens.cast("long").cast("string")), F.lit(""))


def operator_key(c: Column) -> Column:
    """The first in order of the operators that are really named."""
    named = F.filter(c, lambda o: (F.length(stripped(o)) > 5) & ~stripped(F.lower(o)).isin(GENERIC_OPERATORS))
    return F.coalesce(F.array_min(F.transform(named, lambda o: stripped(F.upper(o)))), F.lit(""))


def dedup_key(acquirer: Column, states: Column, date: Column, count: Column, value: Column, operators: Column) -> Column:
    month = F.coalesce(F.left(date.cast("string"), F.lit(7)), F.lit(""))
    parts = [acquirer_key(acquirer), states_key(states), month, F.coalesce(count.cast("string"), F.lit("")), value_key(value), operator_key(operators)]
    return F.concat_ws("|", *parts)


def dedup_hash(*fields: Column) -> Column:
    return F.left(F.sha2(dedup_key(*fields), 256), F.lit(16))


def semantic_key(acquirer: Column, states: Column, date: Column, count: Column) -> Column:
    """Null, and so never equal, where a part is null."""
    parts = [acquirer, F.array_join(states, "\u0001"), date.cast("string"), count.cast("string")]
    return F.when(reduce(lambda a, b: a & b, (p.isNotNull() for p in parts)), F.concat_ws("\u0002", *parts))
