"""How a card of the feed words a deal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the kinds of sources; other kinds count as news.
LABELS = {"chow": "Federal Record", "edgar": "SEC Filing", "rss": "News"}


def day_label(day: Column, as_of: Column) -> Column:
    """Today, Yesterday, up to six days ago, else the date."""
    n = F.date_diff(as_of, day)
    return F.when(n == 0, "Today").when(n == 1, "Yesterday").when(n < 7, F.concat(n.cast("string"), F.lit(" days ago"))).otherwise(F.date_format(day, "MMM d, yyyy"))


def millions(value: Column) -> Column:
    return F.concat(F.lit("$"), F.replace(F.format_number(value.cast("double"), 1), F.lit(","), F.lit("")), F.lit("M"))


def is_new(created: Column, now: Column) -> Column:
    """Created less than 48 hours ago."""
    return F.coalesce(created > now - F.expr("interval 48 hours"), F.lit(False))


def source_label(kind: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    return F.coalesce(F.try_element_at(labels, kind), F.lit(LABELS["rss"]))


def headline(acquirer: Column, seller: Column, facilities: Column) -> Column:
    a, s, f = F.nullif(acquirer, F.lit("")), F.nullif(seller, F.lit("")), F.get(facilities, F.lit(0))
    return F.coalesce(
        F.concat(a, F.lit(" acquired from "), s),
        F.concat(a, F.lit(" — new ownership")),
        F.concat(s, F.lit(" changes ownership")),
        F.concat(f, F.lit(" — ownership change")),
        F.lit("Ownership change recorded"),
    )
