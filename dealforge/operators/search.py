"""Name search over a table of trigrams: candidates by the rarest, then the rule itself.

The table has a row for each trigram of a deal's names in lower case. It is
stored in the order of the trigrams, so that Parquet's statistics leave out
all but the row groups that hold the wanted ones. Rows that a changed name
has left behind only make candidates that the rule then drops, so new names
are added and nothing has to be taken out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
#: Trigrams of a search that are looked up at most; any of them gives all hits.
LOOKED_UP = 32


def _grams(name: Column) -> Column:
    n = F.lower(F.coalesce(name, F.lit("")))
    at = F.when(F.length(n) >= GRAM, F.sequence(F.lit(1), F.length(n) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substring(n, i, F.lit(GRAM)))


def gram_table(deals: DataFrame) -> DataFrame:
    """gram, id of acquirer, seller and operators, in the order in which the table is to be stored."""
    operators = F.flatten(F.transform(F.coalesce("operator_names", F.array().cast("array<string>")), _grams))
    every = F.array_distinct(F.concat(_grams(F.col("acquiring_entity")), _grams(F.col("seller_entity")), operators))
    return deals.select(F.explode(every).alias("gram"), "id").repartitionByRange("gram", "id").sortWithinPartitions("gram", "id")


def literal_grams(search: str) -> list[str]:
    """Trigrams that every hit of a LIKE pattern around ``search`` has: those of its runs without wildcards. Only ASCII ones, as others may change with case."""
    runs, escaped = [""], False
    for c in search:
        if escaped or c not in "%_\\":
            runs[-1] += c.lower()
            escaped = False
        elif c == "\\":
            escaped = True
        else:
            runs.append("")
    found = (r[i : i + GRAM] for r in runs for i in range(len(r) - GRAM + 1))
    return [*dict.fromkeys(g for g in found if g.isascii())][:LOOKED_UP]


def candidates(table: DataFrame, search: str) -> DataFrame | None:
    """The ids under the rarest of the search's trigrams; None where it has none, as of less than three letters."""
    grams = literal_grams(search)
    if not grams:
        return None
    often = {r["gram"]: r["n"] for r in table.filter(F.col("gram").isin(grams)).groupBy("gram").agg(F.count("*").alias("n")).collect()}
    rarest = min(grams, key=lambda g: often.get(g, 0))
    return table.filter(F.col("gram") == rarest).select("id").distinct()


def narrowed(deals: DataFrame, table: DataFrame, search: str | None) -> DataFrame:
    """``deals`` that may hold the search: all of them where it is empty or too short."""
    ids = candidates(table, search) if search else None
    return deals if ids is None else deals.join(ids, "id", "left_semi")
