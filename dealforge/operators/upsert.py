"""Changes to stored tables as new versions of them: plain files have no MERGE."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, new: DataFrame, keys: list[str], update: list[str], stamp: tuple[str, Column] | None = None) -> DataFrame:
    """``base`` with the columns ``update`` taken from ``new`` where all keys are equal, and its other rows added.

    ``new`` has the columns of ``base``; a null key equals nothing. A key may
    come once: reduce repeats with ``latest_by`` first, or the job fails, since
    they would double rows. ``stamp`` names a column that changed rows get, such
    as updated_at.
    """
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    once = new.filter(whole).groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*new.columns)).alias("_row"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.lit("upsert: a key comes twice"))).otherwise(F.col("_row"))
    new = once.select(checked.alias("_row")).select("_row.*").unionByName(new.filter(~whole))
    n = new.select(*(F.col(c).alias("_n_" + c) for c in new.columns), F.lit(True).alias("_hit"))
    on = [base[k] == n["_n_" + k] for k in keys]
    hit = F.col("_hit").isNotNull()

    def value(c: str) -> Column:
        if stamp and c == stamp[0]:
            return F.when(hit, stamp[1]).otherwise(F.col(c)).alias(c)
        return F.when(hit, F.col("_n_" + c)).otherwise(F.col(c)).alias(c) if c in update else F.col(c)

    changed = base.join(n, on, "left").select(*(value(c) for c in base.columns))
    added = new.join(base.select(*keys), keys, "left_anti").select(base.columns)
    return changed.unionByName(added)


def insert_absent(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(new.join(base.select(*keys), keys, "left_anti").select(base.columns))


def replace_groups(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the groups that ``new`` has give way to its rows; groups without new rows keep theirs."""
    return base.join(new.select(key).distinct(), key, "left_anti").select(base.columns).unionByName(new.select(base.columns))


def change_stage(deals: DataFrame, decided: DataFrame, now: Column) -> DataFrame:
    """``decided``: id, stage, confidence, recheck_after; recheck_count goes up by one."""
    d = decided.select(F.col("id"), *(F.col(c).alias("_d_" + c) for c in ("stage", "confidence", "recheck_after")), F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull()
    new = {c: F.col("_d_" + c) for c in ("stage", "confidence", "recheck_after")} | {"recheck_count": F.col("recheck_count") + 1, "updated_at": now}
    return deals.join(d, "id", "left").select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in deals.columns))
