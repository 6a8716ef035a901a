"""Which of equal records stays: always the first in a stated order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import dedup_hash, semantic_key
from ..shared import cut


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. Grouped minima, so that a hot key shrinks before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*order, *(F.col(c).alias(c) for c in rest))
    rank = F.struct(*order)
    out = df.groupBy(*keys).agg(F.min_by(packed, rank).alias("_first"))
    return out.select(*(F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns))


def with_hash(deals: DataFrame) -> DataFrame:
    return deals.withColumn("dedup_hash", dedup_hash(*(F.col(c) for c in ("acquiring_entity", "states", "acquisition_date", "facility_count", "deal_value_m", "operator_names"))))


def batch_dedup(deals: DataFrame, order: list[str], article: str = "article_id") -> DataFrame:
    """The first deal of each hash within its article. Hashes are of the names as they came."""
    return first_by(with_hash(deals), [article, "dedup_hash"], order)


def not_stored(deals: DataFrame, stored: DataFrame) -> DataFrame:
    """Deals whose hash isn't stored yet."""
    return deals.join(stored.select("dedup_hash"), "dedup_hash", "left_anti")


def _settled(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """``rows`` with state: 1 for those in ``kept`` (id, h, k), 2 for those that share h or k with one, else 0."""
    by_h, by_k = (kept.select(c, F.col("id").alias("_by_" + c)) for c in ("h", "k"))
    met = rows.join(by_h, "h", "left").join(by_k, "k", "left")
    first = F.col("_by_h") == F.col("id")  # each h and k is in one kept row at most
    state = F.when(first, 1).when(F.col("_by_h").isNotNull() | F.col("_by_k").isNotNull(), 2).otherwise(0)
    return met.select("id", "h", "k", "o", state.alias("state"))


def _least(rows: DataFrame) -> DataFrame:
    """``rows`` beside the first row of their h and of their k: h1, k1 (orders). Grouped minima, so that a hot key shrinks before the shuffle."""
    return rows.join(rows.groupBy("h").agg(F.min("o").alias("h1")), "h").join(rows.groupBy("k").agg(F.min("o").alias("k1")), "k")


def _simple_round(rows: DataFrame) -> DataFrame:
    """Rows that are first in both of their groups are kept."""
    return _settled(rows, _least(rows).filter("o = h1 AND o = k1").select("id", "h", "k"))


def _chain_round(rows: DataFrame) -> DataFrame:
    """Rows with one earlier neighbour only are kept where that one isn't; their chains are gone up by doubling.

    A row that is first by one key and second by the other has the first of
    the other as its only earlier neighbour. The links of a chain are joined
    in pairs, so a chain of n rows takes log n joins.
    """
    least = cut(_least(rows))
    second = lambda c: least.filter(f"o > {c}1").groupBy(c).agg(F.min("o").alias(f"{c}2"))
    placed = least.join(second("h"), "h", "left").join(second("k"), "k", "left")
    up = F.when((F.col("o") == F.col("h1")) & (F.col("o") == F.col("k2")), F.col("k1")).when((F.col("o") == F.col("k1")) & (F.col("o") == F.col("h2")), F.col("h1"))
    at = cut(placed.select("id", "h", "k", up["id"].alias("up"), F.lit(True).alias("odd"), ((F.col("o") == F.col("h1")) & (F.col("o") == F.col("k1"))).alias("root")))
    links, tops = at.filter("up IS NOT NULL").select("id", "up", "odd"), at.filter("up IS NULL")
    while True:
        above = links.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("odd").alias("_odd"))
        further = links.join(above, "up", "left")
        far = F.col("_up").isNotNull()
        links = cut(further.select("id", F.coalesce("_up", "up").alias("up"), F.when(far, F.col("odd") != F.col("_odd")).otherwise(F.col("odd")).alias("odd"), far.alias("moved")))
        if links.filter("moved").isEmpty():
            break
        links = links.drop("moved")
    known = links.join(tops.filter("root").select(F.col("id").alias("up")), "up", "left_semi").filter("NOT odd").select("id")
    kept = at.join(known, "id", "left_semi").select("id", "h", "k").union(tops.filter("root").select("id", "h", "k"))
    return _settled(rows, cut(kept))


def first_matching(rows: DataFrame) -> DataFrame:
    """``rows`` has id, h, k and o (a struct that orders them and holds id). The ids of those that are kept when all are gone through in order and one is left out if its h or its k is that of a kept one.

    In each round the rows that are first by both keys are kept, and all that
    share a key with them are out; what is undecided goes on, cut to the
    shared folder. A round that decides less than half of the rows has met
    chains, which the next round goes up by doubling.
    """
    left = cut(rows.select("id", "h", "k", "o"))
    n, kept, simple = left.count(), [], True
    while n:
        told = cut((_simple_round if simple else _chain_round)(left))
        kept.append(told.filter("state = 1").select("id"))
        left, before = told.filter("state = 0").drop("state"), n
        n = left.count()
        simple = not simple or 2 * n <= before
    return reduce(DataFrame.union, kept) if kept else left.select("id")


def greedy_unique(deals: DataFrame, order: list[str]) -> DataFrame:
    """Take deals in order; one whose hash or semantic key was taken before is left out, and takes neither.

    Of rows with both keys equal only the first can stay, so these shrink
    before the shuffle; the rest is gone through in rounds (``first_matching``).
    ``id`` may come once.
    """
    semantic = semantic_key(*(F.col(c) for c in ("acquiring_entity", "states", "acquisition_date", "facility_count")))
    slim = deals.select("id", "dedup_hash", semantic.alias("_semantic"), F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), "id").alias("o"))
    pairs = slim.groupBy(F.col("dedup_hash").alias("h"), "_semantic").agg(F.min("o").alias("o"))
    # a null key equals nothing, so it is made one of its own, spread by the hash
    key = F.coalesce(F.concat(F.lit("k"), "_semantic"), F.concat(F.lit("h"), "h"))
    return deals.join(first_matching(pairs.select(F.col("o.id").alias("id"), "h", key.alias("k"), "o")), "id", "left_semi")


def semantic_conflicts(deals: DataFrame, stored: DataFrame) -> DataFrame:
    """Deals whose semantic key isn't stored yet."""
    key = semantic_key(*(F.col(c) for c in ("acquiring_entity", "states", "acquisition_date", "facility_count")))
    have = stored.select(key.alias("_semantic")).filter("_semantic IS NOT NULL").distinct()
    return deals.withColumn("_semantic", key).join(have, "_semantic", "left_anti").drop("_semantic")


def latest_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key, for upserts where the last in the file counts. Grouped maxima, as in ``first_by``."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return out.select(*(F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in df.columns))
