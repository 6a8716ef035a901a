"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


def _two(df: DataFrame, one: tuple[Column, Column], other: tuple[Column, Column], names: tuple[str, str]) -> DataFrame:
    """Two rows for each of ``df``, made in one pass over it."""
    a, b = (F.struct(*(c.alias(n) for c, n in zip(x, names, strict=True))) for x in (one, other))
    return df.select(F.inline(F.array(a, b)))


def _star(near: DataFrame) -> DataFrame:
    """For rows (u, v): u's least neighbour or itself beside each row."""
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return near.join(least.hint("merge"), "u")


def _done(edges: DataFrame) -> bool:
    """Whether every id that points at a smaller one points at one only, and nothing points at it."""
    ends = _two(edges, (F.col("u"), F.lit(1)), (F.col("v"), F.lit(0)), ("id", "up"))
    return ends.groupBy("id").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).filter("ups > 1 OR ups = 1 AND n > 1").isEmpty()


def stars(links: DataFrame) -> DataFrame:
    """``links`` has a, b (long). Returns id, component (the smallest id reached), checkpointed, for ids that reach a smaller one.

    Each round points larger neighbours at the smallest one known, with
    grouped minima and joins only; every round is cut to the shared folder.
    Links that point at smallest ids already take no round.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    while not _done(edges):
        large = _star(_two(edges, (u, v), (v, u), ("u", "v"))).filter("v > u").select(v.alias("u"), m.alias("v"))
        edges = cut(_two(_star(large), (v, m), (u, m), ("u", "v")).filter("u <> v").distinct())
    return edges.select(u.alias("id"), v.alias("component"))


def components(links: DataFrame) -> DataFrame:
    """As ``stars``, with a row for every id that has links."""
    edges = stars(links)
    return edges.union(edges.select(F.col("component").alias("id"), "component").distinct())
