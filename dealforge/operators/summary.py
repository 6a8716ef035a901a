"""The summary's counts kept up to date: changes of matches and notes as sums of ones, merged into stored counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import BucketedTable
from .feed import with_article

SIDES = {"matches": "cms_match_count", "annotations": "annotation_count"}


def ones(rows: DataFrame, side: str, one: int = 1) -> DataFrame:
    """id and both counts: ``one`` for each distinct (id, deal_id) of a side. Rows without a deal count nowhere."""
    own = [F.lit(one if c == SIDES[side] else 0).cast("long").alias(c) for c in SIDES.values()]
    return rows.filter("deal_id IS NOT NULL").select("id", "deal_id").distinct().select(F.col("deal_id").alias("id"), *own)


def difference(before: DataFrame, after: DataFrame, side: str) -> DataFrame:
    """What changed from one version of a side to another: rows that came count one, rows that went or left their deal one less."""

    def without(rows: DataFrame, others: DataFrame) -> DataFrame:
        # renamed, as both may come from one table
        o = others.select(F.col("id").alias("_id"), F.col("deal_id").alias("_deal_id"))
        return rows.select("id", "deal_id").join(o, (F.col("id") == F.col("_id")) & F.col("deal_id").eqNullSafe(F.col("_deal_id")), "left_anti")

    return ones(without(before, after), side, -1).unionByName(ones(without(after, before), side))


def summed(deltas: list[DataFrame]) -> DataFrame:
    """One row a deal, of the deals whose counts change."""
    sums = reduce(DataFrame.unionByName, deltas).groupBy("id").agg(*(F.sum(c).alias(c) for c in SIDES.values()))
    return sums.filter(" OR ".join(f"{c} <> 0" for c in SIDES.values()))


class SummaryCounts:
    """Stored counts of each deal that has, or had, matches or notes; an id counts once for a deal."""

    def __init__(self, spark: SparkSession, path: str, *, buckets: int = 256) -> None:
        self.table = BucketedTable(spark, path, ["id"], buckets=buckets)

    def create(self, matches: DataFrame, annotations: DataFrame) -> None:
        self.table.create(summed([ones(matches, "matches"), ones(annotations, "annotations")]))

    def apply(self, name: str, *deltas: DataFrame) -> list[int]:
        """Merge rows of ``ones`` or ``difference``; a change of one name counts once. Only the buckets of deals that change are rewritten."""

        def merge(stored: DataFrame, new: DataFrame) -> DataFrame:
            added = stored.unionByName(new).groupBy("id").agg(*(F.sum(c).alias(c) for c in SIDES.values()))
            wrong = reduce(lambda a, b: a | b, (F.col(c) < 0 for c in SIDES.values()))
            first = F.when(wrong, F.raise_error(F.lit("summary: more rows went than there were"))).otherwise(F.col("cms_match_count"))
            return added.withColumn("cms_match_count", first)

        return self.table.change(name, summed([*deltas]), merge)

    def read(self) -> DataFrame:
        return self.table.read()


def deal_summary(deals: DataFrame, articles: DataFrame, sources: DataFrame, counts: DataFrame) -> DataFrame:
    """As ``feed.deal_summary``, from stored counts."""
    out = with_article(deals, articles, sources).withColumnsRenamed({"source_url": "article_url", "source_title": "article_title"})
    return out.join(counts, "id", "left").na.fill(0, list(SIDES.values()))
