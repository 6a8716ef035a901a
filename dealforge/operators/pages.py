"""The feed stored in its order, so that any page is read alone and the total is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import cut

BLOCK, RANK = "_block", "_rank"
#: Rows of a block: what a page reads at least.
BLOCK_ROWS = 100_000


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with their place (from 0) in the feed's order: day and time of the deal, newest first, then id.

    Rows are dealt into ranges of the order; each is sorted by itself, and
    its first place is the sum of the ranges before it. Nothing is sorted in
    one task.
    """
    order = [F.coalesce("acquisition_date", F.col("created_at").cast("date")).desc(), F.col("created_at").desc(), F.col("id")]
    dealt = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    # a row a range: as many as Spark has made partitions
    before = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_place", place).join(before, "_part").select(*rows.columns, (F.col("_before") + F.col("_place")).alias(RANK))


class FeedPages:
    """Rows of the feed in folders ``_block=n`` of neighbouring places."""

    def __init__(self, spark: SparkSession, path: str, *, block_rows: int = BLOCK_ROWS) -> None:
        self.spark, self.path, self.block_rows = spark, path.rstrip("/"), block_rows

    def create(self, rows: DataFrame) -> None:
        """Store all rows, and their number. Made anew when the deals have changed."""
        placed = ranked(rows).withColumn(BLOCK, F.floor(F.col(RANK) / self.block_rows))
        placed.repartition(BLOCK).write.partitionBy(BLOCK).mode("overwrite").parquet(f"{self.path}/rows")
        self.spark.read.parquet(f"{self.path}/rows").agg(F.count("*").alias("total")).write.mode("overwrite").parquet(f"{self.path}/total")

    def total(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/total")

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows of the places offset to offset + limit - 1, in order; only their blocks are read."""
        first, last = offset // self.block_rows, (offset + limit - 1) // self.block_rows
        rows = self.spark.read.parquet(f"{self.path}/rows").filter(F.col(BLOCK).between(first, last))
        return rows.filter(F.col(RANK).between(offset, offset + limit - 1)).orderBy(RANK).limit(limit).drop(BLOCK, RANK)

    def after(self, day: str, created_at: str, key: int | str, limit: int) -> DataFrame:
        """The rows that follow a row of this day, time and id: of its block and the next."""
        rows = self.spark.read.parquet(f"{self.path}/rows")
        own = F.coalesce("acquisition_date", F.col("created_at").cast("date"))
        at, d = F.lit(created_at).cast(rows.schema["created_at"].dataType), F.lit(day).cast("date")
        later = (own < d) | ((own == d) & ((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") > F.lit(key)))))
        # places are in order, so the first later one tells where the page begins
        first = rows.filter(later).agg(F.min(RANK)).first()[0]
        return self.page(first, limit) if first is not None else self.page(0, 1).limit(0)
