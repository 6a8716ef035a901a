"""Stored tables in buckets of hashed keys, of which a change rewrites only those that it meets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import exists
from . import upsert as whole

BUCKET = "_bucket"


class BucketedTable:
    """Parquet files in folders ``_bucket=n`` by the hash of ``keys``.

    A change has a name. Its rows are stored first, then the new content of
    the buckets that they meet, then these buckets are overwritten, last the
    change is marked as done. A change that is run again under its name goes
    on where it was broken off, from what was stored: nothing is applied
    twice, and a bucket that was lost half way is written anew. Changes of one
    table may not run at the same time.

    Rows with a null key are in the bucket of their hash like any other.
    ``files``: files of a bucket, where one key may have very many rows.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], *, buckets: int = 256, files: int = 1) -> None:
        self.spark, self.path, self.keys, self.buckets, self.files = spark, path.rstrip("/"), keys, buckets, files

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, to: str, mode: str = "dynamic") -> None:
        """Overwrites the buckets that ``rows`` has, and (``static``) all others."""
        dealt = rows.repartition(BUCKET, F.pmod(F.xxhash64(*rows.columns), F.lit(self.files))) if self.files > 1 else rows.repartition(BUCKET)
        dealt.write.partitionBy(BUCKET).mode("overwrite").option("partitionOverwriteMode", mode).parquet(to)

    def create(self, rows: DataFrame) -> None:
        """Write the whole table; what was there goes."""
        self._write(rows.withColumn(BUCKET, self._bucket()), self.path, "static")

    def _stored(self) -> DataFrame:
        schema = self.spark.read.parquet(self.path).drop(BUCKET).schema
        return self.spark.read.schema(T.StructType([*schema, T.StructField(BUCKET, T.IntegerType())])).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def change(self, name: str, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Apply ``merge(stored, rows)`` to the buckets of ``rows``; returns their numbers.

        ``merge`` gets the stored rows of these buckets, all of them, and
        returns what they hold from now on, at least one row of each bucket
        that held any. ``rows`` must have the table's keys.
        """
        log = f"{self.path}-changes/{name}"
        if not exists(self.spark, f"{log}/rows/_SUCCESS"):
            rows.withColumn(BUCKET, self._bucket()).write.mode("overwrite").parquet(f"{log}/rows")
        new = self.spark.read.parquet(f"{log}/rows")
        # as many numbers as buckets at most
        met = sorted(r[0] for r in new.select(BUCKET).distinct().collect())
        if met and not exists(self.spark, f"{log}/done/_SUCCESS"):
            if not exists(self.spark, f"{log}/merged/_SUCCESS"):
                stored = self._stored()
                merged = merge(stored.filter(F.col(BUCKET).isin(met)).drop(BUCKET), new.drop(BUCKET)).select(stored.drop(BUCKET).columns)
                # only a static overwrite leaves the mark of a whole folder
                self._write(merged.withColumn(BUCKET, self._bucket()), f"{log}/merged", "static")
            self._write(self.spark.read.parquet(f"{log}/merged"), self.path)
            self.spark.createDataFrame([(name, len(met))], "change string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{log}/done")
        return met

    def upsert(self, name: str, rows: DataFrame, update: list[str], stamp: tuple[str, Column] | None = None) -> list[int]:
        """As ``upsert.upsert`` by the table's keys."""
        return self.change(name, rows, lambda stored, new: whole.upsert(stored, new, self.keys, update, stamp))

    def insert_absent(self, name: str, rows: DataFrame) -> list[int]:
        return self.change(name, rows, lambda stored, new: whole.insert_absent(stored, new, self.keys))

    def replace_groups(self, name: str, rows: DataFrame) -> list[int]:
        """As ``upsert.replace_groups``; the table's key is the group's."""
        (key,) = self.keys
        return self.change(name, rows, lambda stored, new: whole.replace_groups(stored, new, key))

    def change_stage(self, name: str, decided: DataFrame, now: Column) -> list[int]:
        """As ``upsert.change_stage``, of a table of deals by id."""
        return self.change(name, decided, lambda stored, new: whole.change_stage(stored, new, now))
