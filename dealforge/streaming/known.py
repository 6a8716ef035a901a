"""Stored rows by key, with Bloom filters beside each file, so that new rows meet few files.

The table at ``table`` has a folder ``_batch=n`` for each batch of an
incremental run. Beside it lie ``table-filters`` (for each stored file the
blocks of its Bloom filter) and ``table-counts`` (the counters of each batch),
in folders of the same names. All three of a batch are overwritten when it is
run again, and a batch doesn't see its own earlier rows, so running one twice
stores and counts its rows once.

A filter has 2**level blocks of 32,768 bits, enough for 20 bits a key. A key
has its block by one hash and eight bits in it by two others; some 0.0002 of
the keys that a file doesn't have pass. Files without a filter, as a run that
was broken off may leave them, are always read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..shared import exists

BATCH = "_batch"
BLOCK_BITS, BITS_A_KEY = 1 << 15, 20
_KEYS_A_BLOCK = BLOCK_BITS // BITS_A_KEY
_TOP_LEVEL = 24


def _positions(key: Column) -> list[Column]:
    """Eight bits of a block."""
    hashes = [F.xxhash64(key, F.lit(i)) for i in (1, 2)]
    return [F.shiftrightunsigned(h, 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for h in hashes for i in range(4)]


def _has(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), position % 8)) % 2 == 1


def filters_of(rows: DataFrame, key: str, file: str = "file") -> DataFrame:
    """file, level, block, bits: the filter of each file's keys."""
    sizes = rows.groupBy(file).agg(F.count("*").alias("_n"))
    # the smallest power of two of blocks that has room
    level = sum((F.col("_n") > _KEYS_A_BLOCK << i).cast("int") for i in range(_TOP_LEVEL))
    sized = rows.join(sizes.select(file, level.alias("level")), file)
    block = F.xxhash64(key).bitwiseAND(F.pow(F.lit(2), F.col("level")).cast("long") - 1)
    spread = sized.select(file, "level", block.alias("block"), F.explode(F.array(*_positions(F.col(key)))).alias("_at"))
    return spread.groupBy(file, "level", "block").agg(F.bitmap_construct_agg("_at").alias("bits"))


def passing(keys: DataFrame, key: str, filters: DataFrame, levels: list[int]) -> DataFrame:
    """key, file: the files that may have the key, all that have it among them. ``levels``: those of the filters."""
    own = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.xxhash64(key).bitwiseAND(F.lit((1 << n) - 1)).alias("block")) for n in levels))) if levels else F.explode(F.array().cast("array<struct<level: int, block: long>>"))
    asked = keys.select(key).distinct().select(key, own.alias("_x")).select(key, "_x.level", "_x.block")
    met = asked.join(filters, ["level", "block"])
    return met.filter(reduce(lambda a, b: a & b, (_has(F.col("bits"), p) for p in _positions(F.col(key))))).select(key, "file")


class KnownRows:
    """The rows stored at ``table``, each ``key`` once."""

    def __init__(self, spark: SparkSession, table: str, key: str) -> None:
        self.spark, self.table, self.key = spark, table.rstrip("/"), key

    def _at(self, what: str, batch: int | None = None) -> str:
        return f"{self.table}{what}" + ("" if batch is None else f"/{BATCH}={batch}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.table).drop(BATCH)

    def counts(self) -> DataFrame:
        """_batch and the counters of each batch: n_rows (as they came), n_new."""
        return self.spark.read.parquet(self._at("-counts"))

    def files(self, but: int | None = None) -> list[str]:
        """The stored files, without those of batch ``but``."""
        if not exists(self.spark, self.table):
            return []
        return [f for f in self.spark.read.parquet(self.table).inputFiles() if f"/{BATCH}={but}/" not in f]

    def candidates(self, rows: DataFrame, but: int | None = None) -> tuple[DataFrame | None, list[str]]:
        """key, file of what passes the filters, and the paths of the files to read: those that something passes, and those without a filter."""
        files = {f.rsplit("/", 1)[1]: f for f in self.files(but)}
        if not files or not exists(self.spark, self._at("-filters")):
            return None, sorted(files.values())
        filters = self.spark.read.parquet(self._at("-filters")).filter(F.col(BATCH) != (-1 if but is None else but))
        # a row a file
        covered = {r["file"]: r["level"] for r in filters.select("file", "level").distinct().collect()}
        passed = passing(rows, self.key, filters, sorted(set(covered.values())))
        met = {r[0] for r in passed.select("file").distinct().collect()}
        return passed, sorted(f for n, f in files.items() if n in met or n not in covered)

    def unknown(self, rows: DataFrame, but: int | None = None) -> DataFrame:
        """``rows`` whose key isn't stored. Rows with a null key are unknown."""
        _, files = self.candidates(rows, but)
        if not files:
            return rows
        return rows.join(self.spark.read.parquet(*files).select(self.key), self.key, "left_anti").select(rows.columns)

    def add(self, rows: DataFrame, batch: int, n_rows: int) -> None:
        """Store the unknown of ``rows`` (each key once) as batch ``batch``, their filters, and the batch's counters."""
        told = Observation()
        self.unknown(rows, batch).observe(told, F.count(F.lit(1)).alias("n_new")).write.mode("overwrite").parquet(self._at("", batch))
        stored = self.spark.read.parquet(self._at("", batch))
        named = stored.select(self.key, F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
        filters_of(named, self.key).write.mode("overwrite").parquet(self._at("-filters", batch))
        self.spark.createDataFrame([(n_rows, told.get["n_new"])], "n_rows long, n_new long").coalesce(1).write.mode("overwrite").parquet(self._at("-counts", batch))
