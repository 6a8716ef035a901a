"""Landed feeds and alert messages as streams of files, with a lane of rejects for what can't be read.

A file is one row of text (feeds and messages are small), so that a broken
one is known by name and takes no other's rows with it. What a batch has read
and what it has rejected lie in folders ``_batch=n`` of two tables, written
anew when the batch is run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MESSAGES
from .known import BATCH

_TEXT = "link string, title string, description string, pubDate string"
_ENTRY = "link array<struct<_href: string, _rel: string>>, title string, summary string, content string, published string, updated string"
_ITEMS = f"array<struct<{_TEXT.replace(' string', ': string')}>>"
_ENTRIES = "array<struct<link: array<struct<_href: string, _rel: string>>, title: string, summary: string, content: string, published: string, updated: string>>"
FEED = f"channel struct<item: {_ITEMS}>, item {_ITEMS}, entry {_ENTRIES}, _bad string"

#: Reads files (file, value) into rows and rejects (file, reason, value).
Parser = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def whole_files(spark: SparkSession, path: str, glob: str | None = None, files: int | None = None) -> DataFrame:
    """file, value of the files that land below ``path``, ``files`` of them a batch at most."""
    reader = spark.readStream.format("text").option("wholetext", True)
    for name, value in (("pathGlobFilter", glob), ("maxFilesPerTrigger", files)):
        reader = reader.option(name, value) if value else reader
    return reader.load(path).select(F.col("_metadata.file_path").alias("file"), "value")


def _rejected(read: DataFrame) -> DataFrame:
    return read.filter("reason IS NOT NULL").select("file", "reason", "value")


def feed_entries(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of RSS and Atom files as ``feeds.feed_articles`` wants them, with file in place of the feed's address."""
    x = F.from_xml("value", FEED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "attributePrefix": "_"})
    none = F.lit(None).cast("string")
    reason = F.when(F.col("x").isNull() | F.col("x._bad").isNotNull(), "malformed").when(F.coalesce(F.col("x.channel").isNotNull(), F.lit(False)) | F.col("x.item").isNotNull() | F.col("x.entry").isNotNull(), none).otherwise("not a feed")
    read = files.withColumn("x", x).withColumn("reason", reason)
    good = read.filter("reason IS NULL")
    items = good.select("file", F.explode(F.concat(*(F.coalesce(c, F.array().cast(_ITEMS)) for c in ("x.channel.item", "x.item")))).alias("i"))
    items = items.select("file", "i.link", "i.title", F.col("i.description").alias("summary"), F.col("i.pubDate").alias("published"), none.alias("updated"), none.alias("created"))
    atom = good.select("file", F.explode("x.entry").alias("e"))
    own = F.filter("e.link", lambda y: F.coalesce(y["_rel"], F.lit("alternate")) == "alternate")
    atom = atom.select("file", F.get(own, F.lit(0))["_href"].alias("link"), "e.title", F.coalesce("e.summary", "e.content").alias("summary"), "e.published", "e.updated", none.alias("created"))
    return items.unionByName(atom), _rejected(read)


def messages(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alert messages of JSON files that hold one, or an array of them, as ``mail.alert_articles`` wants them."""
    kind = "array<struct<" + MESSAGES.replace("id string", "id: string", 1).replace("payload struct", "payload: struct", 1) + ">>"
    read = files.withColumn("m", F.from_json("value", kind))
    whole = F.col("m").isNotNull() & (F.size(F.filter("m", lambda y: y.isNull() | y["payload"].isNull())) == 0)
    read = read.withColumn("reason", F.when(F.col("m").isNull(), "malformed").when(~whole, "no payload"))
    return read.filter("reason IS NULL").select("file", F.explode("m").alias("m")).select("file", "m.id", "m.payload"), _rejected(read)


def land(files: DataFrame, parse: Parser, table: str, checkpoint: str):
    """Write rows to ``table`` and rejects to ``table-rejects``, batch by batch."""

    def add(batch: DataFrame, number: int) -> None:
        batch.persist()
        for rows, to in zip(parse(batch), (table, f"{table}-rejects"), strict=True):
            rows.write.mode("overwrite").parquet(f"{to}/{BATCH}={number}")
        batch.unpersist()

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True)
