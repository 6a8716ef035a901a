"""Incremental discovery: a file stream in place of a daily poll."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import first_by
from ..shared import cut
from .known import KnownRows


def landed(spark: SparkSession, path: str, schema: str, glob: str | None = None, files: int | None = None) -> DataFrame:
    """New Parquet files below ``path`` as they land, ``files`` of them a batch at most."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def first_seen(rows: DataFrame, key: str, at: str, late: str = "7 days") -> DataFrame:
    """Each key once while it is within ``late`` of the newest row; older rows are late and go."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def per_window(rows: DataFrame, at: str, width: str, *by: str, late: str = "7 days") -> DataFrame:
    return rows.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"))


def window_counts(rows: DataFrame, at: str, width: str, *by: str, table: str, checkpoint: str, late: str = "7 days"):
    """Append each window's counts to ``table`` once it is ``late`` behind the newest row: start, the columns ``by``, n.

    Counts of open windows are kept in the state store below ``checkpoint``
    and go on from there when the stream is started again. Rows of windows
    that are closed are left out and counted (``late_groups``).
    """
    counted = per_window(rows, at, width, *by, late=late).select(F.col("window.start").alias("start"), *by, "n")
    return counted.writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The counts of windows that aren't closed yet, from the state store: start, the columns grouped by, n."""
    state = spark.read.format("statestore").load(checkpoint)
    key, value = (state.schema[c].dataType.names for c in ("key", "value"))
    return state.select(F.col("key")[key[0]]["start"].alias("start"), *(F.col("key")[c].alias(c) for c in key[1:]), F.col("value")[value[0]].alias("n"))


def late_groups(query) -> int:
    """Late rows that a run of ``window_counts`` has left out; rows of one task, window and group count as one, as they are added up before."""
    return sum(int(o["numRowsDroppedByWatermark"]) for p in query.recentProgress for o in p["stateOperators"])


def append_unknown(rows: DataFrame, table: str, checkpoint: str, key: str = "url", order: list[str] | None = None):
    """Append rows with a key that the table at path ``table`` doesn't hold; a batch that is run again adds and counts nothing twice.

    Of rows of one key in a batch the first in ``order`` is kept (by default,
    of all other columns). Stored files are read if their filters let one of
    the batch's keys pass, and of these the key only. The table is read with
    ``KnownRows``, as are the counters of each batch.
    """
    order = order or [c for c in rows.columns if c != key]

    def add(batch: DataFrame, number: int) -> None:
        store = KnownRows(batch.sparkSession, table, key)
        store.add(cut(first_by(batch, [key], order)), number, batch.count())

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True)
