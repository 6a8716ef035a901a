"""Change-of-ownership rows as deals that need no extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import stripped
from ..operators.dedup import first_by
from .registry import CHOW_NAME, CHOW_URL


def read_chow(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).withColumn("seq", F.monotonically_increasing_id())


def _fields(raw: DataFrame) -> DataFrame:
    text = lambda c: stripped(F.coalesce(F.col(f"`{c}`"), F.lit("")))
    rows = raw.select(
        "seq", text("ORGANIZATION NAME - BUYER").alias("buyer"), text("ORGANIZATION NAME - SELLER").alias("seller"), text("CCN - BUYER").alias("ccn"),
        text("ENROLLMENT STATE - BUYER").alias("state"), text("EFFECTIVE DATE").alias("day"), text("CHOW TYPE TEXT").alias("kind"),
    )
    return rows.withColumn("effective", F.try_to_timestamp("day", F.lit("M/d/yyyy")).cast("date")).filter("effective IS NOT NULL AND buyer <> '' AND ccn <> ''")


def synthetic_text() -> Column:
    # The wording of the record's text.
    form = (
        "CMS Skilled Nursing Facility Change of Ownership Record\n\nType: %s\nEffective Date: %s\nBuyer (New Owner): %s\nSeller (Prior Owner): %s\n"
        "CMS Certification Number (CCN): %s\nState: %s\n\nSource: CMS Provider Enrollment - SNF Change of Ownership dataset. "
        "This record represents a legally filed ownership change submitted to CMS."
    )
    return F.format_string(form, "kind", "day", "buyer", "seller", "ccn", "state")


def chow_deals(raw: DataFrame, cutoff: Column) -> DataFrame:
    """Deals of rows effective after ``cutoff``, the first for each provider number and date as written."""
    rows = first_by(_fields(raw).filter(F.col("effective") > cutoff), ["ccn", "day"], ["seq"])
    return rows.select(
        F.concat(F.lit(CHOW_URL + "#ccn-"), "ccn", F.lit("-"), F.replace("day", F.lit("/"), F.lit("-"))).alias("url"),
        F.concat(F.lit("[CHOW] "), "buyer", F.lit(" acquires "), F.coalesce(F.nullif("seller", F.lit("")), F.lit("facility")), F.lit(" (CCN: "), "ccn", F.lit(")")).alias("title"),
        F.col("effective").cast("timestamp").alias("published_at"), synthetic_text().alias("raw_text"), F.lit(CHOW_NAME).alias("source_name"), F.lit("chow").alias("source_type"),
        F.col("buyer").alias("acquiring_entity"), F.nullif("seller", F.lit("")).alias("seller_entity"), F.array("buyer").alias("operator_names"),
        F.array().cast("array<string>").alias("facility_names"), F.when(F.col("state") != "", F.array("state")).otherwise(F.array().cast("array<string>")).alias("states"),
        F.lit(1).alias("facility_count"), F.lit(None).cast("double").alias("deal_value_m"), F.col("effective").alias("acquisition_date"), "ccn", "seq",
    )


def chow_backfill(raw: DataFrame, cutoff: Column) -> DataFrame:
    """The one-off load: ``cutoff`` counts, rows are confirmed at once under an id of their own."""
    rows = _fields(raw).filter(F.col("effective") >= cutoff).withColumn("flat", F.replace("day", F.lit("/"), F.lit("")))
    rows = rows.select(
        F.concat(F.lit("chow://ccn-"), "ccn", F.lit("-"), "flat").alias("url"), F.concat(F.lit("[CHOW] "), "buyer", F.lit(" acquires from "), "seller").alias("title"),
        F.col("buyer").alias("acquiring_entity"), F.col("seller").alias("seller_entity"), F.array("buyer").alias("operator_names"), F.array("state").alias("states"),
        F.lit(1).alias("facility_count"), F.col("effective").alias("acquisition_date"), F.lit("confirmed").alias("stage"), F.concat(F.lit("chow-"), "ccn", F.lit("-"), "flat").alias("dedup_hash"), "seq",
    )
    return first_by(rows, ["url"], ["seq"])
