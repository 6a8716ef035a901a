"""The list of sources, and registry files of facilities and owners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import date_before_t, stripped

CHOW_NAME, CHOW_URL = "Change of Ownership Dataset", "https://data.cms.gov/provider-enrollment/skilled-nursing-facility-change-of-ownership"

# Public names, addresses and queries of the sources. A personal feed is configured by the user.
SOURCE_LIST = [
    ("Skilled Nursing News", "https://skillednursingnews.com/feed/", "rss"),
    ("McKnight's Long-Term Care News", "https://www.mcknights.com/feed/", "rss"),
    ("Modern Healthcare — Post-Acute", "https://www.modernhealthcare.com/section/post-acute-care/rss", "rss"),
    ("Provider Magazine", "https://www.providermagazine.com/feed/", "rss"),
    ("Senior Housing News", "https://seniorhousingnews.com/feed/", "rss"),
    ("Welltower (WELL)", "WELL", "edgar"),
    ("Sabra Health Care REIT (SBRA)", "SBRA", "edgar"),
    ("CareTrust REIT (CTRE)", "CTRE", "edgar"),
    ("National Health Investors (NHI)", "NHI", "edgar"),
    ("Omega Healthcare Investors (OHI)", "OHI", "edgar"),
    ("LTC Properties (LTC)", "LTC", "edgar"),
    ("Google News — nursing home acquisition", "nursing home acquisition skilled nursing", "googlenews"),
    ("Google News — SNF portfolio deal", "skilled nursing facility portfolio acquisition deal", "googlenews"),
    ("Google News — nursing home ownership change", "nursing home ownership change operator", "googlenews"),
    (CHOW_NAME, CHOW_URL, "chow"),
]


def active_sources(spark: SparkSession, source_type: str | None = None, *, extra: list[tuple[str, str, str]] = ()) -> DataFrame:
    """name, url, source_type, active; ``extra`` adds sources of the user."""
    rows = [(*s, True) for s in [*SOURCE_LIST, *extra]]
    df = spark.createDataFrame(rows, "name string, url string, source_type string, active boolean").filter("active")
    return df.filter(F.col("source_type") == source_type) if source_type else df


def read_facilities(spark: SparkSession, path: str) -> DataFrame:
    return facilities(spark.read.option("header", True).csv(path))


def facilities(raw: DataFrame) -> DataFrame:
    """Provider rows as facilities; rows without a provider number go."""
    text = lambda c: stripped(F.coalesce(F.col(f"`{c}`"), F.lit("")))
    number = lambda c: text(c).try_cast("int")
    yes = lambda c: F.upper(text(c)) == "Y"
    out = raw.select(
        text("Federal Provider Number").alias("ccn"), text("Provider Name").alias("provider_name"), text("Provider State").alias("provider_state"),
        text("Provider City").alias("provider_city"), text("Provider Zip Code").alias("provider_zip"), text("Ownership Type").alias("ownership_type"),
        text("Provider Type").alias("provider_type"), number("Number of Certified Beds").alias("bed_count"), number("Overall Rating").alias("five_star_rating"),
        number("Staffing Rating").alias("staffing_rating"), number("Health Inspection Rating").alias("health_insp_rating"),
        yes("In SFF (Y/N)").alias("sff_flag"), yes("In SFF Candidate (Y/N)").alias("sff_candidate_flag"),
    )
    return out.filter("ccn <> ''")


def owners(raw: DataFrame) -> DataFrame:
    """All-owner rows; those without enrollment id, owner name or association date go.

    The state is the owner's own, and the ccn holds the enrollment id, as in the source.
    """
    c = lambda name: F.col(f"`{name}`")
    person = F.nullif(stripped(F.concat_ws(" ", c("FIRST NAME - OWNER"), c("LAST NAME - OWNER"))), F.lit(""))
    out = raw.select(
        F.nullif(c("ENROLLMENT ID"), F.lit("")).alias("ccn"), c("ORGANIZATION NAME").alias("provider_name"),
        F.coalesce(F.nullif(c("ORGANIZATION NAME - OWNER"), F.lit("")), person).alias("owner_name"), c("TYPE - OWNER").alias("owner_type"),
        c("ROLE TEXT - OWNER").alias("owner_role"), c("PERCENTAGE OWNERSHIP").try_cast("decimal(5,2)").alias("ownership_percentage"),
        c("STATE - OWNER").alias("provider_state"), date_before_t(c("ASSOCIATION DATE - OWNER")).alias("ownership_start_date"),
    )
    return out.filter("ccn IS NOT NULL AND owner_name IS NOT NULL AND ownership_start_date IS NOT NULL")


def read_owners(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages of owner rows, each a JSON array."""
    return owners(spark.read.option("multiLine", True).option("primitivesAsString", True).json(path))
