"""Feed entries and filing hits, landed as files, as articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import stripped
from ..functions.text import about_acquisitions
from ..operators.dedup import first_by

FILINGS_AT = "https://www.sec.gov/Archives/edgar/data"

# Companies and words that filings are searched by.
FILING_COMPANIES = [
    "Welltower", "Sabra Health Care", "CareTrust REIT", "Omega Healthcare", "National Health Investors", "LTC Properties",
    "Ensign Group", "Genesis Healthcare", "Brookdale Senior Living", "SavaSeniorCare", "ProMedica", "Kindred Healthcare",
    "Diversicare", "National HealthCare", "Communicare Health", "Trilogy Health", "Prestige Healthcare",
]
COMPANY_WORDS = '"acquisition" "skilled nursing"'
BROAD_WORDS = '"nursing home acquisition" OR "skilled nursing facility acquisition" OR "SNF portfolio"'


def filing_requests(spark: SparkSession, as_of: Column, days: int = 7) -> DataFrame:
    """The searches whose landed answers ``filing_articles`` reads, in their order: seq, q, entity, forms, startdt, enddt."""
    rows = [(i, COMPANY_WORDS, c, "8-K") for i, c in enumerate(FILING_COMPANIES)] + [(len(FILING_COMPANIES), BROAD_WORDS, None, "8-K")]
    day = as_of.cast("date")
    return spark.createDataFrame(rows, "seq int, q string, entity string, forms string").withColumns({"startdt": F.date_sub(day, days), "enddt": day})


def entry_date(*fields: Column) -> Column:
    """The first date that can be read."""
    mail = lambda c: F.try_to_timestamp(F.regexp_replace(c, r"^\w+, *", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(*(x for c in fields for x in (c.try_cast("timestamp"), mail(c))))


def read_feed(spark: SparkSession, path: str, feed_url: str) -> DataFrame:
    """Entries of landed feed files (RSS items and Atom entries) of one feed, as ``feed_articles`` wants them."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    none = F.lit(None).cast("string")
    items = read("item", "link string, title string, description string, pubDate string").select(
        "link", "title", F.col("description").alias("summary"), F.col("pubDate").alias("published"), none.alias("updated"), none.alias("created")
    )
    atom = read("entry", "link array<struct<_href: string, _rel: string>>, title string, summary string, content string, published string, updated string")
    own = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    entries = atom.select(F.get(own, F.lit(0))["_href"].alias("link"), "title", F.coalesce("summary", "content").alias("summary"), "published", "updated", none.alias("created"))
    return items.unionByName(entries).select(F.lit(feed_url).alias("feed_url"), "*")


def feed_articles(entries: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Recent entries with a link that are about acquisitions; alert feeds are relevant as they are."""
    e = entries.withColumn("published_at", entry_date(F.col("published"), F.col("updated"), F.col("created"))).withColumn("url", stripped(F.coalesce("link", F.lit(""))))
    recent = F.col("published_at").isNull() | (F.col("published_at") >= F.date_sub(as_of.cast("date"), days).cast("timestamp"))
    words = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    wanted = F.contains("feed_url", F.lit("google.com/alerts")) | about_acquisitions(words)
    return e.filter(recent & (F.col("url") != "") & wanted).select("url", "title", "published_at", F.lit("rss").alias("source_type"))


def filing_fields(file_id: Column, file_date: Column, names: Column, ciks: Column) -> dict[str, Column]:
    accession = F.split_part(file_id, F.lit(":"), F.lit(1))
    cik = F.coalesce(F.nullif(F.ltrim(F.get(ciks, F.lit(0)), F.lit("0")), F.lit("")), F.lit("0"))
    company = F.coalesce(F.get(names, F.lit(0)), F.lit("Unknown"))
    return {
        "url": F.concat_ws("/", F.lit(FILINGS_AT), cik, F.replace(accession, F.lit("-"), F.lit("")), F.split_part(file_id, F.lit(":"), F.lit(-1))),
        "title": F.concat(F.lit("[EDGAR 8-K] "), company, F.lit(" — filed "), file_date),
        "published_at": F.try_to_timestamp(file_date, F.lit("yyyy-MM-dd")),
        "accession": accession,
        "cik": cik,
    }


def filing_articles(responses: DataFrame) -> DataFrame:
    """Filings of all landed search responses, each url once, in the order of the responses (column seq)."""
    hits = responses.select("seq", F.posexplode("hits.hits").alias("pos", "hit"))
    named = filing_fields(F.col("hit._id"), F.col("hit._source.file_date"), F.col("hit._source.display_names"), F.col("hit._source.ciks"))
    rows = hits.filter("coalesce(hit._id, '') <> '' AND coalesce(hit._source.file_date, '') <> ''").select("seq", "pos", *(c.alias(n) for n, c in named.items()))
    return first_by(rows, ["url"], ["seq", "pos"])


def newest_first_union(parts: list[DataFrame], cap: int) -> DataFrame:
    """The first ``cap`` articles in the order of the parts, then of seq within a part."""
    ranked = [p.withColumn("source_rank", F.lit(i)) for i, p in enumerate(parts)]
    out = ranked[0]
    for p in ranked[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.orderBy("source_rank", "seq").limit(cap)


def unknown_articles(found: DataFrame, known: DataFrame) -> DataFrame:
    return found.join(known.select("url"), "url", "left_anti")
