"""Alert messages, landed as JSON, as articles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import stripped
from ..operators.dedup import first_by
from ..params import MAIL_DAYS, MAIL_MESSAGES
from ..schemas import MESSAGES

# The patterns of redirect links decide the results.
_ANGLE = r"<https://www\.google\.com/url\?[^>]*[?&]url=([^&>]+)"
_BARE = r"https://www\.google\.com/url\?[^\s]*[?&]url=([^&\s<>]+)"
_LINK = r'href="https://www\.google\.com/url\?[^"]*[?&]url=([^&"]+)[^"]*"[^>]*>([^<]+)</a>'


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Landed alert messages: JSON files of one message, or of an array of them."""
    return spark.read.schema(MESSAGES).option("multiLine", True).json(path)


def unquoted(c: Column) -> Column:
    """Percent-decoding that leaves plus signs alone; text that can't be decoded stays."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def mail_date(c: Column, as_of: Column) -> Column:
    """A bad date counts as now, a missing one as null."""
    read = F.try_to_timestamp(F.regexp_replace(c, r"^\w+, *", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.when(F.coalesce(c, F.lit("")) != "", F.coalesce(read, as_of.cast("timestamp")))


def _decoded(data: Column) -> Column:
    return F.try_validate_utf8(F.decode(F.unbase64(F.translate(data, "-_", "+/")), "UTF-8"))


def body_of(mime: str) -> Column:
    """The first body of this kind: the message's own, then its parts', each followed by its sub-parts'."""
    empty = F.array().cast("array<struct<mimeType: string, body: struct<data: string>>>")
    parts = F.flatten(F.transform(F.col("payload.parts"), lambda p: F.concat(F.array(F.struct(p["mimeType"].alias("mimeType"), p["body"].alias("body"))), F.coalesce(p["parts"], empty))))
    every = F.concat(F.array(F.struct(F.col("payload.mimeType").alias("mimeType"), F.col("payload.body").alias("body"))), F.coalesce(parts, empty))
    fit = F.filter(every, lambda p: (p["mimeType"] == mime) & (F.coalesce(p["body"]["data"], F.lit("")) != ""))
    return _decoded(F.get(fit, F.lit(0))["body"]["data"])


def _is_title(line: Column) -> Column:
    return (line != "") & ~F.startswith(line, F.lit("<http")) & ~F.contains(line, F.lit("google.com")) & ~F.startswith(line, F.lit("-")) & (F.length(line) > 5)


def plain_links(messages: DataFrame, body: str = "body") -> DataFrame:
    """id, pos, url, title of each redirect link in a plain body; the title is the nearest fitting line of the three before."""
    lines = F.transform(F.split(body, "\n"), stripped)
    # each line with the three before it, so that a row's size doesn't grow with the message
    near = F.transform("lines", lambda x, i: F.struct(x.alias("line"), F.array(*(F.when(i >= n, F.get("lines", i - n)) for n in (1, 2, 3))).alias("before")))
    split = messages.select("id", F.explode(F.array(lines)).alias("lines")).select("id", F.posexplode(near).alias("pos", "x")).select("id", "pos", "x.line", "x.before")
    target = F.coalesce(F.nullif(F.regexp_extract("line", _ANGLE, 1), F.lit("")), F.nullif(F.regexp_extract("line", _BARE, 1), F.lit("")))
    found = split.withColumn("url", unquoted(target)).filter("url IS NOT NULL AND url <> '' AND NOT contains(url, 'google.com')")
    title = F.coalesce(*(F.when(_is_title(x), x) for x in (F.get("before", F.lit(i)) for i in range(3))), F.col("url"))
    return found.select("id", "pos", "url", title.alias("title"))


def html_links(messages: DataFrame, body: str = "body") -> DataFrame:
    """id, pos, url, title of each redirect link in an HTML body."""
    pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit(_LINK), F.lit(1)).alias("u"), F.regexp_extract_all(body, F.lit(_LINK), F.lit(2)).alias("t"))
    found = messages.select("id", F.posexplode(pairs).alias("pos", "x")).select("id", "pos", unquoted(F.col("x")["u"]).alias("url"), stripped(F.col("x")["t"]).alias("title"))
    return found.filter("url <> '' AND NOT contains(url, 'google.com')").withColumn("url", stripped(F.col("url")))


def recent(messages: DataFrame, as_of: Column, *, days: int = MAIL_DAYS, most: int = MAIL_MESSAGES) -> DataFrame:
    """What one scan looks at: the newest ``most`` messages since the day ``days`` before; undated ones come last."""
    at = mail_date(_header("Date"), as_of)
    since = F.date_sub(as_of.cast("date"), days).cast("timestamp")
    return messages.withColumn("_at", at).filter(F.col("_at").isNull() | (F.col("_at") >= since)).orderBy(F.col("_at").desc_nulls_last(), "id").limit(most).drop("_at")


def _header(name: str) -> Column:
    return F.get(F.filter("payload.headers", lambda h: h["name"] == name), F.lit(0))["value"]


def alert_articles(messages: DataFrame, as_of: Column) -> DataFrame:
    """Articles of all messages, each url once: of the plain body, or of the HTML body where that has none."""
    base = messages.select("id", mail_date(_header("Date"), as_of).alias("published_at"), body_of("text/plain").alias("plain"), body_of("text/html").alias("html"))
    plain = plain_links(base, "plain")
    html = html_links(base.join(plain.select("id").distinct(), "id", "left_anti"), "html")
    both = reduce(DataFrame.unionByName, [plain, html]).join(base.select("id", "published_at"), "id")
    return first_by(both.withColumn("source_type", F.lit("rss")), ["url"], ["id", "pos"])
