"""Pages of the stored feed: places, what is read, totals."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from dealforge.operators import pages


def scanned(spark, page):
    """Rows that the scan of a page has read."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = page()
        df._jdf.collectToPython()
        return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().get("numOutputRows").get().value()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_pages(spark, tmp_path):
    rnd = random.Random(2)
    day = dt.date(2026, 1, 1)
    rows = [(i, day - dt.timedelta(rnd.randrange(40)) if i % 3 else None, dt.datetime(2026, 1, 1) - dt.timedelta(days=rnd.randrange(60), hours=rnd.randrange(3))) for i in range(2500)]
    want = [i for i, _, _ in sorted(rows, key=lambda r: (-(r[1] or r[2].date()).toordinal(), -r[2].timestamp(), r[0]))]
    feed = pages.FeedPages(spark, f"file://{tmp_path}/feed", block_rows=200)
    feed.create(spark.createDataFrame(rows, "id long, acquisition_date date, created_at timestamp_ntz").repartition(5))
    assert feed.total().first().total == 2500
    for offset, limit in ((0, 20), (190, 20), (1999, 100), (2490, 50), (9000, 10)):
        assert [r.id for r in feed.page(offset, limit).collect()] == want[offset : offset + limit]
    assert scanned(spark, lambda: feed.page(2000, 20)) == 200 and scanned(spark, lambda: feed.page(190, 20)) == 400
    by_id = {r[0]: r for r in rows}
    at = by_id[want[1200]]
    got = feed.after(str(at[1] or at[2].date()), str(at[2]), at[0], 30)
    assert [r.id for r in got.collect()] == want[1201:1231]
    last = by_id[want[-1]]
    assert feed.after(str(last[1] or last[2].date()), str(last[2]), last[0], 30).count() == 0


def test_places_are_dense(spark):
    df = spark.range(1000).select("id", F.lit(None).cast("date").alias("acquisition_date"), F.timestamp_seconds(F.col("id") % 7 * 86400).alias("created_at"))
    got = pages.ranked(df).select(pages.RANK).collect()
    assert sorted(r[0] for r in got) == list(range(1000))
    assert pages.ranked(df.limit(0)).count() == 0
