"""The deals view deals its lines out by order once, as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealforge.params import FeedFilter
from dealforge.operators import feed
from dealforge.plans.domain import Domain

SF = "/root/testdata/sf0.001"


def test_lines_are_dealt_out_once(spark):
    plan = Domain(spark, SF)._deals()._jdf.queryExecution().executedPlan().toString()
    assert "count(distinct" not in plan and "REPARTITION_BY_COL" in plan


def test_feed_page_holds_whole_rows_of_its_places(spark):
    """The page is placed by a few columns and then read whole: the same as sorting whole rows."""
    d = Domain(spark, SF)
    order = [F.coalesce("acquisition_date", F.col("created_at").cast("date")).desc(), F.col("created_at").desc(), "id"]
    want = feed.with_article(d.deals, d.articles, d.sources).filter("stage <> 'dismissed'").orderBy(*order).offset(5).limit(10)
    got = feed.feed_page(d.deals, d.articles, d.sources, d.matches, FeedFilter(offset=5, limit=10))
    cols = ["id", "states", "operator_names", "facility_names", "source_url"]
    assert [tuple(r) for r in got.select(cols).collect()] == [tuple(r) for r in want.select(cols).collect()]
    assert feed.feed_page(d.deals, d.articles, d.sources, d.matches, FeedFilter(offset=10**6)).count() == 0
