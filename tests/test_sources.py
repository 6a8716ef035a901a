"""Landed files as articles and deals."""

from __future__ import annotations

import base64
import datetime as dt
import json

from pyspark.sql import functions as F

from dealforge.functions.text import html_text, text_gate
from dealforge.schemas import CHOW_COLUMNS, FEED_ENTRIES, FILING_HITS, MESSAGES
from dealforge.sources import chow, feeds, mail, registry

D = dt.date


def now():
    return F.lit("2026-01-20").cast("timestamp")


def test_feed_rules(spark):
    rows = [
        ("f", " http://a ", "REIT acquires homes", None, "2026-01-15T00:00:00Z", None, None),
        ("f", "http://old", "deal", None, "2026-01-01T00:00:00Z", None, None),
        ("f", "http://undated", "deal", None, None, None, None),
        ("f", "http://other", "weather", "rain", None, "Mon, 19 Jan 2026 06:00:00 +0000", None),
        ("https://www.google.com/alerts/x", "http://alert", "weather", None, None, None, None),
        ("f", "", "deal", None, None, None, None),
    ]
    got = {r.url: r.published_at for r in feeds.feed_articles(spark.createDataFrame(rows, FEED_ENTRIES), now()).collect()}
    assert set(got) == {"http://a", "http://undated", "http://alert"}


def test_filings(spark):
    hits = [{"_id": "0001-26-01:doc.htm", "_source": {"file_date": "2026-01-05", "display_names": ["X"], "ciks": ["000012"]}}, {"_id": "0001-26-01:doc.htm", "_source": {"file_date": "2026-01-06", "display_names": [], "ciks": ["12"]}},
            {"_id": "", "_source": {"file_date": "2026-01-06"}}, {"_id": "7:z", "_source": {"file_date": "2026-01-06", "display_names": [], "ciks": ["000"]}}]
    df = spark.createDataFrame([(json.dumps({"hits": {"hits": hits}}),)], "j string").select(F.from_json("j", FILING_HITS).alias("r")).select(F.lit(0).alias("seq"), "r.hits")
    got = sorted((r.url, r.title) for r in feeds.filing_articles(df).collect())
    assert got == [("https://www.sec.gov/Archives/edgar/data/0/7/z", "[EDGAR 8-K] Unknown — filed 2026-01-06"), ("https://www.sec.gov/Archives/edgar/data/12/00012601/doc.htm", "[EDGAR 8-K] X — filed 2026-01-05")]


def test_chow(spark, tmp_path):
    rows = [("Buyer", "Seller", "1", "CHANGE OF OWNERSHIP", "1/5/2026", "VA"), ("Again", "S", "1", "C", "1/5/2026", "VA"), ("Padded", "", "1", "C", "01/05/2026", ""), ("", "S", "2", "C", "1/5/2026", "VA"),
            ("B", "S", "3", "C", "13/45/2026", "VA"), ("B", "S", "4", "C", "1/1/2026", "VA")]
    path = tmp_path / "chow.csv"
    path.write_text("\n".join(",".join(f'"{x}"' for x in r) for r in [CHOW_COLUMNS, *rows]))
    raw = chow.read_chow(spark, str(path))
    got = sorted((r.acquiring_entity, r.seller_entity, r.states, r.url.split("#")[1], r.acquisition_date) for r in chow.chow_deals(raw, F.lit(D(2026, 1, 1))).collect())
    assert got == [("Buyer", "Seller", ["VA"], "ccn-1-1-5-2026", D(2026, 1, 5)), ("Padded", None, [], "ccn-1-01-05-2026", D(2026, 1, 5))]
    assert sorted(r.dedup_hash for r in chow.chow_backfill(raw, F.lit(D(2026, 1, 1))).collect()) == ["chow-1-01052026", "chow-1-152026", "chow-4-112026"]


def test_mail(spark):
    enc = lambda s: base64.urlsafe_b64encode(s.encode()).decode()
    plain = "A fine title\nNews\n<https://www.google.com/url?rct=j&url=https://x.org/a%20b+c&ct=ga>\nhttps://www.google.com/url?q=1&url=https://google.com/y&z\n"
    html = '<a href="https://www.google.com/url?rct=j&url=https://h.org/p&ct=ga" class="z"> Html title </a>'
    part = lambda mime, data: {"mimeType": mime, "body": {"data": data}}
    messages = [
        {"id": "1", "payload": {"mimeType": "multipart/mixed", "headers": [{"name": "Date", "value": "Mon, 12 Jan 2026 06:00:00 +0000"}], "parts": [part("text/html", enc(html)), part("text/plain", enc(plain))]}},
        {"id": "2", "payload": {"mimeType": "multipart/mixed", "headers": [], "parts": [{"mimeType": "multipart/alternative", "parts": [part("text/plain", enc("nothing")), part("text/html", enc(html + "é"))]}]}},
        {"id": "3", "payload": {"mimeType": "text/plain", "headers": [{"name": "Date", "value": "bad"}], "body": {"data": enc("x\n" + plain)}}},
        {"id": "4", "payload": {"mimeType": "text/plain"}},
    ]
    df = spark.createDataFrame([(json.dumps(m),) for m in messages], "j string").select(F.from_json("j", MESSAGES).alias("m")).select("m.*")
    got = {r.url: (r.id, r.title) for r in mail.alert_articles(df, now()).collect()}
    assert got == {"https://x.org/a b+c": ("1", "A fine title"), "https://h.org/p": ("2", "Html title")}


def test_registry(spark, tmp_path):
    assert registry.active_sources(spark, "edgar").count() == 6
    raw = spark.createDataFrame([(" 1 ", "N", "VA", "C", "2", "O", "T", "x", "5", "", "3", "y", "N"), ("", *"abcdefghijkl")], "`Federal Provider Number` string, `Provider Name` string, `Provider State` string, `Provider City` string, `Provider Zip Code` string, `Ownership Type` string, `Provider Type` string, `Number of Certified Beds` string, `Overall Rating` string, `Staffing Rating` string, `Health Inspection Rating` string, `In SFF (Y/N)` string, `In SFF Candidate (Y/N)` string")
    r = registry.facilities(raw).collect()
    assert len(r) == 1 and (r[0].ccn, r[0].bed_count, r[0].five_star_rating, r[0].staffing_rating, r[0].sff_flag) == ("1", None, 5, None, True)
    page = [{"ENROLLMENT ID": "I1", "ORGANIZATION NAME": "P", "ORGANIZATION NAME - OWNER": "", "FIRST NAME - OWNER": "Ann", "LAST NAME - OWNER": None, "TYPE - OWNER": "I", "ROLE TEXT - OWNER": "r", "STATE - OWNER": "VA", "ASSOCIATION DATE - OWNER": "2020-01-02T00:00:00", "PERCENTAGE OWNERSHIP": "12.5"},
            {"ENROLLMENT ID": "I2", "ORGANIZATION NAME": "P", "ORGANIZATION NAME - OWNER": "O", "ASSOCIATION DATE - OWNER": ""}]
    (tmp_path / "p.json").write_text(json.dumps(page))
    got = registry.read_owners(spark, str(tmp_path)).collect()
    assert [(r.ccn, r.owner_name, r.ownership_start_date) for r in got] == [("I1", "Ann", D(2020, 1, 2))]


def test_text(spark):
    df = spark.createDataFrame([("<html><script>x</script><nav>menu</nav><p>One &amp; two</p><aside>no</aside><p> three </p></html>",), ("<nav>only</nav>",), (None,)], "h string")
    assert [r.t for r in df.select(html_text(F.col("h")).alias("t")).collect()] == ["One & two\nthree", None, None]
    arts = spark.createDataFrame([("x" * 149,), (" " + "x" * 150,), ("word " * 2000,), (None,)], "t string")
    assert [(r.n_words, r.truncated, len(r.t)) for r in text_gate(arts, "t").orderBy("n_words").collect()] == [(1, True, 151), (2000, False, 8000)]


def test_filing_requests(spark):
    got = feeds.filing_requests(spark, now()).orderBy("seq").collect()
    assert len(got) == 18 and got[-1].entity is None and (got[0].startdt, got[0].enddt) == (D(2026, 1, 13), D(2026, 1, 20))


def test_card_wording(spark):
    from dealforge.functions import display

    rows = [("A", "B", ["f"], D(2026, 1, 20), 1.25, "edgar"), ("A", None, ["f"], D(2026, 1, 19), None, "x"), (None, "B", ["f"], D(2026, 1, 15), 0.0, None), ("", "", ["f"], D(2026, 1, 1), 1234.56, "chow"), (None, None, [], None, 2.0, "rss")]
    df = spark.createDataFrame(rows, "a string, s string, f array<string>, d date, v double, k string")
    day = F.lit(D(2026, 1, 20))
    got = [tuple(r) for r in df.select(display.headline(F.col("a"), F.col("s"), F.col("f")), display.day_label(F.col("d"), day), display.millions(F.col("v")), display.source_label(F.col("k"))).collect()]
    assert got == [
        ("A acquired from B", "Today", "$1.2M", "SEC Filing"), ("A — new ownership", "Yesterday", None, "News"), ("B changes ownership", "5 days ago", "$0.0M", "News"),
        ("f — ownership change", "Jan 1, 2026", "$1234.6M", "Federal Record"), ("Ownership change recorded", None, "$2.0M", "News"),
    ]


def test_landed_feeds_and_messages(spark, tmp_path):
    (tmp_path / "rss.xml").write_text("<rss><channel><item><title>REIT acquires homes</title><link> http://a </link><description>d</description><pubDate>Mon, 19 Jan 2026 06:00:00 +0000</pubDate></item></channel></rss>")
    (tmp_path / "atom.xml").write_text('<feed><entry><title>x</title><link rel="self" href="http://self"/><link href="http://b"/><content>acquisition</content><updated>2026-01-18T00:00:00Z</updated></entry></feed>')
    got = feeds.feed_articles(feeds.read_feed(spark, str(tmp_path / "*.xml"), "f"), now()).collect()
    assert sorted((r.url, r.published_at.date()) for r in got) == [("http://a", D(2026, 1, 19)), ("http://b", D(2026, 1, 18))]
    (tmp_path / "m.json").write_text(json.dumps([{"id": "1", "payload": {"mimeType": "text/plain"}}, {"id": "2", "payload": None}]))
    (tmp_path / "n.json").write_text(json.dumps({"id": "3", "payload": {"mimeType": "text/html"}}))
    read = mail.read_messages(spark, str(tmp_path / "*.json"))
    assert sorted((r.id, r.payload and r.payload.mimeType) for r in read.collect()) == [("1", "text/plain"), ("2", None), ("3", "text/html")]
    assert mail.alert_articles(read, now()).count() == 0
