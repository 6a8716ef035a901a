"""Landed files as streams: nine good ones and a broken one, batches that are run again, the mail scan's limits."""

from __future__ import annotations

import base64
import datetime as dt
import json

from pyspark.sql import functions as F

from dealforge.schemas import MESSAGES
from dealforge.sources import feeds, mail
from dealforge.streaming import landing

AS_OF = dt.datetime(2026, 1, 20)


def run(spark, at, parse):
    landing.land(landing.whole_files(spark, f"file://{at}/landed", files=4), parse, f"file://{at}/table", f"file://{at}/state").start().awaitTermination()
    return (spark.read.parquet(f"file://{at}/{t}") for t in ("table", "table-rejects"))


def test_one_broken_feed_among_ten(spark, tmp_path):
    (tmp_path / "landed").mkdir()
    for i in range(9):
        if i % 2:
            body = f'<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title>A deal {i}</title><link rel="self" href="s"/><link href="https://a/{i}"/><content>c</content><updated>2026-01-19T00:00:00Z</updated></entry></feed>'
        else:
            body = f"<rss version='2.0'><channel><title>f</title><item><title>A deal {i}</title><link>https://a/{i}</link><pubDate>Mon, 19 Jan 2026 06:00:00 +0000</pubDate></item><item><title>x</title></item></channel></rss>"
        (tmp_path / "landed" / f"{i}.xml").write_text(body)
    (tmp_path / "landed" / "9.xml").write_text("<rss><channel><item><title>A deal 9</title><link>https://a/9</li")
    rows, rejects = run(spark, tmp_path, landing.feed_entries)
    articles = feeds.feed_articles(rows.withColumn("feed_url", F.lit("f")), F.lit(AS_OF)).collect()
    assert sorted(r.url for r in articles) == [f"https://a/{i}" for i in range(9)]
    assert all(r.published_at for r in articles)
    (bad,) = rejects.collect()
    assert bad.reason == "malformed" and bad.file.endswith("/9.xml") and bad.value.startswith("<rss>")
    # files that land later are read alone
    (tmp_path / "landed" / "10.xml").write_text("<html><body>moved</body></html>")
    (tmp_path / "landed" / "11.xml").write_text("")
    (tmp_path / "landed" / "12.xml").write_text("<rss><channel><title>none yet</title></channel></rss>")
    rows, rejects = run(spark, tmp_path, landing.feed_entries)
    assert rows.count() == 14
    assert sorted((r.file.rsplit("/", 1)[1], r.reason) for r in rejects.collect())[:1] == [("10.xml", "not a feed")]


def test_batch_run_again_writes_once(spark, tmp_path):
    (tmp_path / "landed").mkdir()
    (tmp_path / "landed" / "a.xml").write_text("<rss><channel><item><title>t</title><link>u</link></item></channel></rss>")
    run(spark, tmp_path, landing.feed_entries)
    (tmp_path / "state" / "commits" / "0").unlink()  # the batch was broken off before it was marked as done
    (tmp_path / "state" / "commits" / ".0.crc").unlink(missing_ok=True)
    rows, _ = run(spark, tmp_path, landing.feed_entries)
    assert rows.count() == 1


def message(i, date=None, text="A long title\n<https://www.google.com/url?rct=j&url=https://n/{}&ct=ga>"):
    headers = [{"name": "Date", "value": date}] if date else []
    return {"id": str(i), "payload": {"mimeType": "text/plain", "headers": headers, "body": {"data": base64.urlsafe_b64encode(text.format(i).encode()).decode()}}}


def test_messages(spark, tmp_path):
    (tmp_path / "landed").mkdir()
    for name, body in {"one": json.dumps(message(1)), "two": json.dumps([message(2), message(3)]), "cut": json.dumps(message(4))[:-9], "odd": '{"id": "5"}', "none": "[]"}.items():
        (tmp_path / "landed" / f"{name}.json").write_text(body)
    rows, rejects = run(spark, tmp_path, landing.messages)
    assert sorted(r.url for r in mail.alert_articles(rows, F.lit(AS_OF)).collect()) == ["https://n/1", "https://n/2", "https://n/3"]
    assert sorted((r.file.rsplit("/", 1)[1], r.reason) for r in rejects.collect()) == [("cut.json", "malformed"), ("odd.json", "no payload")]


def test_mail_scan_limits(spark):
    dates = {1: "Tue, 20 Jan 2026 06:00:00 +0000", 2: "Sun, 18 Jan 2026 00:00:00 +0000", 3: "Sat, 17 Jan 2026 23:59:59 +0000", 4: None, 5: "Mon, 19 Jan 2026 06:00:00 +0000"}
    df = spark.createDataFrame([(json.dumps(message(i, d)),) for i, d in dates.items()], "j string").select(F.from_json("j", MESSAGES).alias("m")).select("m.*")
    assert [r.id for r in mail.recent(df, F.lit(AS_OF)).collect()] == ["1", "5", "2", "4"]
    assert [r.id for r in mail.recent(df, F.lit(AS_OF), most=2).collect()] == ["1", "5"]
