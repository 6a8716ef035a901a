"""A run from landed articles to deals, matches and the articles' state."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Observation
from pyspark.sql import functions as F

from dealforge.operators import dedup, extract
from dealforge.plans import daily

D = dt.date
LONG = " words of a story about a sale" * 8


def extractor():
    # a nested function, so that tasks get it by value
    def ask(text: str) -> str:
        word = text.split()[0]
        if word == "broken":
            raise ValueError("no answer")
        one = lambda name, value=None: {"acquiring_entity": name, "states": ["VA"], "facility_count": 2, "acquisition_date": "2026-01-13", "deal_value_m": value}
        return json.dumps({"hill": [one("Hill Valley LLC"), one("Hill Valley INC"), one("Oak Care")], "oak": [one("Oak Care", 80)], "held": [one("Stored Co", 90)], "kept": [one("Elm Homes")]}.get(word, []))

    return ask


def test_run(spark, tmp_path):
    texts = {1: "hill" + LONG, 2: "oak" + LONG, 3: "held" + LONG, 4: "broken" + LONG, 5: None, 6: "", 7: "short", 8: "nothing" + LONG, 9: "kept" + LONG}
    articles = spark.createDataFrame([(i, f"u{i}", t, False, None) for i, t in texts.items()], "id long, url string, raw_text string, extraction_done boolean, extraction_error string")
    stored = spark.createDataFrame([("Stored", [], ["VA"], 2, None, D(2026, 1, 13)), ("Elm Homes", [], ["VA"], 3, None, D(2026, 1, 13))], "acquiring_entity string, operator_names array<string>, states array<string>, facility_count int, deal_value_m double, acquisition_date date")
    owners = spark.createDataFrame([("1", "P", "HILL VALLEY", "Org", "VA", D(2026, 1, 2))], "ccn string, provider_name string, owner_name string, owner_type string, provider_state string, ownership_start_date date")
    facilities = spark.createDataFrame([("1", "P", 1, 2, False, True)], "ccn string, provider_name string, five_star_rating int, staffing_rating int, sff_flag boolean, sff_candidate_flag boolean")
    counts = Observation()

    def written(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    answered = written(extract.replies(articles, extractor()), "replies")
    new = written(daily.new_deals(answered, dedup.with_hash(stored)), "deals")
    run = daily.run(articles, answered, new, owners, facilities, F.lit(D(2026, 2, 1)), counts=counts)
    # equal hashes within an article, an equal semantic key in another article, one that is stored: each is left out
    deals = {r.id: r for r in run.deals.collect()}
    assert {i: (r.acquiring_entity, r.stage) for i, r in deals.items()} == {"1-0": ("Hill Valley", "confirmed"), "1-2": ("Oak Care", "detected"), "9-0": ("Elm Homes", "detected")}
    assert deals["1-0"].recheck_after is None and deals["1-2"].recheck_after is not None
    assert counts.get == {"n_stored": 3, "n_confirmed": 1}
    assert [(r.deal_id, r.ccn, r.sff_candidate_flag) for r in run.matches.collect()] == [("1-0", "1", True)]
    state = {r.id: (r.extraction_done, r.extraction_error) for r in run.articles.collect()}
    assert state == {i: (True, {4: "no answer", 5: daily.NO_TEXT, 6: daily.NO_TEXT}.get(i)) for i in texts}


def test_run_of_nothing(spark):
    none = spark.createDataFrame([], "id long, url string, raw_text string, extraction_done boolean, extraction_error string")
    answered = extract.replies(none, extractor())
    stored = spark.createDataFrame([], "acquiring_entity string, dedup_hash string, states array<string>, facility_count int, acquisition_date date")
    assert daily.new_deals(answered, stored).count() == 0 and daily.article_state(none, answered).count() == 0


def test_with_text(spark):
    articles = spark.createDataFrame([(1, "own"), (2, ""), (3, None), (4, None)], "id long, raw_text string")
    got = daily.with_text(articles, spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, raw_text string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "own"), (2, "y"), (3, "z"), (4, None)]
