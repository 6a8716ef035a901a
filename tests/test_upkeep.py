"""Summary counts kept up to date, and name search by trigrams."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from dealforge.operators import feed, search, summary
from dealforge.params import FeedFilter

ROWS = "id long, deal_id long"


def test_counts_follow_changes(spark, tmp_path):
    rnd = random.Random(4)
    sides = {s: {i: rnd.choice([None, *range(12)]) for i in range(60)} for s in summary.SIDES}
    df = lambda rows: spark.createDataFrame(list(rows.items()), ROWS)
    kept = summary.SummaryCounts(spark, f"file://{tmp_path}/counts", buckets=8)
    kept.create(df(sides["matches"]), df(sides["annotations"]))

    def want():
        n = {}
        for s, c in summary.SIDES.items():
            for deal in sides[s].values():
                if deal is not None:
                    n.setdefault(deal, dict.fromkeys(summary.SIDES.values(), 0))[c] += 1
        return n

    def got():
        return {r.id: {c: r[c] for c in summary.SIDES.values()} for r in kept.read().filter("cms_match_count + annotation_count > 0").collect()}

    assert got() == want()
    for step in range(3):
        deltas = []
        for s in sides:
            before = dict(sides[s])
            for i in rnd.sample(sorted(before), 10):
                del sides[s][i]
            for i in rnd.sample(sorted(sides[s]), 10):
                sides[s][i] = rnd.choice([None, *range(15)])
            sides[s] |= {1000 * (step + 1) + i: rnd.randrange(15) for i in range(8)}
            deltas.append(summary.difference(df(before), df(sides[s]), s))
        kept.apply(f"step {step}", *deltas)
        kept.apply(f"step {step}", *deltas)  # counts once
        assert got() == want()
    assert len(kept.apply("one", summary.ones(df({9999: 3}), "matches"))) == 1
    with pytest.raises(Exception, match="more rows went"):
        kept.apply("wrong", summary.ones(df({9998: 77}), "matches", -1))


DEALS = "id long, acquiring_entity string, seller_entity string, operator_names array<string>, stage string"


@pytest.fixture(scope="module")
def named(spark):
    rnd = random.Random(8)
    words = ["Hill", "VALLEY", "care", "Élan", "St.", "100%", "a_b", "Co", "x", "back\\slash"]
    name = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4)))
    rows = [(i, name() if i % 5 else None, name() if i % 3 else None, [name() for _ in range(i % 3)] if i % 7 else None, "detected") for i in range(300)]
    return spark.createDataFrame(rows, DEALS)


def test_search_equals_a_scan(spark, named, tmp_path):
    search.gram_table(named).write.parquet(f"file://{tmp_path}/grams")
    table = spark.read.parquet(f"file://{tmp_path}/grams")
    narrow = 0
    for text in ["valley", "HILL V", "st. c", "x", "co", "élan hill", "00%", "100\\% ", "a_b", "a\\_b", "hill%care", "nothing here", "care care care", "%", "v_l_e_y", "ack\\\\sla"]:
        rule = feed.conditions(FeedFilter(search=text))
        every = sorted(r.id for r in named.filter(rule).collect())
        some = search.narrowed(named, table, text)
        assert sorted(r.id for r in some.filter(rule).collect()) == every, text
        narrow += some.count() < 200
    assert narrow >= 6
    assert search.candidates(table, "ab") is None and search.narrowed(named, table, None) is named
    plan = search.candidates(table, "valley")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(gram), EqualTo(gram," in plan


def test_literal_grams():
    assert search.literal_grams("AbCd") == ["abc", "bcd"]
    assert search.literal_grams("ab%cd_efg") == ["efg"]
    assert search.literal_grams("ab\\%c") == ["ab%", "b%c"]
    assert search.literal_grams("éab") == [] and len(search.literal_grams("".join(map(chr, range(48, 123))))) == search.LOOKED_UP
