"""Cleaning, keys, dedup and names, against golden values and small Python oracles."""

from __future__ import annotations

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from dealforge.functions import clean, names
from dealforge.functions.keys import dedup_hash, dedup_key
from dealforge.operators import dedup, extract
from dealforge.params import NAME_SUFFIXES

DEAL = "id long, acquiring_entity string, seller_entity string, operator_names array<string>, states array<string>, facility_count int, deal_value_m double, acquisition_date date"
D = dt.date


def hashes(spark, rows):
    df = spark.createDataFrame(rows, DEAL)
    cols = [F.col(c) for c in ("acquiring_entity", "states", "acquisition_date", "facility_count", "deal_value_m", "operator_names")]
    return [(r.k, r.h) for r in df.select("id", dedup_key(*cols).alias("k"), dedup_hash(*cols).alias("h")).orderBy("id").collect()]


def test_hash_golden(spark):
    got = hashes(spark, [
        (1, "Hill Valley Healthcare LLC", None, [], ["VA"], 2, 82.4, D(2026, 1, 13)),
        (2, "Hill Valley Healthcare INC", None, None, ["VA"], None, None, D(2026, 1, 13)),
        (3, "Capital Funding Group", None, [], ["CO", "AL", "AZ"], 4, 51.2, D(2026, 2, 2)),
        (4, "X Incorporated", None, ["Third-Party Operator", "Zeta Care", "abc"], ["VA"], 1, 95.0, D(2026, 1, 9)),
        (5, None, None, None, None, None, None, None),
    ])
    assert got == [
        ("HILL VALLEY HEALTHCARE|VA|2026-01|2|80|", "4e40943c2d9d9ccf"),
        ("HILL VALLEY HEALTHCARE|VA|2026-01|||", "ac17c004edaa790f"),
        ("CAPITAL FUNDING GROUP|AL,AZ,CO|2026-02|4|50|", "b2942dbc1f294736"),
        ("XORPORATED|VA|2026-01|1|100|ZETA CARE", "c0cb0edde0ca4061"),
        ("|||||", "1867f76f89b18a0f"),
    ]
    assert all(h == hashlib.sha256(k.encode()).hexdigest()[:16] for k, h in got)


def test_hash_ignores_suffix_and_tells_deals_apart(spark):
    a, b, c = hashes(spark, [
        (1, "Hill Valley Healthcare LLC", None, [], ["VA"], 2, None, D(2026, 1, 13)),
        (2, "Hill Valley Healthcare INC", None, [], ["VA"], 2, None, D(2026, 1, 20)),
        (3, "Capital Funding Group", None, [], ["CO"], 2, None, D(2026, 2, 2)),
    ])
    assert a == b and a != c


@pytest.mark.parametrize("value,want", [(None, ""), (0.0, ""), (4.0, "0"), (85.0, "80"), (95.0, "100"), (82.4, "80")])
def test_value_halves_to_even(spark, value, want):
    assert hashes(spark, [(1, "A", None, [], [], None, value, None)])[0][0].split("|")[4] == want


def test_batch_dedup(spark):
    row = ("Hill Valley", None, [], ["VA"], 2, 82.4, D(2026, 1, 13))
    df = spark.createDataFrame([(1, *row), (2, *row), (3, "Other", *row[1:])], DEAL).withColumn("article_id", F.lit(7))
    assert sorted(r.id for r in dedup.batch_dedup(df, ["id"]).collect()) == [1, 3]


def greedy(rows):
    hashes, keys, kept = set(), set(), []
    for i, h, k in rows:
        if h not in hashes and (k is None or k not in keys):
            kept.append(i)
            hashes.add(h)
            keys.add(k) if k is not None else None
    return kept


def test_greedy_unique_is_sequential(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        # all of one coarse group: hash and key chains of every kind
        rows.append((i, f"h{rnd.randrange(90)}", f"k{rnd.randrange(60)}" if rnd.random() < 0.8 else None, ["VA"], D(2026, 1, 1 + 0), 2))
    df = spark.createDataFrame(rows, "id long, dedup_hash string, acquiring_entity string, states array<string>, acquisition_date date, facility_count int")
    got = sorted(r.id for r in dedup.greedy_unique(df, ["id"]).collect())
    assert got == greedy([(r[0], r[1], r[2]) for r in rows])


def test_greedy_unique_small_chain(spark):
    rows = [(1, "h1", "a"), (2, "h2", "a"), (3, "h2", "b"), (4, "h1", "c"), (5, "h5", None)]
    df = spark.createDataFrame([(*r, ["VA"], D(2026, 1, 1), 2) for r in rows], "id long, dedup_hash string, acquiring_entity string, states array<string>, acquisition_date date, facility_count int")
    assert sorted(r.id for r in dedup.greedy_unique(df, ["id"]).collect()) == [1, 3, 5]


NAMES = {
    "620 HEATHWOOD DRIVE OPCO LLC": "620 Heathwood Drive", "Welltower Inc.": "Welltower", "WELLTOWER INC": "Welltower", "SABRA HEALTH CARE REIT INC": "Sabra Health Care REIT",
    "SABRA HEALTH CARE REIT INC.": "Sabra Health Care", "ACME L.L.C.": "Acme L.l.c", "THE ENSIGN GROUP": "THE Ensign Group", "CO HEALTH": "Health", "LLC": "LLC", "": "", None: None,
}


def test_display_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    assert {r.n: r.d for r in df.select("n", names.entity_name(F.col("n")).alias("d")).collect()} == NAMES


def test_clean_states_and_fields(spark):
    df = spark.createDataFrame([(1, ["VA", "CO", "al"]), (2, ["Virginia"]), (3, []), (4, None)], "id long, s array<string>")
    got = {r.id: r.c for r in df.select("id", clean.clean_states(F.col("s")).alias("c")).collect()}
    assert got == {1: ["VA", "CO", "AL"], 2: ["VI"], 3: [], 4: []}
    texts = spark.createDataFrame([("12",), ("12.7",), (" 8 ",), ("$8",), (None,), ("Undisclosed",), ("2026-02-30",), ("2026-02-03",)], "x string")
    x = F.col("x")
    got = [tuple(r) for r in texts.select(clean.clean_int(x), clean.clean_float(x), clean.clean_str(x), clean.clean_date_text(x), clean.clean_date(x)).collect()]
    assert [g[0] for g in got] == [12, None, 8, None, None, None, None, None]
    assert [g[1] for g in got][:4] == [12.0, 12.7, 8.0, None]
    assert got[5][2] is None and got[6][3] == "2026-02-30" and got[6][4] is None and got[7][4] == D(2026, 2, 3)


def test_replies(spark):
    full = '{"acquiring_entity":"Hill Valley Healthcare","seller_entity":"Welltower","operator_names":"One Op","facility_names":[],"states":["VA"],"facility_count":2,"deal_value_m":82.4,"acquisition_date":"2026-01-13"}'
    nothing = '{"acquiring_entity":null,"seller_entity":null,"operator_names":[],"facility_names":[],"states":[]}'
    rows = spark.createDataFrame([(1, f"```json\n[{full}, {nothing}]\n```"), (2, full), (3, "no json"), (4, None), (5, '{"facility_count": 12.7, "states": "Texas"}')], "id long, reply string")
    got = {(r.id, r.ord): r for r in extract.cleaned(extract.reply_deals(rows), "id", "ord").collect()}
    assert sorted(got) == [(1, 0), (2, 0), (5, 0)]
    r = got[2, 0]
    assert (r.acquiring_entity, r.deal_value_m, r.states, r.operator_names, r.facility_count) == ("Hill Valley Healthcare", 82.4, ["VA"], ["One Op"], 2)
    assert got[5, 0].states == ["TE"]


def test_extract_plugin(spark):
    long = " ".join(["word"] * 200)
    arts = spark.createDataFrame([(1, long), (2, "short"), (3, "word " * 40), (4, None)], "id long, raw_text string")
    out = extract.extract(arts, lambda text: '{"acquiring_entity": "A", "facility_count": %d}' % len(text.split()))
    assert sorted((r.article_id, r.facility_count, r.confidence) for r in out.collect()) == [(1, 200, None), (3, 40, "low")]


def test_greedy_unique_hot_group_and_long_chain(spark):
    # one coarse group: many repeats of one pair, a chain that rounds can't finish, nulls in the order
    rows = [(i, "hot", "hot") for i in range(3000)] + [(3000 + i, f"h{(i + 1) // 2}", f"k{i // 2}") for i in range(40)]
    df = spark.createDataFrame([(*r, ["VA"], D(2026, 1, 1), 2, None if r[0] % 5 == 0 else 1) for r in rows], "id long, dedup_hash string, acquiring_entity string, states array<string>, acquisition_date date, facility_count int, seen int")
    assert sorted(r.id for r in dedup.greedy_unique(df, ["id"]).collect()) == greedy(rows)
    by_seen = sorted(rows, key=lambda r: (r[0] % 5 != 0, r[0]))
    assert sorted(r.id for r in dedup.greedy_unique(df, ["seen"]).collect()) == sorted(greedy(by_seen))


def test_latest_by(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, None, 2), (2, "c", 1), (None, "d", 1)], "k long, v string, n int")
    assert sorted((tuple(r) for r in dedup.latest_by(df, ["k"], F.col("n")).collect()), key=str) == [(1, "b", 3), (2, "c", 1), (None, "d", 1)]


def test_entity_name_works_its_name_out_once(spark):
    """Each suffix is cut once a name: the plan holds as many cuts as suffixes, and one for blanks."""
    plan = spark.createDataFrame([("ACME LLC",)], "n string").select(names.entity_name(F.col("n")).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == len(NAME_SUFFIXES) + 1
