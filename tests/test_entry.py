"""The driver's contract and the stream, end to end on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from dealforge.plans import queries as plans
from dealforge.streaming import known, poll

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


def text(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_against_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = plans.QUERIES[name](spark, SF)
    cur = con.execute(plans.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    got = sorted(tuple(text(r[c]) for c in sorted(cols)) for r in df.collect())
    at = [cols.index(c) for c in sorted(cols)]
    assert got == sorted(tuple(text(r[i]) for i in at) for r in cur.fetchall())


def test_stream_appends_once(spark, tmp_path):
    src, table, state = (f"file://{tmp_path}/{x}" for x in ("src", "table", "state"))
    for part in (["a", "b"], ["b", "c", "c"]):
        spark.createDataFrame([(u,) for u in part], "url string").coalesce(1).write.mode("append").parquet(src)
        poll.append_unknown(poll.landed(spark, src, "url string"), table, state).start().awaitTermination()
    store = known.KnownRows(spark, table, "url")
    assert sorted(r.url for r in store.read().collect()) == ["a", "b", "c"]
    assert sorted((r.n_rows, r.n_new) for r in store.counts().collect()) == [(2, 2), (3, 1)]


def test_first_seen(spark, tmp_path):
    src = f"file://{tmp_path}/src"
    spark.sql("SELECT * FROM VALUES ('a', timestamp'2026-01-01'), ('a', timestamp'2026-01-02'), ('b', timestamp'2026-01-03') AS t(url, at)").write.parquet(src)
    q = poll.first_seen(poll.landed(spark, src, "url string, at timestamp"), "url", "at").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.url for r in spark.table("seen").collect()) == ["a", "b"]
